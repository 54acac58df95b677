"""Benchmark decontamination by templates.

A text becomes tokens (runs of letters, runs of digits, single signs of scripts without spaces; case aside).  At the first
level all of them stay.  In its template, runs of numbers become <num>, a unit after a number <unit>, and, at the third
level, runs of capitalised words within a sentence <name>; at the last
level a capitalised word that opens a sentence is part of a <name> as well.  A window has ``WINDOW`` template tokens, and more until ``PLAIN`` of them are no slots, so it tells something
in texts full of numbers too; what has no such window in ``LONGEST`` tokens, as a table of numbers, still has those of the first
level, where numbers are compared by value.  The windows of the benchmark are a table; those of the documents meet it in a hash join.
Documents' windows whose hash a Bloom filter of that table lacks are never made rows, so what is joined is little more than
the hits: a table of up to ``BLOCK_WINDOWS`` windows is broadcast, a larger one is joined by a shuffle.  Hits then meet by
document; texts are never moved.

Hits of a document and an item are lined up by the distance of their positions.  In each line slots are
checked: each value of the item must stand for one value of the document throughout, or the window does not count; lines
join the largest one if their slots agree.  A document is contaminated by an item if the windows that count cover ``COVERAGE`` of the item's tokens, or ``RUN`` of them in a row, however long the item.

Defined cases: null and empty texts are not contaminated, and items without tokens match nothing; items of fewer than ``LEAST`` tokens match
where they are whole sentences of a document, word by word; other items shorter than a window match by a window of their length; rows that repeat are reported each, of documents
and of the benchmark; an empty table or benchmark gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import chunks, stored
from tidemark.llm.word_hash import mix, of_stretches, padded, windows

WINDOW, LEAST, COVERAGE, BLOCK_WINDOWS = 8, 4, 0.5, 200_000
#: Tokens of an item in a row that suffice whatever their share.
RUN = 30
#: Tokens of a window that are no slots: it grows up to LONGEST tokens to have them. Windows of short items need half of their length.
PLAIN, LONGEST = 4, 64
#: Bits a window has in the filter, and the most bits that it has: beyond, more rows reach the join.
FILTER_BITS, MOST_BITS = 64, 1 << 27
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg lb lbs oz ton tons tonne tonnes ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degree degrees dollar dollars cent cents "
    "euro euros pound pounds usd eur mph kmh kph hz khz mhz ghz w kw v volt volts watt watts j joule joules n newton newtons pa kpa k b kb mb gb tb"
).split()
CHUNK = 1_000_000
_U = np.uint64
#: Scripts that part no words, sign by sign (a base with what is set on it), and their full stops.
_UNPARTED = re.compile("([\u0e00-\u0e30\u0e32\u0e33\u0e3f-\u0e46\u0e81-\u0eb0\u0eb2\u0eb3\u0ebd-\u0ec6\u1000-\u102a\u1780-\u17b3\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_STOPS = str.maketrans("。！？｡，、；：", ".!?.,,;:")
_SIGNS = re.compile("[\xa0-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf -⁯　-〃]")
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = 1
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n\r")] = True
WORD, NUM, UNIT, NAME = range(4)
LEVELS = 4
_SLOT = mix(np.arange(11, 15, dtype=_U))


def _lower(text: str) -> str:
    low = text.lower()
    if len(low) == len(text) and len(low.encode("utf-8", "surrogatepass")) == len(text.encode("utf-8", "surrogatepass")):
        return low
    same = [(c, c.lower()) for c in text]
    return "".join(b if len(a.encode("utf-8", "surrogatepass")) == len(b.encode("utf-8", "surrogatepass")) else a for a, b in same)


class Tokens:
    """Tokens of many texts: text number, place in the bytes, kind and hash, at all levels."""

    def __init__(self, texts: Sequence[str]) -> None:
        texts = [t if t.isascii() else _UNPARTED.sub(r" \1", _SIGNS.sub(" ", t.translate(_STOPS))) for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        low = [r.lower() if r.isascii() else _lower(t).encode("utf-8", "surrogatepass") for r, t in zip(raw, texts, strict=True)]
        self.low = b"\n".join([b"", *low, b"\n"])
        upper, lower = np.frombuffer(b"\n".join([b"", *raw, b"\n"]), np.uint8), np.frombuffer(self.low, np.uint8)
        at = np.cumsum([1, *(len(r) + 1 for r in raw)])
        kind = _CLASS[lower]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        kept = kind[edge] > 0
        first = edge[kept]
        last = np.append(edge[1:], len(lower))[kept]
        text = np.searchsorted(at, first, "right") - 1
        number = kind[first] == 1
        self._single = text, first, last, of_stretches(padded(self.low), first, last)
        stops = np.concatenate([[0], np.cumsum(_STOP[lower])])
        self._single_opens = self._opening(stops, text, first, last)
        # a run of numbers is one slot
        again = np.zeros(len(first), bool)
        again[1:] = number[1:] & number[:-1] & (text[1:] == text[:-1])
        own = np.flatnonzero(~again)
        last = last[np.append(own[1:], len(first)) - 1] if len(own) else last[:0]
        first, text, number = first[own], text[own], number[own]
        word = of_stretches(padded(self.low), first, last)
        self.kind = np.where(number, NUM, WORD).astype(np.int8)
        after = np.zeros(len(first), bool)
        after[1:] = number[:-1] & (text[1:] == text[:-1]) & ~number[1:]
        maybe = np.flatnonzero(after)
        self.kind[maybe[np.isin(word[maybe], unit_hashes())]] = UNIT
        capital = (upper[first] != lower[first]) | ((upper[first] >= 128) & (upper[first + 1] != lower[first + 1]))
        self.opens = self._opening(stops, text, first, last)
        self.capital = capital & (self.kind == WORD)
        self.text, self.first, self.last, self.word = text, first, last, word

    @staticmethod
    def _opening(stops: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a token opens a text or a sentence. stops: full stops before each byte."""
        opens = np.ones(len(first), bool)
        opens[1:] = (stops[first[1:]] > stops[last[:-1]]) | (text[1:] != text[:-1])
        return opens

    def sentences(self, level: int) -> tuple[np.ndarray, np.ndarray] | None:
        """At level 0, whether a token opens and whether it ends a sentence."""
        return None if level else (self._single_opens, np.append(self._single_opens[1:], True))

    def level(self, level: int) -> tuple[np.ndarray, ...]:
        """text, first, last, kind and template hash of the tokens. Level 0 keeps all, numbers one by one, 1 numbers none, 2 names within sentences none as well, 3 no names."""
        if not level:
            text, first, last, word = self._single
            return text, first, last, np.full(len(text), WORD, np.int8), word
        name = self.capital if level == 3 else self.capital & ~self.opens if level == 2 else np.zeros(len(self.kind), bool)
        kind = np.where(name, NAME, self.kind).astype(np.int8)
        hashes = np.where(kind == WORD, self.word, _SLOT[kind])
        if not name.any():
            return self.text, self.first, self.last, kind, hashes
        # a run of names is one slot, up to the sentence's end
        again = np.zeros(len(kind), bool)
        again[1:] = name[1:] & name[:-1] & ~self.opens[1:]
        own = np.flatnonzero(~again)
        last = self.last[np.append(own[1:], len(kind)) - 1]
        return self.text[own], self.first[own], last, kind[own], hashes[own]


def unit_hashes() -> np.ndarray:
    if not _UNIT_HASHES:
        data = padded(" ".join(["", *UNITS, ""]).encode())
        gaps = np.flatnonzero(data[:-8] == 32)
        _UNIT_HASHES.append(of_stretches(data, gaps[:-1] + 1, gaps[1:]))
    return _UNIT_HASHES[0]


_UNIT_HASHES: list[np.ndarray] = []


def _windows(text: np.ndarray, kind: np.ndarray, hashes: np.ndarray, short: Iterable[int], sentences: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, sizes and hashes of the windows within one text: those of WINDOW tokens or more, then those of the short sizes.

    Sizes below LEAST need sentences, and are whole ones.
    """
    n = len(hashes)
    plain = np.flatnonzero(kind == WORD)
    before = np.concatenate([[0], np.cumsum(kind == WORD)])
    if n >= WINDOW:
        start = np.arange(n - WINDOW + 1)
        wanted = before[start] + PLAIN - 1
        enough = wanted < len(plain)
        start, wanted = start[enough], wanted[enough]
        size = np.maximum(WINDOW, plain[wanted] + 1 - start)
        good = (size <= LONGEST) & (text[start + size - 1] == text[start])
        start, size = start[good], size[good]
        whole = windows(hashes, WINDOW)[start]
        longer = np.flatnonzero(size > WINDOW)
        for k in range(WINDOW, LONGEST):
            longer = longer[size[longer] > k]
            if not len(longer):
                break
            whole[longer] = mix(mix(whole[longer] + _U(k)) + hashes[start[longer] + k])
        yield start, size, whole
    for length in short:
        start = np.arange(max(0, n - length + 1))
        if length < LEAST:
            if sentences is None:
                continue
            opens, ends = sentences
            start = start[opens[start] & ends[start + length - 1]]
        start = start[(text[start] == text[start + length - 1]) & (2 * (before[start + length] - before[start]) >= length)]
        yield start, np.full(len(start), length), mix(windows(hashes, length)[start] + _U(length))


def _values(kind: np.ndarray, first: np.ndarray, last: np.ndarray, low: bytes, start: int, size: int) -> bytes:
    """The slots of a window: place, kind, length of the value, and the value."""
    return b"".join(struct.pack("<BBI", k, kind[start + k], last[start + k] - first[start + k]) + low[first[start + k] : last[start + k]] for k in np.flatnonzero(kind[start : start + size] != WORD).tolist())


def _slots(values: bytes) -> list[tuple[int, bytes]]:
    """Kind and value of each slot of a window, by place."""
    out, at = [], 0
    while at < len(values):
        _, kind, n = struct.unpack_from("<BBI", values, at)
        out.append((kind, values[at + 6 : at + 6 + n]))
        at += 6 + n
    return out


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_no, item_id, level, size, hash, place, tokens, item_values: the windows of each row of the benchmark."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks(texts, CHUNK):
                tokens, out = Tokens(texts[lo:hi]), []
                numbers, ids = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("item_no", "item_id"))
                for level in range(LEVELS):
                    text, first, last, kind, hashes = tokens.level(level)
                    counts = np.bincount(text, minlength=hi - lo)
                    base = np.concatenate([[0], np.cumsum(counts)])
                    short = sorted({c for c in counts.tolist() if 0 < c < WINDOW})
                    for start, size, whole in _windows(text, kind, hashes, short, tokens.sentences(level)):
                        for s, n, h in zip(start.tolist(), size.tolist(), whole.view(np.int64).tolist(), strict=True):
                            t = int(text[s])
                            if n >= WINDOW or counts[t] == n:  # a short item is one window
                                out.append((numbers[t], ids[t], level, n, h, s - int(base[t]), int(counts[t]), _values(kind, first, last, tokens.low, s, n)))
                yield _batch(out, _ITEM)

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).withColumn("item_no", F.monotonically_increasing_id())
    return rows.mapInArrow(cut, _ITEM)


_ITEM = "item_no long, item_id long, level int, size int, hash long, place int, tokens int, item_values binary"
_HIT = "row long, doc_id long, level int, size int, hash long, start int, doc_values binary"
_FOUND = "doc_id long, item_id long, kind string, coverage double"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.record_batch([pa.array(c, _TYPES[t]) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=list(names))


#: The two places of a hash in a filter of so many bits, a power of two.
_PLACES = (lambda h, bits: (h & _U(bits - 1)).astype(np.int64), lambda h, bits: (mix(h) & _U(bits - 1)).astype(np.int64))


def window_filter(found: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the windows' hashes as bytes, of MOST_BITS at most."""
    bits = 1 << max(10, min(count * FILTER_BITS, MOST_BITS).bit_length() - 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([place(batch.column(0).to_numpy().view(_U), bits) for place in _PLACES])
            byte, index = np.unique(at >> 3, return_inverse=True)
            value = np.zeros(len(byte), np.int64)
            np.bitwise_or.at(value, index, 1 << (at & 7))
            yield pa.record_batch([pa.array(byte), pa.array(value)], names=["byte", "value"])

    set_bytes = found.select("hash").mapInArrow(places, "byte long, value long").groupBy("byte").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits >> 3, np.uint8)
    out[set_bytes["byte"].to_numpy()] = set_bytes["value"].to_numpy().astype(np.uint8)
    return out


def document_windows(docs: DataFrame, held: np.ndarray, short: list[int]) -> DataFrame:
    """row, doc_id, level, size, hash, start, doc_values: the windows of whole documents that the filter has."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 8 * len(held)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks(texts, CHUNK):
                tokens, out = Tokens(texts[lo:hi]), []
                rows, ids = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("row", "doc_id"))
                for level in range(LEVELS):
                    text, first, last, kind, hashes = tokens.level(level)
                    base = np.searchsorted(text, np.arange(hi - lo + 1))
                    for start, size, whole in _windows(text, kind, hashes, short, tokens.sentences(level)):
                        for place in _PLACES:
                            at = place(whole, bits)
                            maybe = np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                            start, size, whole = start[maybe], size[maybe], whole[maybe]
                        for s, n, h in zip(start.tolist(), size.tolist(), whole.view(np.int64).tolist(), strict=True):
                            t = int(text[s])
                            out.append((rows[t], ids[t], level, n, h, s - int(base[t]), _values(kind, first, last, tokens.low, s, n)))
                if out:
                    yield _batch(out, _HIT)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(probe, _HIT)


def _coverage(of: dict[int, list], n: int) -> tuple[float, int, bool]:
    """Share of the item's tokens in windows (place, size, item's slots, document's slots) whose slots agree, the most of these in a row, and whether all slots have the item's values."""
    lines = []
    for found in of.values():
        stands: dict[tuple[int, bytes], bytes] = {}
        covered: set[int] = set()
        for place, size, mine, theirs in sorted(found, key=lambda w: w[:2]):
            new = {}
            for slot, (_, value) in zip(mine, theirs, strict=True):
                if stands.get(slot, new.get(slot, value)) != value:
                    break
                new[slot] = value
            else:
                stands |= new
                covered.update(range(place, place + size))
        if covered:
            lines.append((covered, stands))
    lines.sort(key=lambda x: (-len(x[0]), sorted(x[0])))
    whole: set[int] = set()
    agreed: dict[tuple[int, bytes], bytes] = {}
    for covered, stands in lines:
        if all(agreed.get(a, b) == b for a, b in stands.items()):
            whole |= covered
            agreed |= stands
    most = run = 0
    for q in sorted(whole):
        run = run + 1 if q - 1 in whole else 1
        most = max(most, run)
    return len(whole) / n, most, all(a[1] == b for a, b in agreed.items())


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contaminations among hits that are in the order of their rows. Holds one document's hits."""
    current, held, out = None, [], []

    def close() -> None:
        lines: dict[tuple, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        items = {}
        for no, item, level, size, place, n, mine, start, theirs in held:
            lines[no, level][start - place].append((place, size, _slots(mine), _slots(theirs)))
            items[no, level] = item, n
        best: dict[int, tuple[float, str, int | None]] = {}
        for (no, level), of in sorted(lines.items(), key=lambda x: x[0]):
            item, n = items[no, level]
            share, run, exact = _coverage(of, n)
            if (share >= COVERAGE or run >= RUN) and share > best.get(no, (0.0,))[0]:
                best[no] = share, "exact" if exact else "template", item
        out.extend((current[1], item, what, share) for share, what, item in best.values())

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("row", "doc_id", "item_no", "item_id", "level", "size", "place", "tokens", "item_values", "start", "doc_values")]
        for row, doc, *hit in zip(*columns, strict=True):
            if current is not None and row != current[0]:
                close()
                held.clear()
            current = row, doc
            held.append(hit)
        if out:
            yield _batch(out, _FOUND)
            out.clear()
    if held:
        close()
    if out:
        yield _batch(out, _FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, kind ('exact' or 'template'), coverage: one row a document's row and item."""
    items = stored(item_windows(benchmark), "windows")
    size = items.groupBy("size").agg(F.count("*").alias("n")).filter(F.col("size") <= LONGEST).collect()  # a row a size
    count = sum(r["n"] for r in size)
    if not count:
        return docs.sparkSession.createDataFrame([], _FOUND)
    hits = document_windows(docs, window_filter(items, count), sorted(r["size"] for r in size if r["size"] < WINDOW))
    met = hits.join(F.broadcast(items) if count <= BLOCK_WINDOWS else items.hint("shuffle_hash"), ["level", "size", "hash"])
    return met.repartition("row").sortWithinPartitions("row").mapInArrow(_decide, _FOUND)
