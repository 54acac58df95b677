"""Alignment of two tokenizers' tokens, and what their links count over the corpus.

Texts are cut into units at places that neither tokenizer joins across (``CUT``, checked against both vocabularies), and
each distinct unit is encoded and aligned once, by relations: tokens are exploded with their ends, the two token tables meet
in an equi-join on unit and end, and a running count of the ends that both have is the group's number.  A stretch between
two neighbouring ends of either side lies in one token of each, and these stretches are the overlapping pairs: a unit has as
many links as distinct ends, so the tokens that cover a stretch are filled along the window and no pairs of a group are
tried.  (Tokens are cut where units are, so a document's groups and links are those of its units, in order.)

Units that are frequent (``HOT`` of them and ``HOT_BYTES`` at most, chosen by a count of all) are broadcast and looked up
where texts are read, so a document is a list of their numbers and of its rare units.  The rare ones are posexploded and meet
their results in a shuffle join, which has no hot key, and are put between the others by document.  A pair's count is over distinct (document, pair).

Defined cases: texts that are null, empty, or not given back by their tokens' bytes have no tokens: zeros, and an empty
string for the groups.  Bytes that are not UTF-8 count as U+FFFD.  Each row is a document, so rows that repeat count each; null ids stay.  An empty table gives no rows; other
input columns are ignored.  A text without cuts is one unit, however long.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm._common import chunks, forget, stored

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Signs that any of the libraries may take for white space, and letters that all of them take for letters.
_SPACES = r"\s\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿"
_LETTERS = r"A-Za-zÀ-ÖØ-öø-ɏ"
#: Places in a text where no token goes on: before a space or line end that follows no white space, between a letter and a full stop or comma, and after a line end alone.
CUT = rf"(?=[ \n])(?<=[^{_SPACES}])|(?=[.,])(?<=[{_LETTERS}])|(?<=[.,])(?=[{_LETTERS}])|(?<=\n)(?=[{_LETTERS}])(?<=[^{_SPACES}]\n)"
#: Units, and bytes of what is known of them, that may be broadcast.
HOT, HOT_BYTES = 200_000, 64_000_000
#: Ids are below this.
_IDS = 1 << 24
#: Kinds of characters that ``CUT`` tells apart; those from _BREAK on are white space.
_OTHER, _LETTER, _STOP, _BREAK, _SPACE, _WHITE = range(6)
_UNIT = "_u long, ok boolean, a array<struct<id: int, end: int>>, b array<struct<id: int, end: int>>"


class Encoder:
    """ids(texts) gives each text's ids; ``pieces`` the bytes of each id."""

    def __init__(self, ids: Callable[[Sequence[str]], list[list[int]]], pieces: list[bytes | None]):
        self.ids, self.pieces = ids, pieces
        self.held = [b"\xff" if p is None else p for p in pieces]  # no text has this byte
        self.sizes = np.array([*map(len, self.held)], np.int64)
        crossed = [p for p in pieces if p and regex.search(CUT, p.decode(errors="ignore"))]
        if crossed:
            raise ValueError(f"tokens go across the cuts of texts: {crossed[:5]}")


@cache
def byte_level(path: str) -> Encoder:
    """Of a byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    pieces: list[bytes | None] = [None] * (max(t.get_vocab().values()) + 1)
    special = {i for i, token in t.get_added_tokens_decoder().items() if token.special}
    for piece, i in t.get_vocab().items():
        pieces[i] = None if i in special else bytes(signs[c] for c in piece)
    return Encoder(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], pieces)


@cache
def piece_model(path: str) -> Encoder:
    """Of a sentencepiece model with byte fallback that has no piece with a line end: behind one, a text gets no space of the model's own."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    before = sp.encode("\n")
    pieces: list[bytes | None] = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        pieces.append(bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else None if sp.is_control(i) or sp.is_unknown(i) else p.replace("▁", " ").encode())
    if any(p and b"\n" in p and p != b"\n" for p in pieces):
        raise ValueError("a piece holds a line end")

    def ids(texts: Sequence[str]) -> list[list[int]]:
        found = sp.encode(["\n" + t for t in texts], num_threads=1)
        if any(f[: len(before)] != before for f in found):
            raise ValueError("the line end before a text was not a token of its own")
        return [f[len(before) :] for f in found]

    return Encoder(ids, pieces)


def _lists(encoder: Encoder, texts: Sequence[str], raw: Sequence[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Whether each text's tokens give it back, and those that do so as (id, end): bytes of the text up to the token's end."""
    ids = encoder.ids(texts)
    flat, n = np.array([*chain.from_iterable(ids)], np.int64), np.array([*map(len, ids)])
    told, ends, at = b"".join([encoder.held[i] for i in flat.tolist()]), np.append(0, np.cumsum(encoder.sizes[flat])), np.append(0, np.cumsum(n))
    bounds = ends[at]
    ok = np.array([told[first:end] == want for (first, end), want in zip(pairwise(bounds.tolist()), raw, strict=True)])
    good = np.repeat(ok, n)
    values = [pa.array(x[good], pa.int32()) for x in (flat, ends[1:] - np.repeat(bounds[:-1], n))]
    return ok, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n * ok)), pa.int32()), pa.StructArray.from_arrays(values, ["id", "end"]))


def encoded(units: DataFrame, a: Callable[[], Encoder], b: Callable[[], Encoder]) -> DataFrame:
    """_u, whether both sides give the unit back, and the tokens of both. units: _u, unit."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = a(), b()
        for batch in batches:
            texts = batch.column("unit").to_pylist()
            for first, end in chunks(texts):
                raw = [t.encode() for t in texts[first:end]]
                (good, left), (fine, right) = (_lists(e, texts[first:end], raw) for e in (one, two))
                yield pa.RecordBatch.from_arrays([batch.column("_u").slice(first, end - first), pa.array(np.logical_and(good, fine)), left, right], names=["_u", "ok", "a", "b"])

    return units.select("_u", "unit").mapInArrow(encode, _UNIT)


def tokens(found: DataFrame) -> DataFrame:
    """_u, _end and the id, as a or b, of each token of both sides; _end: bytes of the unit up to the token's end."""
    side = lambda name: F.transform(name, lambda t: F.struct(F.lit(name == "a").alias("a"), t["id"].alias("id"), t["end"].alias("_end")))
    each = found.select("_u", F.explode(F.concat(side("a"), side("b"))).alias("_t")).select("_u", "_t.*")
    return each.select("_u", "_end", F.when(F.col("a"), F.col("id")).alias("a"), F.when(~F.col("a"), F.col("id")).alias("b"))


def align_units(found: DataFrame) -> DataFrame:
    """_u, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;...``) and links (a pair's number for each link). found: as of ``encoded``.

    All of it after one deal by unit: as each side has an end once, the full equi-join of both on unit and end is a grouped one.
    """
    ends = tokens(found.filter("ok").repartition("_u")).groupBy("_u", "_end").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    # from the last end to the first: what was seen last covers the stretch before it
    back = Window.partitionBy("_u").orderBy(F.col("_end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    ends = ends.select("_u", "_end", "a", "b", F.sum(both.cast("int")).over(back).alias("_group"), pair(F.last("a", True).over(back), F.last("b", True).over(back)).alias("_link"))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("_end", c)))), lambda x: x[c]), ",")
    groups = ends.groupBy("_u", "_group").agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.concat(listed("a"), F.lit("|"), listed("b")).alias("_said"), F.collect_list("_link").alias("_links")
    )
    said = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_group")).alias("_g"), "_said"))), lambda x: x["_said"])
    units = groups.groupBy("_u").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.array_join(said, ";").alias("groups"), F.flatten(F.collect_list("_links")).alias("links")
    )
    return units.withColumn("n_links", F.size("links").cast("long"))


def pair(a: Column, b: Column) -> Column:
    return a.cast("long") * _IDS + b


@cache
def _kinds() -> np.ndarray:
    """The kind of each character below 0x10000; those above are others."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    kinds = np.zeros(0x10000, np.uint8)
    for signs, kind in ((_LETTERS, _LETTER), (_SPACES, _WHITE), (".,", _STOP), ("\n", _BREAK), (" ", _SPACE)):
        kinds[[ord(c) for c in regex.findall(f"[{signs}]", every)]] = kind
    return kinds


@cache
def _pairs() -> bytes:
    """For two neighbouring characters of kinds x and y, at 8 * x + y: 1 if a text is cut between them, 2 if it is unless white space is before both."""
    cuts = np.zeros(256, np.uint8)
    for x in range(_WHITE + 1):
        for y in (_BREAK, _SPACE) if x < _BREAK else ():
            cuts[8 * x + y] = 1
    cuts[[8 * _LETTER + _STOP, 8 * _STOP + _LETTER]] = 1
    cuts[8 * _BREAK + _LETTER] = 2
    return cuts.tobytes()


def cut(texts: pa.Array) -> pa.Array:
    """The units of each text and a space before it, in order, as places in their bytes; none for a text that is null or empty."""
    some = pc.greater(pc.binary_length(texts), 0).fill_null(False)
    spaced = pc.binary_join_element_wise(" ", texts.filter(some), "")
    _, starts, held = spaced.buffers()
    starts = np.frombuffer(starts, np.int32)[: len(spaced) + 1]
    data = np.frombuffer(held or b"", np.uint8)[: starts[-1]]
    # a character's kind stands at each of its bytes
    kinds = np.frombuffer(bytearray(data.tobytes().translate(np.append(_kinds()[:128], np.zeros(128, np.uint8)).tobytes())), np.uint8)
    wide = np.flatnonzero(data >= 0xC0)
    two, three = wide[data[wide] < 0xE0], wide[(data[wide] >= 0xE0) & (data[wide] < 0xF0)]
    for at, lead, more in ((two, 0x1F, 1), (three, 0x0F, 2)):
        code = (data[at] & lead).astype(np.int32)
        for i in range(1, more + 1):
            code = code << 6 | data[at + i] & 0x3F
        for i in range(more + 1):
            kinds[at + i] = _kinds()[code]
    found = np.frombuffer(bytearray((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(_pairs())), np.uint8)
    after = np.flatnonzero(found == 2)
    found[after] = kinds[after - 1] < _BREAK  # a text begins with a space, so there is one before
    begins = np.append(np.zeros(min(1, len(data)), np.uint8), found)
    begins[starts[:-1]] = 1
    begins = np.flatnonzero(begins)
    units = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), held)
    sizes = np.zeros(len(texts), np.int32)
    sizes[some.to_numpy(zero_copy_only=False)] = np.diff(np.searchsorted(begins, starts))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), units)


def _units(text: str) -> Column:
    """``cut`` as a column."""
    return F.arrow_udf(cut, "array<string>")(text)


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded size."""
    for batch in batches:
        for first, end in chunks([range(n) for n in pc.binary_length(batch.column(column)).fill_null(0).to_pylist()]):
            yield batch.slice(first, end - first)


def _counted(rows: DataFrame) -> DataFrame:
    """unit and n, how often texts hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "_text"):
            found = pc.value_counts(cut(batch.column("_text")).flatten())
            yield pa.RecordBatch.from_arrays(found.flatten(), names=["unit", "n"])

    return rows.select("_text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def hot_from(units: DataFrame) -> int:
    """The least eighth of a binary order of magnitude of n from which units are frequent: those are HOT at most, and HOT_BYTES."""
    found = units.groupBy("_size").agg(F.count("*").alias("k"), F.sum(F.length("unit") * 8 + 100).alias("b")).collect()
    k = b = 0
    least = 1 << 30
    for r in sorted(found, key=lambda r: -r["_size"]):
        k, b = k + r["k"], b + r["b"]
        if k > HOT or b > HOT_BYTES:
            break
        least = r["_size"]
    return least


def _numbered(counted: DataFrame, least: int) -> DataFrame:
    """_u, _hot, unit: small numbers for frequent units, so they take little room in lists."""
    frequent = counted.filter(F.col("_size") >= least)  # HOT at most
    one = frequent.select((F.row_number().over(Window.orderBy(F.desc("n"), "unit")) - 1).cast("long").alias("_u"), F.lit(True).alias("_hot"), "unit")
    two = counted.filter(F.col("_size") < least).select((F.monotonically_increasing_id() + (1 << 40)).alias("_u"), F.lit(False).alias("_hot"), "unit")
    return one.unionByName(two)


def align(docs: DataFrame, a: Callable[[], Encoder], b: Callable[[], Encoder], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row. Text and a space before it is what a and b encode."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias("_key"), F.make_valid_utf8(F.col(f"`{text}`").cast("string")).alias("_text"))
    counted = _counted(rows)
    counted = stored(counted.withColumn("_size", F.floor(F.log2("n") * 8).cast("int")), "counted")
    numbered = stored(_numbered(counted, hot_from(counted)), "numbered")
    forget(counted)
    tokens_of = stored(encoded(numbered, a, b), "encoded")
    aligned = stored(align_units(tokens_of), "aligned")
    forget(tokens_of)
    units = stored(numbered.join(aligned, "_u", "left"), "units")
    forget(numbered)
    forget(aligned)
    frequent = _frequent(units)
    # one after the other, as the shuffles of both take disk
    dealt = stored(_dealt(rows, frequent), "dealt")
    seldom = stored(_rare_of(dealt, units.filter("NOT _hot")), "rare")
    texts = stored(_place(dealt, frequent, seldom), "texts")
    forget(seldom)
    frequent.unpersist()
    counts = stored(_pair_counts(dealt, texts, units), "pairs")
    worth = stored(_worth(units, counts), "worth")
    by = {"count_sum": F.sum("count_sum"), "n_best": F.sum("n_best")}
    one = dealt.select("_row", F.explode("hot").alias("_u")).join(F.broadcast(worth.filter("_hot")), "_u")
    two = texts.select("_row", F.explode("rare").alias("_u")).join(worth.filter("NOT _hot"), "_u")
    sums = [x.groupBy("_row").agg(*(v.alias(k) for k, v in by.items())) for x in (one, two)]
    sums = sums[0].unionByName(sums[1]).groupBy("_row").agg(*(v.alias(k) for k, v in by.items()))
    out = texts.drop("rare").join(sums, "_row", "left").withColumns({c: F.when(F.col("n_links") > 0, F.coalesce(c, F.lit(0))).otherwise(0) for c in by})
    return out.select(F.col("_key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _said() -> tuple[Column, Column]:
    """What a unit says in its document: its groups with the sign that follows them (null if its tokens do not give it back), and n_a."""
    return F.concat("groups", F.lit(";")).alias("said"), F.coalesce("n_a", F.lit(0)).alias("n_a")


def _frequent(units: DataFrame) -> Broadcast:
    """unit, said and n_a of the frequent units, a row's place being its unit's number: HOT and HOT_BYTES at most."""
    return units.sparkSession.sparkContext.broadcast(units.filter("_hot").orderBy("_u").select("unit", *_said()).toArrow())


def _column(table: pa.Table | pa.RecordBatch, name: str, kind: pa.DataType) -> pa.Array:
    found = table.column(name).cast(kind)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _items(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins, and the last one ends, among all items; and the items. A null list has none."""
    return np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())), lists.flatten()


def _dealt(rows: DataFrame, hot: Broadcast) -> DataFrame:
    """_row, _key, hot (the numbers of a text's units in order, null where a unit is rare) and rare (the rare units in order)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _column(hot.value, "unit", pa.string())
        for batch in _parts(batches, "_text"):
            at, units = _items(cut(batch.column("_text")))
            ids = pc.index_in(units, value_set=known)
            before = np.append(0, np.cumsum(ids.is_null().to_numpy(zero_copy_only=False)))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for starts, x in ((at, ids), (before[at], units.filter(ids.is_null())))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_key"), *lists], names=["_row", "_key", "hot", "rare"])

    kept = rows.select("_row", "_key", "_text")
    return kept.mapInArrow(deal, StructType([*kept.drop("_text").schema, *StructType.fromDDL("hot array<int>, rare array<string>")]))


def _rare_of(dealt: DataFrame, rare: DataFrame) -> DataFrame:
    """What rare units give to each document, in order; they are few enough to be dealt by unit."""
    met = dealt.select("_row", F.posexplode("rare").alias("_at", "unit")).join(rare.select("unit", "_u", *_said()), "unit")
    found = met.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_at", "_u", "said", "n_a"))).alias("_l"))
    return found.select("_row", F.col("_l._u").alias("rare"), F.col("_l.said").alias("said"), F.col("_l.n_a").alias("n_a"))


def _told(at: np.ndarray, said: pa.Array, n_a: np.ndarray) -> list[tuple[int, int, int, int, str]]:
    """n_a, n_b, n_groups, n_links and groups_sha256 of documents; the units of one lie from at[i] to at[i + 1]."""
    _, ends, held = said.buffers()
    ends, held = np.frombuffer(ends, np.int64), memoryview(held or b"")
    unknown = np.append(0, np.cumsum(said.is_null().to_numpy(zero_copy_only=False)))
    out = []
    for first, end in pairwise(at.tolist()):
        if first == end or unknown[first] < unknown[end]:
            out.append((0, 0, 0, 0, ""))
            continue
        text = bytes(held[ends[first] : ends[end] - 1])
        # each group says its ids with one sign between its sides and one between ids of a side
        groups, more, a = text.count(b"|"), text.count(b","), int(n_a[first:end].sum())
        out.append((a, more + 2 * groups - a, groups, more + groups, sha256(text).hexdigest()))
    return out


def _place(dealt: DataFrame, hot: Broadcast, seldom: DataFrame) -> DataFrame:
    """Of each document: sums, the digest of its groups, and the rare units that it holds; its frequent ones stay where they are."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_a = _column(hot.value, "said", pa.large_string()), _column(hot.value, "n_a", pa.int64())
        for whole in batches:
            for first, end in chunks([range(n) for n in pc.list_value_length(whole.column("hot")).to_pylist()]):
                batch = whole.slice(first, end - first)
                (at, ids), (_, said), (_, n_a) = (_items(batch.column(c)) for c in ("hot", "said", "n_a"))
                # rare units come behind the frequent ones, and are met in order
                seldom = ids.is_null().to_numpy(zero_copy_only=False)
                places = pa.array(np.where(seldom, len(known) - 1 + np.cumsum(seldom), ids.fill_null(0).to_numpy()))
                said, n_a = (pa.concat_arrays([x, y.cast(x.type)]).take(places) for x, y in ((known, said), (known_a, n_a)))
                told = [pa.array(x, f.type) for x, f in zip(zip(*_told(at, said, n_a.to_numpy()), strict=True), counted, strict=True)]
                yield pa.RecordBatch.from_arrays([*told, *(batch.column(c) for c in kept)], names=[*counted.names, *kept])

    kept, counted = ["_row", "_key", "rare"], pa.schema([*((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
    both = dealt.drop("rare").join(seldom, "_row", "left")
    found = both.mapInArrow(tell, StructType([*StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"), *both.select(*kept).schema]))
    return found.withColumn("rare", F.when(F.col("n_links") > 0, F.col("rare")))


def _once(numbers: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each number once, without sorting. seen: room for as many as there are numbers, whatever it holds."""
    places = np.arange(len(numbers))
    seen[numbers] = places
    return numbers[seen[numbers] == places]


def _pair_counts(dealt: DataFrame, texts: DataFrame, units: DataFrame) -> DataFrame:
    """_link and docs: how many documents hold the pair linked."""
    hot = units.sparkSession.sparkContext.broadcast(units.filter("_hot").orderBy("_u").select(F.coalesce("links", F.array()).alias("links")).toArrow())

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pairs are numbered, those of frequent units once for all documents
        at, links = _items(_column(hot.value, "links", pa.list_(pa.int64())))
        known, links = np.unique(links.to_numpy(), return_inverse=True)
        n, docs = np.diff(at), np.zeros(len(known), np.int64)
        seen = np.empty(len(n), np.int64)
        for batch in batches:
            (starts, ids), (rare_starts, others) = _items(batch.column("hot")), _items(batch.column("links"))
            held, others = ids.fill_null(-1).to_numpy(), others.to_numpy()
            numbers = np.searchsorted(known, others)
            fresh = np.append(known, -1)[numbers] != others
            new, numbers_of = np.unique(others[fresh], return_inverse=True)
            numbers[fresh] = len(known) + numbers_of
            docs_of = np.append(docs, np.zeros(len(new), np.int64))
            met = np.empty(len(docs_of), np.int64)
            for (first, end), (rare_first, rare_end) in zip(pairwise(starts.tolist()), pairwise(rare_starts.tolist()), strict=True):
                of = held[first:end]
                of = _once(of[of >= 0], seen)
                size = n[of]
                places = np.repeat(at[of] - np.cumsum(size) + size, size) + np.arange(size.sum())
                docs_of[_once(np.append(links[places], numbers[rare_first:rare_end]), met)] += 1
            docs = docs_of[: len(known)]
            yield pa.RecordBatch.from_arrays([pa.array(new), pa.array(docs_of[len(known) :])], names=["_link", "docs"])
        yield pa.RecordBatch.from_arrays([pa.array(known[docs > 0]), pa.array(docs[docs > 0])], names=["_link", "docs"])

    rare = units.filter("NOT _hot").select("_u", "links")
    met = texts.select("_row", F.explode("rare").alias("_u")).join(rare, "_u").groupBy("_row").agg(F.flatten(F.collect_list("links")).alias("links"))
    sound = texts.filter("n_links > 0").select("_row").join(met, "_row", "left")
    each = dealt.select("_row", "hot").join(sound, "_row").select("hot", "links").mapInArrow(distinct, "_link long, docs long")
    return each.groupBy("_link").agg(F.sum("docs").alias("docs"))


def _worth(units: DataFrame, counts: DataFrame) -> DataFrame:
    """_u, _hot, count_sum and n_best: what one occurrence of a unit adds to its document."""
    best = counts.groupBy(F.expr(f"_link div {_IDS}").alias("_a")).agg(F.max("docs").alias("_best"))
    ranked = counts.withColumn("_a", F.expr(f"_link div {_IDS}")).join(best, "_a").select("_link", "docs", (F.col("docs") == F.col("_best")).cast("long").alias("_is_best"))
    each = units.select("_u", "_hot", F.explode("links").alias("_link")).join(ranked, "_link")
    return each.groupBy("_u", "_hot").agg(F.sum("docs").alias("count_sum"), F.sum("_is_best").alias("n_best"))
