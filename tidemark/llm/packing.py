"""Packing by minimum bin slack.

Documents are cut at multiples of the window from their start: full windows stand alone, and each document leaves one
remaining piece.  Remaining pieces are packed by groups of some thousand documents, dealt by a hash of the row: a window
takes the largest piece left and the multiset of others that comes closest to the capacity, found by subset sums in the
bits of one integer, with the counts read back from the stored bits.  A multiset is used as often as the counts allow.

Cuts lie where they lie whatever the packing, so ids are made once and never moved: only (id, start, length, CRC) is
shuffled.  Padding is at most one partly filled window a group beyond what exact sums leave.

Defined cases: null text is empty (one piece with the end id); documents of equal or null id are packed separately by
row; an empty table gives no rows; other columns are ignored.  A long document costs memory of its own ids only.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import chunks, stored
from tidemark.llm.word_ids import word_ids

DOCS_A_GROUP = 16_384
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                out: list[list] = [[], [], [], [], []]
                for doc, got in zip(ids[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    got += end
                    n = len(got) // 4
                    for start in range(0, n, capacity):
                        part = got[4 * start : 4 * (start + capacity)]
                        for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, _PIECES)


def fill(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Multisets of lengths with how often each is used, until counts is empty."""
    lengths = sorted(n for n, c in counts.items() if c)
    left = dict(counts)
    while lengths:
        largest = lengths[-1]
        target = capacity - largest
        mask, goal = (1 << (target + 1)) - 1, 1 << target
        reach, steps = 1, []
        for k in range(bisect_right(lengths, target) - 1, -1, -1):
            if reach & goal:
                break
            n = lengths[k]
            steps.append((n, reach))
            for _ in range(min(left[n] - (n == largest), target // n)):
                more = (reach | reach << n) & mask
                if more == reach:
                    break
                reach = more
        total = reach.bit_length() - 1
        chosen = {largest: 1}
        for n, before in reversed(steps):
            while not before >> total & 1:
                chosen[n] = chosen.get(n, 0) + 1
                total -= n
        times = min(left[n] // c for n, c in chosen.items())
        yield chosen, times
        for n, c in chosen.items():
            left[n] -= c * times
            if not left[n]:
                lengths.remove(n)


def pack(pieces: DataFrame, capacity: int = 4096, docs_a_group: int = DOCS_A_GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most capacity ids. pieces: a written table, so that rows have their places again if a task is."""
    groups = -(-pieces.count() // docs_a_group) or 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, base, held = None, 0, []

        def packed() -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(held).combine_chunks().drop_columns(["_group"])
            lengths = block.column("length").to_pylist()
            rows: dict[int, list[int]] = {}
            for i, n in enumerate(lengths):
                rows.setdefault(n, []).append(i)
            sequence, offset, number = [0] * len(lengths), [0] * len(lengths), group << 32
            for chosen, times in fill({n: len(x) for n, x in rows.items()}, capacity):
                for _ in range(times):
                    at = 0
                    for n, c in chosen.items():
                        for _ in range(c):
                            i = rows[n].pop()
                            sequence[i], offset[i] = number, at
                            at += n
                    number += 1
            block = block.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from block.to_batches()

        for batch in batches:
            at = 0
            marks = batch.column("_group").to_pylist()
            while at < len(marks):
                if group is None or marks[at] != group:
                    if held:
                        yield from packed()
                    group, held = marks[at], []
                end = bisect_right(marks, group, at)
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from packed()

    # by the place of the piece in its table, so that pieces that are alike in all columns lie in all groups
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    ordered = dealt.repartition(groups, "_group").sortWithinPartitions("_group", "doc_id", "start", "ids_crc32")
    return ordered.mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Pieces of all documents with their sequences. sequence_id: the group in the high 32 bits."""
    return pack(stored(cut(docs, tokenizer, end_id, capacity), "pieces"), capacity)
