"""Exact top-k by integer inner product, as a Voronoi join.

Queries and data are grouped by their nearest pivot.  A data cell's summary has its number of rows, its largest distance
from the pivot and its largest and smallest norm; a query cell's has its number, radius, widest angle, norms, and a bound t
that the k-th best score of each of its queries reaches for sure, from the scores of the pivots, which are rows.  A pair of
cells whose best possible score by the summaries stays below t is out; of the pairs left a data row x goes to a query cell
only if ``<p, x> + r |x|`` and the angular bound ``|q| |x| cos(angle(p, x) - widest angle)`` both reach t.  Query cells that
are near to each other travel in blocks: a row is copied once for each block with a cell that needs it, and in the block
each cell scores only rows that it needs itself.  Blocks are solved in slices of bounded size, as many as their own cells'
rows ask for, and the slices' best rows are merged.

Vectors without structure leave nothing to prune: then each row goes to each block, of ``BLOCK_QUERIES`` queries.

Equal vectors score alike, so of each only the k+1 smallest distinct ids are candidates, with at most k rows of each: a
query passes over one id, its own.  The result is the same, and a vector that a third of the rows share costs k(k+1) rows
at most.  Bounds are taken with a margin above the rounding of doubles; scores are exact.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; shorter vectors count as zero
beyond their end; ties go to the smaller id; rows with the query's id are never its candidates; repeated rows count each
as candidates and once as a query; rows without an id take no part; with fewer than k candidates all are returned; a
score beyond 64 bits is an error; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import stored

#: Bounds: pivots (held by every task), queries of a group's block, and data rows of a slice.
PIVOTS, BLOCK_QUERIES, SLICE_ROWS = 256, 4096, 32_768
_EXACT = float(1 << 53)


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors that take part."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(column), width).astype(float)
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; by 64-bit or by Python's integers where doubles could round."""
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] if q.size and x.size else 0.0
    if most < _EXACT:
        return q @ x.T
    q, x = q.astype(np.int64), x.astype(np.int64)
    return q @ x.T if most < 2.0**62 else q.astype(object) @ x.astype(object).T


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of each query's k best, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    for lo in range(0, len(q), 128):
        for j, s in enumerate(scores_of(q[lo : lo + 128], x), lo):
            other = np.flatnonzero(ids != q_ids[j])
            s = s[other]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                keep = np.flatnonzero(s >= least)
            else:
                keep = np.arange(len(s))
            for i in sorted(keep, key=lambda i: (-s[i], i))[:k]:
                yield int(q_ids[j]), int(ids[other[i]]), int(s[i])


class Cell(NamedTuple):
    """Summary of a cell of data (sure is not used) or of queries."""

    pivot: int
    rows: int
    away: float
    angle: float
    least_norm: float
    most_norm: float
    sure: float


def _cosine(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """1 where a norm is 0."""
    return np.clip(np.divide(dots, norms, out=np.ones_like(dots), where=norms > 0), -1, 1)


def _widened(most: np.ndarray) -> np.ndarray:
    """A margin above the rounding of doubles."""
    return most + np.abs(most) * 1e-9 + 1


class Cells:
    """What data the cells of queries need."""

    def __init__(self, pivots: np.ndarray, queries: Sequence[Cell], data: Sequence[Cell]) -> None:
        self._pivots = pivots[[c.pivot for c in queries]]
        self._norm = np.sqrt((self._pivots**2).sum(1))
        columns = [np.array([getattr(c, name) for c in queries], float) for name in ("away", "angle", "least_norm", "most_norm", "sure")]
        self._away, self._angle, self._low, self._high, self._sure = columns
        self.numbers = {c.pivot: g for g, c in enumerate(queries)}
        #: Pairs of a data cell's pivot and a query cell that the summaries leave.
        self.pairs = np.zeros((len(pivots), len(queries)), bool)
        for c in data:
            dots = self._pivots @ pivots[c.pivot]
            most = dots + self._norm * c.away + self._away * c.most_norm
            by_angle = self._by_angle(_cosine(dots, self._norm * np.sqrt((pivots[c.pivot] ** 2).sum())), self._angle + c.angle, c.least_norm, c.most_norm)
            self.pairs[c.pivot] = _widened(np.minimum(most, by_angle)) >= self._sure

    def _by_angle(self, cosine: np.ndarray, widest: np.ndarray, least: np.ndarray | float, most: np.ndarray | float) -> np.ndarray:
        """The best product of norms in these bounds whose directions' cosine may grow by an angle."""
        widest = np.minimum(widest + 1e-7, np.pi)
        grown = np.where(cosine >= np.cos(widest), 1.0, cosine * np.cos(widest) + np.sqrt(1 - cosine * cosine) * np.sin(widest))
        return grown * np.where(grown > 0, self._high * most, self._low * least)

    def needed(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Rows by query cells."""
        dots = x @ self._pivots.T
        norm = np.sqrt((x**2).sum(1))[:, None]
        most = np.minimum(dots + norm * self._away, self._by_angle(_cosine(dots, norm * self._norm), self._angle, norm, norm))
        return self.pairs[cell] & (_widened(most) >= self._sure)

    def blocks(self, rows: Sequence[int], limit: int) -> list[list[int]]:
        """Query cells in blocks of about limit queries, each cell beside the nearest one left; a larger cell is alone."""
        left, out, size = set(range(len(rows))), [], limit + 1
        at = 0
        while left:
            if size + rows[at] > limit:
                out.append([])
                size = 0
            out[-1].append(at)
            size += rows[at]
            left.remove(at)
            if left:
                rest = np.array(sorted(left))
                at = int(rest[((self._pivots[rest] - self._pivots[at]) ** 2).sum(1).argmin()])
        return out


def _summaries(grouped: DataFrame) -> list[Cell]:
    """At most one a pivot."""
    of = grouped.groupBy("cell").agg(F.count("*").alias("rows"), F.max("away").alias("away"), F.max("angle").alias("angle"), F.min("norm").alias("least_norm"), F.max("norm").alias("most_norm"), F.min("sure").alias("sure"))
    return [Cell(r.cell, r.rows, r.away, r.angle, r.least_norm, r.most_norm, r.sure) for r in of.orderBy("cell").collect()]


def nearest_join(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for rows (vec_id, embedding)."""
    result = "query_id long, rank int, vec_id long, score long"
    found = voronoi(rows, is_query, k)
    if found is None:
        return rows.sparkSession.createDataFrame([], result)
    data, asked, cells, blocks, parts, slices, width = found
    block_of = {g: b for b, of in enumerate(blocks) for g in of}

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the blocks that may need it."""
        for batch in batches:
            need = cells.needed(_matrix(batch.column("v"), width), batch.column("cell").to_numpy())
            ids = batch.column("vec_id").to_numpy()
            for b, of in enumerate(blocks):
                at = np.flatnonzero(need[:, of].any(1))
                for part in range(parts[b] if len(at) else 0):
                    take = batch.select(["vec_id", "v", "cell"]).take(pa.array(at))
                    own = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slices[b])
                    yield pa.record_batch([*take.columns, pa.array(np.full(len(at), b, np.int32)), pa.array(np.full(len(at), part, np.int32)), pa.array(own.astype(np.int32))], names=["vec_id", "v", "cell", *key])

    key = ["block", "part", "slice"]
    copies = data.mapInArrow(replicated, "vec_id long, v array<long>, cell int, block int, part int, slice int")
    # bounded by the pivots
    which = rows.sparkSession.createDataFrame([(p, block_of[g], parts[block_of[g]], slices[block_of[g]]) for p, g in cells.numbers.items()], "cell int, block int, parts int, slices int")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    dealt = asked.join(F.broadcast(which), "cell").select("vec_id", "v", "cell", "block", part, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            q, x = (_matrix(t.column("v").combine_chunks(), width) for t in (left, right))
            q_ids, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            need = cells.needed(x, right.column("cell").to_numpy())
            of = left.column("cell").to_numpy()
            for cell in np.unique(of).tolist():
                mine, rows = of == cell, need[:, cells.numbers[cell]]
                found += best(q_ids[mine], q[mine], ids[rows], x[rows], k)
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    local = dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(solve, "query_id long, vec_id long, score long")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def voronoi(rows: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame, Cells, list[list[int]], list[int], list[int], int] | None:
    """Data and queries with their cells, what query cells need, and the blocks of query cells, with the parts of each block's queries and the slices of its rows."""
    vectors = integer_vectors(rows)
    count, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    # a sample of bounded size; any pivots give exact results
    share = min(1.0, 1.5 * PIVOTS / max(count, 1))
    hashed = vectors.withColumn("h", F.xxhash64("vec_id", "v")).filter(F.col("h") <= min(int(-(2**63) + share * 2**64), 2**63 - 1))
    sample = hashed.orderBy("h", "vec_id").limit(PIVOTS).select("vec_id", "v").collect()
    if not sample:
        return None
    pivots = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        pivots[i, : len(r.v)] = r.v
    pivot_ids = np.array([r.vec_id for r in sample])
    norms = (pivots**2).sum(1)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell, where in it the row lies, and a score that the k-th best surely reaches."""
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            dots = x @ pivots.T
            norm = np.sqrt((x**2).sum(1))
            own = np.maximum((norm**2)[:, None] - 2 * dots + norms, 0)
            cell = own.argmin(1) if len(x) else np.zeros(0, int)
            row = np.arange(len(x))
            away, angle = np.sqrt(own[row, cell]), np.arccos(_cosine(dots[row, cell], norm * np.sqrt(norms[cell])))
            dots[batch.column("vec_id").to_numpy()[:, None] == pivot_ids] = -np.inf
            sure = np.partition(dots, -k, axis=1)[:, -k] if dots.shape[1] >= k else np.full(len(x), -np.inf)
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(angle), pa.array(norm), pa.array(sure)], names=["vec_id", "v", "cell", "away", "angle", "norm", "sure"])

    kind = "vec_id long, v array<long>, cell int, away double, angle double, norm double, sure double"
    of = Window.partitionBy("v").orderBy("vec_id")
    ids = vectors.groupBy("v", "vec_id").agg(F.count("*").alias("_rows")).withColumn("_n", F.row_number().over(of)).filter(F.col("_n") <= k + 1)
    kept = ids.select("vec_id", "v", F.explode(F.array_repeat(F.lit(0), F.least("_rows", F.lit(k)).cast("int"))).alias("_")).drop("_")
    data = stored(kept.mapInArrow(measured, kind), "vectors")
    asked = stored(vectors.filter(is_query).dropDuplicates(["vec_id", "v"]).mapInArrow(measured, kind), "queries")
    of_data, of_queries = _summaries(data), _summaries(asked)
    if not of_queries:
        return None
    cells = Cells(pivots, of_queries, of_data)
    blocks = cells.blocks([c.rows for c in of_queries], BLOCK_QUERIES)
    parts = [max(1, -(-sum(of_queries[g].rows for g in b) // BLOCK_QUERIES)) for b in blocks]
    slices = [max(1, -(-sum(c.rows for c in of_data if cells.pairs[c.pivot, b].any()) // SLICE_ROWS)) for b in blocks]
    return data, asked, cells, blocks, parts, slices, width
