"""Connected components by alternating large and small stars (Kiveris et al., 2014), with trees of what lies together.

Defined cases: edges from a node to itself and edges with a null end tell nothing; repeated edges count once; without edges
there are no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import LEAST_FILES, ROWS_A_FILE, forget, stored

#: Nodes with more neighbours are hubs, of which there are at most HUBS (the bound rises with the edges): 16 bytes each are broadcast.
NEIGHBOURS, HUBS = 1000, 100_000
#: Edges that a task holds.
HELD = 500_000


def roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of m places reaches by the pairs (i, j)."""
    label = np.arange(m)
    while True:
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        new = label.copy()
        for root in (a, b):  # roots alone move, so what points to one stays with it
            np.minimum.at(new, root, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]


def tree(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that it reaches by edges u, v."""
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = roots(len(names), place[: len(u)], place[len(u) :])
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def grown() -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(held)
        held.clear()
        u, v = tree(both["u"].to_numpy(), both["v"].to_numpy())
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= HELD:
            yield from grown()
    if held:
        yield from grown()


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """u, v, m: edges with the least neighbour or own id of u. Edges of hubs are not dealt by u."""
    if least.filter(F.col("n") > hub).isEmpty():
        return edges.join(least.drop("n"), "u")
    few, hubs = least.filter(F.col("n") <= hub).drop("n"), least.filter(F.col("n") > hub).drop("n")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(few, "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (u long, v long); label: the smallest node that it reaches.

    Each round is grouped minima and joins, after which trees replace the edges of a task; it is written to the shared folder,
    where the round before is then removed. The number of rounds grows with the logarithm of the number of nodes at most. No
    node's neighbours are gathered in a row or a task: trees leave each node one smaller neighbour a task, and hubs are joined by a broadcast.
    """
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        moved = _with_least(both.filter("v > u"), least, max(NEIGHBOURS, 2 * state[0] // HUBS))
        large = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = down.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
        tasks = max(LEAST_FILES, -(-state[0] // ROWS_A_FILE))
        before, e = e, stored(small.coalesce(tasks).mapInArrow(_trees, "u long, v long"), "edges")
        forget(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
