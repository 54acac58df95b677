import math
import random

from pyspark.sql import functions as F

from tidemark.llm import knn_join
from tidemark.llm.knn_join import nearest_join

SCHEMA = "vec_id long, embedding array<double>, rank int, cell string"


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in good if i % 50 == 0}):
        (q,) = {tuple(v) for j, v in good if j == i}
        top = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(top)]
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, nearest_join(df, F.col("vec_id") % 50 == 0, k).collect()))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "PIVOTS", 16)
    monkeypatch.setattr(knn_join, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(knn_join, "SLICE_ROWS", 200)
    rng = random.Random(1)
    hot = [0.5, -0.25, 1.0, 0.0]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 1) + 3 * (i % 4 == k) for k in range(4)]) for i in range(900)]
    rows += [(1000, None), (1001, [0.1, None, 0.2, 0.3]), (1050, [math.nan] * 4), (1003, [math.inf] * 4), (None, hot), (1100, [1.0]), (1005, [1.0, 2.0]), (1006, [1.0, 2.0]), (1006, [1.0, 2.0]), (1150, [-0.0] * 4), (1200, [])]
    assert run(spark, rows) == brute(rows, 5)


def test_repeated_rows_of_a_hot_vector(spark):
    hot, low = [1.0, 2.0], [0.5, 0.25]
    twice = [(i, hot) for i in range(50, 61)] * 2 + [(i, low) for i in range(1, 9)]
    assert run(spark, twice) == brute(twice, 5)
    often = [(50, hot)] * 6 + [(i, hot) for i in range(51, 61)] + [(100, low)] * 9 + [(i, low) for i in range(1, 9)]
    assert run(spark, often) == brute(often, 5)
    one = [(50, hot), (100, hot)] + [(7, hot)] * 9 + [(8, hot)]
    assert run(spark, one) == brute(one, 5)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (3, [2.0])]) == brute([(0, [1.0]), (3, [2.0])], 5)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e6 + i / 256, 1e6]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 5)


def test_clustered_data_is_pruned(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "PIVOTS", 64)
    monkeypatch.setattr(knn_join, "BLOCK_QUERIES", 4)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.05) + (j == i % 8) * 4 for j in range(8)]) for i in range(1600)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    data, _, cells, blocks, _, _, width = knn_join.voronoi(df, F.col("vec_id") % 50 == 0, 5)
    held = data.toArrow()
    x = knn_join._matrix(held.column("v").combine_chunks(), width)
    need = cells.needed(x, held.column("cell").to_numpy())
    assert need.mean() < 0.3 and len(blocks) > 1
    assert sum(need[:, b].any(1).mean() for b in blocks) / len(blocks) < 0.5
    assert run(spark, rows) == brute(rows, 5)
