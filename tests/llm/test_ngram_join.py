import random
import sys
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_join
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, n_links string, sig long"


def brute(rows, n, least):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if least.denominator * common >= least.numerator * (len(sets[a]) + len(sets[b]) - common):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i)) for i in ids)


def family(rng, size, copies, rate, start):
    base = [f"w{rng.randrange(3000)}" for _ in range(size)]
    out = []
    for k in range(copies):
        own = [w if rng.random() > rate * rng.random() else f"x{rng.randrange(10**6)}" for w in base]
        out.append((start + k, " ".join(own)))
    return out


@pytest.mark.parametrize(("n", "least"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_components_equal_brute_force(spark, n, least, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 20 if n == 3 else 1000)
    rng = random.Random(5)
    rows = [(-3, None), (-2, ""), (-1, " \t "), (1, "One"), (2, "one"), (3, "one two"), (4, "a b c"), (5, "A b\nc"), (6, "c b a")]
    for k, (size, copies, rate) in enumerate([(8, 20, 0.1), (15, 30, 0.1), (40, 30, 0.06), (150, 60, 0.04), (400, 40, 0.05), (2500, 6, 0.03)]):
        rows += family(rng, size, copies, rate, 1000 * (k + 1))
    rows += [(9000 + k, "same words every time in this text") for k in range(30)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = ngram_join.similar_documents(df, n, least)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, n, least)


def test_empty_table_and_null_ids(spark):
    assert ngram_join.similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "some text that two rows have"), (7, "some text that two rows have"), (None, None)]
    got = ngram_join.similar_documents(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 7), (7, 7)]


@pytest.mark.parametrize(("n2", "k2"), [(2, 1), (3, 1), (4, 2)])
def test_every_linked_pair_shares_a_signature(n2, k2):
    rng = np.random.default_rng(1)
    for least in (Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)):
        bands, checked = ngram_join.Bands(least), 0
        for size in (1, 2, 3, 5, 9, 12, 20, 33, 70, 200, 900, 4000):
            for _ in range(40):
                base = rng.integers(0, 2**63, size * 2, dtype=np.uint64)
                a, b = base[:size], base[int(size * (1 - least) * rng.random()) :][:size]
                b = b[: size - rng.integers(0, 2)]
                a, b = np.unique(a), np.unique(b)
                common = len(np.intersect1d(a, b))
                if least.denominator * common >= least.numerator * (len(a) + len(b) - common) and not np.array_equal(a, b):
                    checked += 1
                    x, y = ngram_join.signatures([a, b], bands, n2, k2)
                    assert len(np.intersect1d(x, y))
        assert checked > 50


@pytest.mark.parametrize("neighbours", [2, 1000])
def test_components(spark, neighbours, monkeypatch):
    monkeypatch.setattr(sys.modules[components.__module__], "NEIGHBOURS", neighbours)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (5, 5), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102), 100)
    odd = spark.createDataFrame([(1, None), (None, 2), (3, 4), (3, 4), (4, 3), (9, 9)], "u long, v long").withColumns({"node": F.lit("x"), "m": F.lit(1)})
    assert sorted((r.node, r.label) for r in components(odd).collect()) == [(3, 3), (4, 3)]
    assert components(spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))).count() == 0


def test_words_that_polynomials_confuse(spark):
    one = "".join("ab"[k.bit_count() & 1] for k in range(4096))
    words = [w for size in (16, 2048, 4096) for w in (one[:size], one[:size].translate(str.maketrans("ab", "ba")))]
    rows = [(k, f"{w} and then some more words follow here", "x", 1) for k, w in enumerate(words)] + [(100 + k, w, "x", 1) for k, w in enumerate(words)]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, SCHEMA), 3, Fraction(9, 10)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, Fraction(9, 10))
