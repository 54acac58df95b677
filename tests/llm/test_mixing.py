import math
import re

import pytest

from tidemark.llm import mixing, ordered

SCHEMA = "doc_id long, text string, source string, target int, taken string, _place int"


def level(sizes, weights, share, most):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        each = left / sum(w[s] for s in free)
        over = {s for s in free if each * w[s] > most * sizes[s]}
        if not over:
            return out | {s: each * w[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        left, free = left - sum(most * sizes[s] for s in over), free - over
    return out


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def made():
    rows = [(i, f"w{i} " * (1 + i * 37 % 90), f"s{i % 7}" if i % 3 else "hot") for i in range(500)]
    rows += [(None, "no id here\tat all", None), (5, None, "s1"), (6, "", "empty"), (7, "  \n", "empty"), (8, "\U0001f600 x", "\U0001f600"), (9, "a b c", "￿")]
    return rows + [(1000, "same text of five words", "hot")] * 40


@pytest.mark.parametrize("weights, share, most", [((3, 1, 2), 1.5, 2.0), ((1, 50), 1.9, 2.0), ((1,), 0.3, 4.0)])
def test_targets_epochs_and_budgets(spark, monkeypatch, weights, share, most):
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", 60)
    monkeypatch.setattr(ordered, "COPIES", 6)
    rows = made()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = mixing.mix(df.repartition(5), weights=weights, share=share, most=most).collect()
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _ in rows)
    again = mixing.mix(df.repartition(2), weights=weights, share=share, most=most).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    of = {(i, size(t)): s for i, t, s in rows}
    want, taken = level(sizes, weights, share, most), dict.fromkeys(sizes, 0)
    for r in got:
        s = of[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= most * r["size"]
        assert not r["size"] or r.taken // r["size"] in (math.floor(want[s] / sizes[s] + 1e-9), math.floor(want[s] / sizes[s] + 1e-9) + 1)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)


def test_documents_of_quality_are_drawn_more_often(spark):
    rows = [(i, "one two three four", "a") for i in range(4000)]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 1.0) for i in range(4000)] + [(1, None), (3, 0.5)], "doc_id long, quality double")
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), quality, share=0.25).collect()
    good, poor = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (1, 0))
    # of two kinds of equal size, drawn at rates 4 and 1 until a quarter of all is taken: x**4 + x = 1.5 leaves x of the poor
    x = 0.9
    for _ in range(50):
        x -= (x**4 + x - 1.5) / (4 * x**3 + 1)
    assert good + poor == 4000 and abs(poor / 8000 - (1 - x)) < 0.02 and abs(good / 8000 - (1 - x**4)) < 0.02


def test_without_quality_last_and_no_rows(spark):
    rows = [(i, "a b", "s") for i in range(20)]
    quality = spark.createDataFrame([(i, 0.0) for i in range(10)], "doc_id long, quality double")
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), quality, share=0.5).collect()
    assert {r.doc_id: r.taken for r in got} == {i: 0 if i < 10 else 2 for i in range(20)}
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    words = mixing.mix(spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.target, r.taken) for r in words] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), weights=())
