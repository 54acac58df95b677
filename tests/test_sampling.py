import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sampling, tables


def area(pairs):
    up, down = [s for l, s in pairs if l == 1], [s for l, s in pairs if l == 0]
    return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down)) if up and down else 0.5


def test_auc_of_heavy_tails(spark, monkeypatch):
    """Scores of which a few are far off, ties, infinities, and groups that miss a class or a name."""
    monkeypatch.setattr(sampling, "sums_before", lambda *a: tables.sums_before(*a, rows_a_range=20))
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 1), rng.choice((rng.random() * 1e-6, rng.lognormvariate(0, 3), 1e300, -1e300, 0.25, float("inf")))) for g in ("a", "b", None) for _ in range(150)] + [("one", 1, 0.5), ("one", 1, 0.7), ("a", 0, None)]
    got = {r.g: r.auc for r in sampling.auc(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s", ["g"]).collect()}
    assert got == {g: pytest.approx(area([(y, s) for h, y, s in rows if h == g and s is not None])) for g in ("a", "b", None, "one")}
    assert sampling.auc(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s").collect()[0].auc == pytest.approx(area([(y, s) for _, y, s in rows if s is not None]))


def test_ranges_hold_about_as_many_rows(spark):
    """One outlier leaves all other values in a thousandth of the span; no range holds more than three times its share."""
    values = [10 ** (i / 3000) for i in range(4000)] + [1e18]
    rows, made = spark.createDataFrame([("g", v, 1) for v in values], "g string, v double, n long"), []

    def store(df, kind):
        made.append(tables.stored(df, kind))
        return made[-1]

    got = tables.sums_before(tables.stored(rows, "rows"), ["g"], [F.col("v")], {"before": "n"}, 250, store).collect()
    assert {r.v: r.before for r in got} == {v: i for i, v in enumerate(sorted(values))}
    sizes = [r["count"] for r in made[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * len(values) / 17


def test_bootstrap_in_parts_is_that_of_one(spark, monkeypatch):
    """The spread of the resampled mean is that of theory, whether a group lies in one part or in forty; ends are the same each time."""
    rng = random.Random(9)
    values = {"a": [rng.gauss(3, 2) for _ in range(400)], None: [rng.choice((0.0, 1.0)) for _ in range(300)], "c": [5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, value double")
    for part in (sampling.PART, 10):
        monkeypatch.setattr(sampling, "PART", part)
        monkeypatch.setattr(sampling, "DRAWN", 40_000 if part == 10 else 4_000_000)
        got = {r.g: r for r in sampling.bootstrap(df, ["g"]).collect()}
        assert sorted(map(str, sampling.bootstrap(df, ["g"]).collect())) == sorted(map(str, got.values()))
        assert got["c"][1:] == (1, 5.0, 5.0, 5.0) and len(got) == 3
        for g in ("a", None):
            n, mean = len(values[g]), statistics.fmean(values[g])
            error = 1.96 * np.std(values[g]) / n**0.5
            assert got[g].n == n and got[g].mean == pytest.approx(mean)
            assert got[g].ci_low == pytest.approx(mean - error, abs=0.15 * error) and got[g].ci_high == pytest.approx(mean + error, abs=0.15 * error)
    (one,) = sampling.bootstrap(df.select("value"), [], rounds=200, last=True).collect()
    assert one.n == 701 and one.ci_low < one.mean < one.ci_high
