import numpy as np
import pytest

from tidemark.operators import mechanism


def test_steps_over_partitions_are_plain_steps(spark):
    rng = np.random.default_rng(4)
    made = {p: (rng.normal(size=(n, 3)), rng.integers(0, 2, n).astype(float)) for p, n in (("a", 60), ("b", 25))}
    rows = [(p, float(y), x.tolist()) for p, (xs, ys) in made.items() for x, y in zip(xs, ys, strict=True)]
    df = spark.createDataFrame(rows, "probe string, label double, x array<double>").repartition(5).cache()
    got = mechanism.descend(df, steps=4)
    for p, (x, y) in made.items():
        w, b = mechanism.fit_logistic(x, y, 4)
        assert np.allclose(got[p], [*w, b])


def test_probes_on_all_examples(spark):
    """Balanced by the smaller group, a third held out, groups that are apart are told apart."""
    rng = np.random.default_rng(5)
    rows = [(g, layer, f"{g}{i:04d}", (rng.normal(size=4) + shift * layer).tolist()) for g, n, shift in (("x", 90, 1.5), ("y", 60, -1.5), ("z", 1, 0.0)) for layer in (0, 1) for i in range(n)]
    df = spark.createDataFrame(rows, "group string, layer int, example string, vector array<double>").repartition(4)
    got = {(r.comparison, r.layer): r for r in mechanism.wide_probes(df, [("x", "y"), ("x", "z")], steps=8).collect()}
    assert got.keys() == {("x vs y", 0), ("x vs y", 1)}
    for r in got.values():
        assert (r.n_train, r.n_eval) == (84, 36) and 0 <= r.auc <= 1
    assert got["x vs y", 1].auc > 0.99 and got["x vs y", 1].accuracy > 0.95 and got["x vs y", 0].auc < 0.8
    assert pytest.approx(got["x vs y", 0].auc) == {(r.comparison, r.layer): r for r in mechanism.wide_probes(df.repartition(2), [("x", "y")], steps=8).collect()}["x vs y", 0].auc
