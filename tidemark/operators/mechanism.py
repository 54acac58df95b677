"""Activations by group: probes, mean ablation, patching, residual directions, attribution to layers.

Activations are long rows (group, layer, site, example, vector), or matrices (array of arrays) beside the task they belong to;
what scores them is linear in the layers, so every intervention is an expression.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import dot
from tidemark.operators.sampling import auc
from tidemark.operators.tables import stored, sums_before

#: Pairs of groups that probes tell apart.
COMPARISONS = (("success_low_cue_member", "fail_low_cue_member"), ("success_low_cue_member", "low_cue_nonmember"), ("success_low_cue_member", "success_high_cue_member"))


def group_label(band: Column, membership: Column, success: Column) -> Column:
    """The analysis group of a task; null for all others."""
    low = band == "low"
    return (
        F.when(low & (membership == "member"), F.when(success, "success_low_cue_member").otherwise("fail_low_cue_member"))
        .when((band == "high") & (membership == "member") & success, "success_high_cue_member")
        .when(low & (membership == "nonmember"), "low_cue_nonmember")
    )


def head(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def mean_vectors(rows: DataFrame, by: Sequence[str], vector: str = "vector") -> DataFrame:
    """by, vector: the elementwise mean; sums are formed before rows of a group meet."""
    long = rows.select(*by, F.posexplode(vector).alias("_i", "_x"))
    means = long.groupBy(*by, "_i").agg(F.avg("_x").alias("_m"))
    sorted_means = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(*by).agg(F.transform(sorted_means, lambda s: s["_m"]).alias(vector))


def standardized(rows: DataFrame, by: Sequence[str], value: str, train: Column | None = None, floor: float = 1e-6) -> DataFrame:
    """Adds z by the mean and population deviation of the group's training rows."""
    used = F.col(value) if train is None else F.when(train, F.col(value))
    stats = rows.groupBy(*by).agg(F.avg(used).alias("_m"), F.greatest(F.stddev_pop(used), F.lit(floor)).alias("_s"))
    return rows.join(stats, list(by)).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.2, decay: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias by plain gradient steps; the bias is not decayed."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps if len(x) else 0):
        error = 1 / (1 + np.exp(-np.clip(x @ w + b, -500, 500))) - y
        w, b = w - rate * (x.T @ error / len(x) + decay * w), b - rate * error.mean()
    return w, float(b)


def area(y: np.ndarray, s: np.ndarray) -> float:
    p, n = int((y == 1).sum()), int((y == 0).sum())
    if not p or not n:
        return 0.5
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return float((rank[y == 1].sum() - p * (p + 1) / 2) / (p * n))


_PROBE = "comparison string, layer int, n_train int, n_eval int, auc double, accuracy double"


def probes(rows: DataFrame, comparisons: Sequence[tuple[str, str]] = COMPARISONS, fraction: float = 0.3, seed: int = 7, least: int = 2, most: int = 500) -> DataFrame:
    """A linear probe for each comparison and layer, on equally many examples of both groups, the first most of each by example.

    A task holds 2 * most vectors.  Comparisons with too few examples give no row.
    """
    rows = head(rows, ["group", "layer"], ["example"], most)
    names = rows.sparkSession.createDataFrame([(f"{a} vs {b}", g, int(g == a)) for a, b in comparisons for g in (a, b)], "comparison string, group string, label int")
    labelled = rows.join(F.broadcast(names), "group").select("comparison", "layer", "label", "example", F.col("vector").cast("array<double>").alias("vector"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _PROBE.split(", ")]
        group = group.sort_values("example")
        sides = [np.array(group[group.label == k].vector.tolist(), float) for k in (1, 0)]
        n = min(map(len, sides))
        if n < max(2, least):
            return pd.DataFrame([], columns=columns)
        rng = np.random.default_rng(seed)
        held = min(max(1, round(n * fraction)), n - 1)
        order = [rng.permutation(n) for _ in sides]
        train, test = (np.concatenate([s[:n][o[sl]] for s, o in zip(sides, order, strict=True)]) for sl in (slice(held, None), slice(0, held)))
        y_train, y_test = (np.repeat([1.0, 0.0], k) for k in (n - held, held))
        m, s = train.mean(0), np.maximum(train.std(0), 1e-6)
        w, b = fit_logistic((train - m) / s, y_train)
        logits = (test - m) / s @ w + b
        return pd.DataFrame([(group.comparison.iloc[0], int(group.layer.iloc[0]), len(train), len(test), area(y_test, logits), float(((logits >= 0) == (y_test == 1)).mean()))], columns=columns)

    return labelled.groupBy("comparison", "layer").applyInPandas(fit, _PROBE)


def descend(rows: DataFrame, steps: int = 300, rate: float = 0.2, decay: float = 0.01) -> dict[str, np.ndarray]:
    """Weights of the logistic regression of each probe (column probe), the bias last, by the steps of ``fit_logistic`` over rows of any number.

    rows: a stored table of probe, label and x (array<double>).  A step is one pass: a task sums the gradients of its rows, by probe,
    and the sums meet by probe and dimension; the weights of all probes, which the driver holds, go out with the next step.
    """
    sizes = {r.probe: (r.n, r.d) for r in rows.groupBy("probe").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()}
    weights = {p: np.zeros(d + 1) for p, (_, d) in sizes.items()}
    for _ in range(steps):

        def partial(batches: Iterator[pa.RecordBatch], now: dict[str, np.ndarray] = weights) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                probe, y = np.array(batch.column("probe").to_pylist(), object), batch.column("label").to_numpy(zero_copy_only=False)
                for p in set(probe):
                    mine = np.flatnonzero(probe == p)
                    x = np.concatenate([np.array(batch.column("x").take(pa.array(mine)).to_pylist(), float), np.ones((len(mine), 1))], 1)
                    error = 1 / (1 + np.exp(-np.clip(x @ now[p], -500, 500))) - y[mine]
                    sums[p] = sums.get(p, 0.0) + x.T @ error
            yield pa.RecordBatch.from_pydict({"probe": list(sums), "g": [g.tolist() for g in sums.values()]}, pa.schema([("probe", pa.string()), ("g", pa.list_(pa.float64()))]))

        parts = rows.select("probe", "label", "x").mapInArrow(partial, "probe string, g array<double>")
        found = parts.select("probe", F.posexplode("g").alias("i", "v")).groupBy("probe", "i").agg(F.sum("v").alias("v")).collect()  # a number a probe and dimension
        gradient = {p: np.zeros(len(w)) for p, w in weights.items()}
        for r in found:
            gradient[r.probe][r.i] = r.v
        # the bias is not decayed
        weights = {p: w - rate * (gradient[p] / sizes[p][0] + decay * np.append(w[:-1], 0.0)) for p, w in weights.items()}
    return weights


def wide_probes(rows: DataFrame, comparisons: Sequence[tuple[str, str]] = COMPARISONS, fraction: float = 0.3, seed: int = 7, least: int = 2, steps: int = 300) -> DataFrame:
    """The probes of ``probes`` on all examples, as many of both groups as the smaller one has, without a task that holds a probe's examples.

    Examples are held out in a seeded order of their ids.
    """
    names = rows.sparkSession.createDataFrame([(f"{a} vs {b}", g, int(g == a)) for a, b in comparisons for g in (a, b)], "comparison string, group string, label int")
    labelled = rows.join(F.broadcast(names), "group").select("comparison", "layer", "label", F.col("example").cast("string").alias("example"), F.col("vector").cast("array<double>").alias("vector"))
    labelled = labelled.withColumns({"probe": F.concat_ws("/", "comparison", "layer"), "_one": F.lit(1).cast("long"), "_order": F.sha2(F.concat_ws(":", F.lit(str(seed)), "example"), 256)})
    labelled = stored(labelled.withColumn("_side", F.concat_ws("/", "probe", "label")), "labelled")
    n = labelled.groupBy("probe").agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("_n")).filter(F.col("_n") >= max(2, least))
    n = n.withColumn("_held", F.least(F.greatest(F.lit(1), F.round(F.col("_n") * fraction)), F.col("_n") - 1).cast("long"))
    first = sums_before(labelled.select("_side", "example", "probe", "_one", "_order"), ["_side"], [F.col("example")], {"_at": "_one"}).join(n, "probe").filter("_at < _n").drop("_at")
    placed = sums_before(stored(first, "balanced"), ["_side"], [F.col("_order"), F.col("example")], {"_at": "_one"})
    split = stored(labelled.join(placed.select("_side", "example", (F.col("_at") < F.col("_held")).alias("_test")), ["_side", "example"]), "split")
    train = split.filter("NOT _test")
    each = train.select("probe", F.posexplode("vector").alias("_i", "_x")).groupBy("probe", "_i").agg(F.avg("_x").alias("m"), F.greatest(F.stddev_pop("_x"), F.lit(1e-6)).alias("s"))
    shape = each.groupBy("probe").agg(F.sort_array(F.collect_list(F.struct("_i", "m", "s"))).alias("_shape"))
    scaled = split.join(shape, "probe").withColumn("x", F.zip_with("vector", "_shape", lambda x, m: (x - m["m"]) / m["s"])).drop("vector", "_shape")
    scaled = stored(scaled.select("comparison", "layer", "probe", "label", "x", "_test"), "scaled")
    weights = descend(scaled.filter("NOT _test"), steps)
    schema = "probe string, w array<double>, b double"
    table = rows.sparkSession.createDataFrame([(p, w[:-1].tolist(), float(w[-1])) for p, w in weights.items()], schema)
    tested = stored(scaled.filter("_test").join(F.broadcast(table), "probe").withColumn("logit", dot(F.col("x"), F.col("w")) + F.col("b")), "tested")
    sizes = scaled.groupBy("comparison", "layer").agg(F.count_if(~F.col("_test")).alias("n_train"), F.count_if(F.col("_test")).alias("n_eval"))
    right = tested.groupBy("comparison", "layer").agg(F.avg(((F.col("logit") >= 0) == (F.col("label") == 1)).cast("double")).alias("accuracy"))
    return sizes.join(auc(tested, "label", "logit", ["comparison", "layer"]), ["comparison", "layer"]).join(right, ["comparison", "layer"])


def layer_ranking(results: DataFrame) -> DataFrame:
    """Layers by mean area, the best first, ties to the lower layer."""
    means = results.groupBy("layer").agg(F.avg("auc").alias("mean_auc"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_auc"), "layer")))


def random_layers(count: int, k: int, seed: int) -> list[int]:
    """k layers of count, drawn by a hash of seed and layer."""
    return sorted(range(count), key=lambda n: hashlib.sha256(f"{seed}:{n}".encode()).hexdigest())[:k]


def layer_contributions(matrix: Column, weights: Column) -> Column:
    return F.transform(matrix, lambda v: dot(v, weights))


def replaced(matrix: Column, other: Column, layers: Sequence[int]) -> Column:
    """The matrix with the other one's layers (from 0) put in."""
    return F.transform(matrix, lambda v, i: F.when(i.isin(*layers), F.get(other, i)).otherwise(v))


def moved(matrix: Column, direction: Column, alpha: Column) -> Column:
    """The matrix less alpha times a direction."""
    return F.zip_with(matrix, direction, lambda a, d: F.zip_with(a, d, lambda x, y: x - alpha * y))


def mean_matrix(rows: DataFrame, matrix: str = "activations") -> DataFrame:
    """One row: the elementwise mean of all matrices."""
    layers = rows.select(F.posexplode(matrix).alias("_layer", "vector"))
    means = mean_vectors(layers, ["_layer"])
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("_layer", "vector"))), lambda s: s["vector"]).alias("mean"))


def paired(source: DataFrame, target: DataFrame, control: DataFrame, order: str = "task_id", most: int = 25) -> DataFrame:
    """pair, source, target, control: the i-th source and target, and the control at i modulo their number; most pairs at most.

    The number of pairs is the feature's own limit: an intervention is done on so many.  Without controls control is null.
    """

    def first(rows: DataFrame, name: str) -> DataFrame:
        top = rows.orderBy(order).limit(most)
        return top.select(F.struct(*rows.columns).alias(name), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).alias("_i"))

    both = first(source, "source").join(first(target, "target"), "_i")
    c = first(control, "control")
    n = c.agg(F.count("*").alias("_n"))
    both = both.crossJoin(F.broadcast(n)).withColumn("_j", F.when(F.col("_n") > 0, F.pmod(F.col("_i"), F.col("_n"))))
    return both.join(c.withColumnRenamed("_i", "_j"), "_j", "left").select(F.col("_i").alias("pair"), "source", "target", "control")


def analysis_pairs(tasks: DataFrame, most: int = 25) -> DataFrame:
    """Pairs for patching of tasks (task_id, cue_band, is_member, any_sensitive_match, …): successful low-cue members as sources, failed ones as targets, low-cue nonmembers as controls."""
    low = tasks.filter("cue_band = 'low'")
    success = F.coalesce("any_sensitive_match", F.lit(False))
    return paired(low.filter(F.col("is_member") & success), low.filter(F.col("is_member") & ~success), low.filter(~F.col("is_member")), most=most)


def strongest_layers(success: DataFrame, fail: DataFrame, k: int) -> DataFrame:
    """layer, direction, norm of the k layers whose means (layer, vector) differ most."""
    s, f = mean_vectors(success, ["layer"]), mean_vectors(fail, ["layer"]).withColumnRenamed("vector", "_f")
    diff = s.join(f, "layer").select("layer", F.zip_with("vector", "_f", lambda a, b: a - b).alias("direction"))
    return diff.withColumn("norm", F.sqrt(dot(F.col("direction"), F.col("direction")))).orderBy(F.desc("norm"), "layer").limit(k)
