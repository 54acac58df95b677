"""Seeded orders, splits, budgets, strata and permutations.

A seeded order is that of SHA-256 of seed and id, so any part of it can be found without a shuffle of all rows into one task:
running sums are taken in buckets of the hash and moved by the buckets' sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import stored, sums_before

#: Hex digits of the order that make a bucket: 4096 buckets.
BUCKET_DIGITS = 3
#: Counts that a bootstrap draws at once, and distinct values of a part.
DRAWN, PART = 4_000_000, 10_000


def seeded(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def running(rows: DataFrame, key: str, seed: int, weight: Column | None = None, by: Sequence[str] = (), name: str = "before") -> DataFrame:
    """Adds the sum of weights (rows, without weight) that come before a row in the seeded order, in all or by group; ties by key."""
    w = F.lit(1).cast("long") if weight is None else weight
    # no column of the rows is touched: what is added lies in one column of a name of its own
    at = "__running"
    while at in rows.columns or at == name:
        at += "_"
    order = seeded(F.col(key), seed)
    out = rows.withColumn(at, F.struct(order.alias("order"), F.substring(order, 1, BUCKET_DIGITS).alias("bucket"), w.alias("w")))
    sums = out.groupBy(*(F.col(b).alias(f"g{i}") for i, b in enumerate(by)), F.col(f"{at}.bucket").alias("bucket")).agg(F.sum(f"{at}.w").alias("s"))
    # at most 4096 rows a group
    earlier = Window.partitionBy(*([f"g{i}" for i in range(len(by))] or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.struct(*(f"g{i}" for i in range(len(by))), "bucket", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base")).alias(f"{at}b"))
    inside = Window.partitionBy(*by, F.col(f"{at}.bucket")).orderBy(F.col(f"{at}.order"), key).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn(f"{at}i", F.coalesce(F.sum(f"{at}.w").over(inside), F.lit(0)))
    condition = F.col(f"{at}.bucket") == F.col(f"{at}b.bucket")
    for i, b in enumerate(by):
        condition = condition & F.col(b).eqNullSafe(F.col(f"{at}b.g{i}"))
    joined = out.join(base if by else F.broadcast(base), condition)
    return joined.select(*rows.columns, (F.col(f"{at}b.base") + F.col(f"{at}i")).alias(name))


#: The column of running sums while a selection is made.
BEFORE = "__before"


def token_budget(docs: DataFrame, target: int, seed: int, key: str = "doc_id", weight: str = "tokens") -> DataFrame:
    """Documents in seeded order until their tokens reach the target; the one that crosses it is in."""
    return running(docs, key, seed, F.col(weight), name=BEFORE).filter(F.col(BEFORE) < target).drop(BEFORE)


def cyclic_budget(docs: DataFrame, target: int, seed: int, key: str = "doc_id", weight: str = "tokens") -> DataFrame:
    """The same, the documents being taken again and again; adds epoch. Without tokens there is nothing to take."""
    total = docs.agg(F.sum(weight)).first()[0] or 0
    if total <= 0 or target <= 0:
        return docs.limit(0).withColumn("epoch", F.lit(0))
    epochs = -(-target // total)
    out = running(docs, key, seed, F.col(weight), name=BEFORE).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return out.filter(F.col(BEFORE) + F.col("epoch") * F.lit(total) < target).drop(BEFORE)


def train_validation(docs: DataFrame, fraction: float, seed: int, key: str = "doc_id") -> DataFrame:
    """Adds split: the first round(n * fraction) documents of the seeded order, at least one and not all, are validation."""
    n = docs.count()
    size = min(max(1, round(n * fraction)), max(n - 1, 0))
    return running(docs, key, seed, name=BEFORE).withColumn("split", F.when(F.col(BEFORE) < size, "validation").otherwise("train")).drop(BEFORE)


def largest_remainder(rows: DataFrame, stratum: str, target: int, seed: int, key: str) -> DataFrame:
    """A stratified sample of target rows: shares rounded down, what is left goes by remainder, then name, downwards."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = Window.partitionBy(F.lit(0))
    exact = F.lit(float(target)) * F.col("_n") / F.sum("_n").over(total)
    q = sizes.withColumn("_exact", exact).withColumn("_floor", F.least(F.floor("_exact"), F.col("_n")))
    q = q.withColumn("_left", F.lit(target) - F.sum("_floor").over(total)).withColumn("_all", F.sum("_n").over(total) <= target)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_exact") - F.col("_floor")), F.desc(stratum))
    quota = F.when(F.col("_all"), F.col("_n")).otherwise(F.col("_floor") + F.when(F.row_number().over(order) <= F.col("_left"), 1).otherwise(0))
    quotas = q.select(F.col(stratum).alias("_stratum"), quota.alias("_quota"))
    ranked = running(rows, key, seed, by=[stratum], name="_rank")
    return ranked.join(quotas, F.col(stratum).eqNullSafe(F.col("_stratum"))).filter(F.col("_rank") < F.col("_quota")).select(*rows.columns)


def rounded_strata(rows: DataFrame, stratum: str, target: int, seed: int, key: str) -> DataFrame:
    """A stratified sample by rounded shares (half to even), topped up in another seeded order, cut to target by key."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    quota = F.bround(F.lit(float(target)) * F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(0))))
    quotas = sizes.select(F.col(stratum).alias("_stratum"), quota.alias("_quota"))
    ranked = running(rows, key, seed, by=[stratum], name="_rank").join(quotas, F.col(stratum).eqNullSafe(F.col("_stratum")))
    chosen = ranked.filter(F.col("_rank") < F.col("_quota")).select(*rows.columns)
    rest = ranked.filter(F.col("_rank") >= F.col("_quota")).select(*rows.columns)
    missing = max(0, target - chosen.count())
    more = running(rest, key, seed + 17, name="_rank").filter(F.col("_rank") < missing).drop("_rank")
    return chosen.unionByName(more).orderBy(key).limit(target)


def derangement(rows: DataFrame, key: str, seed: int, by: Sequence[str]) -> DataFrame:
    """Adds donor, the key of the next row of the group in seeded, cyclic order: nobody's own, but in groups of one."""
    ranked = running(rows, key, seed, by=by, name="_rank")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = ranked.join(sizes, list(by)).withColumn("_next", F.pmod(F.col("_rank") + 1, F.col("_n")))
    donors = ranked.select(*by, F.col("_rank").alias("_next"), F.col(key).alias("donor"))
    return ranked.join(donors, [*by, "_next"]).select(*rows.columns, "donor")


def random_control(units: DataFrame, removed: DataFrame, unit: str, size: int, seed: int = 13) -> DataFrame:
    """size units in seeded order among those not removed; among all if these are too few."""
    left = units.select(unit).distinct().join(removed.select(unit).distinct(), unit, "left_anti")
    pool = left if left.count() >= size else units.select(unit).distinct()
    return running(pool, unit, seed, name=BEFORE).filter(F.col(BEFORE) < size).drop(BEFORE)


def bootstrap(values: DataFrame, by: Sequence[str], value: str = "value", rounds: int = 2000, seed: int = 1, last: bool = False) -> DataFrame:
    """Percentile interval of the mean by group, from a resampling of its distinct values' counts.

    Ends are at int(q * (rounds - 1)) of the sorted means, or at int(q * rounds) with last.  A resample of n values is drawn in two
    steps of the same law: how many fall to each of a group's parts, by hash, of about PART distinct values, and then which of the part's.  A task
    holds a part's values or a group's parts, and partial sums meet; resamples are drawn in blocks of DRAWN counts.
    """
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    counts = stored(counts.select(group.alias("_g"), F.col(value).cast("double").alias("_v"), "_c"), "counts")
    wide = counts.groupBy("_g").agg(F.ceil(F.count("*") / PART).alias("_parts"))
    parted = counts.join(wide, "_g").withColumn("_part", F.pmod(F.xxhash64("_v", F.lit(seed)), F.col("_parts")))
    totals = parted.groupBy("_g", "_part").agg(F.sum("_c").alias("_n"))

    def source(*names: object) -> np.random.Generator:
        return np.random.default_rng([seed, *hashlib.sha256(repr(names).encode()).digest()])

    def over_parts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_part")
        n, draw, at_once = rows["_n"].to_numpy(), source(rows["_g"].iloc[0]), max(1, DRAWN // len(rows))
        drawn = np.concatenate([draw.multinomial(n.sum(), n / n.sum(), min(at_once, rounds - k)) for k in range(0, rounds, at_once)])
        return pd.DataFrame({"_g": rows["_g"], "_part": rows["_part"], "_drawn": list(drawn.T)})

    def inside(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_v")
        c, v, n = rows["_c"].to_numpy(), rows["_v"].to_numpy(), np.asarray(of["_drawn"].iloc[0])
        g, part = of["_g"].iloc[0], int(of["_part"].iloc[0])
        draw, at_once = source(g, part), max(1, DRAWN // len(c))
        sums = np.concatenate([draw.multinomial(n[k : k + at_once], c / c.sum()) @ v for k in range(0, rounds, at_once)])
        return pd.DataFrame({"_g": [g], "_sums": [sums]})

    drawn = totals.groupBy("_g").applyInPandas(over_parts, "_g string, _part long, _drawn array<long>")
    sums = parted.groupBy("_g", "_part").cogroup(drawn.groupBy("_g", "_part")).applyInPandas(inside, "_g string, _sums array<double>")
    low, high = (int(0.025 * rounds), min(rounds - 1, int(0.975 * rounds))) if last else (int(0.025 * (rounds - 1)), int(0.975 * (rounds - 1)))
    resamples = sums.select("_g", F.posexplode("_sums").alias("_round", "_s")).groupBy("_g", "_round").agg(F.sum("_s").alias("_s"))
    ends = resamples.groupBy("_g").agg(F.sort_array(F.collect_list("_s")).alias("_all")).select("_g", F.col("_all")[low].alias("_low"), F.col("_all")[high].alias("_high"))
    whole = counts.groupBy("_g").agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("_v")).alias("_sum")).join(ends, "_g")
    kinds = ", ".join(f"`{b}` {values.schema[b].dataType.simpleString()}" for b in by)
    names = F.from_json("_g", kinds) if by else F.lit(None)
    return whole.withColumn("_by", names).select(*(F.col(f"_by.{b}").alias(b) for b in by), "n", *((F.col(c) / F.col("n")).alias(a) for c, a in (("_sum", "mean"), ("_low", "ci_low"), ("_high", "ci_high"))))


def auc(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC area by group from counts by score; half for ties, 0.5 where a class is missing.

    How many negatives stand below a score comes from running sums in ranges that hold about as many scores each, however these are spread.
    """
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    counts = stored(counts.withColumn("_g", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")), "counts")
    c = sums_before(counts, ["_g"], [F.col(score)], {"_below": "_q"})
    pairs = F.sum("_p") * F.sum("_q")
    return c.groupBy(*by).agg(F.when(pairs > 0, F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2)) / F.nullif(pairs, F.lit(0))).otherwise(0.5).alias("auc"))
