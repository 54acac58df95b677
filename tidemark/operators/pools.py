"""Candidate pools of training documents for the targets of an attribution, and what is removed on their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import stable_hash
from tidemark.operators.sampling import running

#: Places of the targets that are near each other.
PLACES_A_BLOCK = 1024


def _best(metric: str) -> list[Column]:
    """Descending: exact first, then log-probability, or the other way; a log-probability of null or 0 counts as none."""
    exact, logprob = F.coalesce("record_exact", F.lit(False)).cast("int"), F.coalesce(F.nullif(F.col("max_target_logprob"), F.lit(0.0)), F.lit(float("-inf")))
    first = (logprob, exact) if metric == "max_target_logprob" else (exact, logprob)
    return [F.desc(first[0]), F.desc(first[1]), F.desc("task_id")]


def select_targets(tasks: DataFrame, bands: tuple[str, ...] = ("low",), sides: tuple[str, ...] = ("member",), flag: str = "any_sensitive_match", per_record: int = 0, total: int = 0, metric: str = "record_exact_then_logprob") -> DataFrame:
    """Successful tasks of the bands and sides; the best of each record, then the best of all, where these are limited."""
    out = tasks.filter(F.col("cue_band").isin(*bands) & F.col("membership").isin(*sides) & F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    if per_record > 0:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("record_id").orderBy(*_best(metric)))).filter(F.col("_n") <= per_record).drop("_n")
    return out.orderBy(*_best(metric)).limit(total) if total > 0 else out


def candidate_pools(targets: DataFrame, docs: DataFrame, negatives: int = 256, seed: int = 1, near: bool = False) -> DataFrame:
    """target, doc_id, is_true, position: all documents of the target's record, and up to negatives others of its family.

    A family's documents stand in seeded order; a target takes those that follow a place of its own, in a cycle.  So a
    pool is found by an equi-join on places, without pairs of all targets and documents.  targets: target, record_id, family.
    With near, a column of that name tells targets whose places are neighbours, so their pools have most documents in common.
    """
    numbered = running(docs.select("doc_id", "record_id", "family"), "doc_id", seed, by=["family"], name="_place")
    sizes = docs.groupBy("family").agg(F.count("*").alias("_n"))
    own = docs.groupBy("record_id").agg(F.count("*").alias("_own"))
    t = targets.select("target", F.col("record_id").alias("_record"), "family").join(sizes, "family").join(own.withColumnRenamed("record_id", "_record"), "_record", "left")
    start = F.pmod(stable_hash(F.concat(F.lit(f"{seed}:"), F.col("target").cast("string")), 1_000_000_007), F.col("_n"))
    by_place = t.select("target", F.concat_ws(":", "family", F.floor(start / PLACES_A_BLOCK).cast("string")).alias("near"))
    steps = F.least(F.col("_n"), F.lit(negatives) + F.coalesce("_own", F.lit(0)))
    t = t.withColumn("_start", start).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)))
    t = t.withColumn("_place", F.pmod(F.col("_start") + F.col("_step"), F.col("_n")))
    others = t.join(numbered, ["family", "_place"]).filter(~F.col("record_id").eqNullSafe(F.col("_record")))
    others = others.withColumn("_k", F.row_number().over(Window.partitionBy("target").orderBy("_step"))).filter(F.col("_k") <= negatives)
    true = targets.select("target", "record_id").join(docs.select("record_id", "doc_id"), "record_id")
    pool = others.select("target", "doc_id", F.lit(False).alias("is_true")).unionByName(true.select("target", "doc_id", F.lit(True).alias("is_true")))
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "target", "doc_id"), 256)
    if near:
        pool = pool.join(by_place, "target", "left").withColumn("near", F.coalesce("near", F.lit("")))
    return pool.withColumn("position", F.row_number().over(Window.partitionBy("target").orderBy(order, "doc_id")))


def pool_sizes(pools: DataFrame) -> DataFrame:
    return pools.groupBy("target").agg(F.count_if("is_true").alias("true_count"), F.count("*").alias("pool_size"))


def top_units(ranked: DataFrame, unit: str) -> DataFrame:
    """The distinct units of the rows at rank 1."""
    return ranked.filter("rank = 1").select(unit).filter(F.col(unit).isNotNull()).distinct()


def without_units(docs: DataFrame, removed: DataFrame, unit: str) -> DataFrame:
    return docs.join(removed.select(unit).distinct(), unit, "left_anti")


def training_selection(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents of the targets' records."""
    return docs.join(targets.select("record_id").distinct(), "record_id", "left_semi")


def exposure(docs: DataFrame) -> DataFrame:
    return docs.groupBy("record_id").agg(F.count("*").alias("exposure"))
