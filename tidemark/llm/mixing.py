"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Sources in the order of their names' code points, null last, take weights from a repeating cycle and share a budget of
words, a multiple of all words.  A source's target stops at a multiple of its own size; the excess is shared by weight among
the others, which ends at one water level: ``target = least(most * size, level * weight)``.  With sources in the order of
``most * size / weight``, the level is the largest share that any tail of that order gets from what the head, capped, leaves.

A source's budget is its target in whole words.  It takes all its documents as often as the budget allows (complete
epochs); the rest goes to documents in ascending order of ``-ln(u) / quality``, u being uniform and a function of seed, id
and text, until the running sum of sizes fills it; the document that crosses the budget gives its first words up to it.

Expressions only.  The texts are read once, for sizes and hashes, and never shuffled; rows that are alike are one row with a count
until the end.  Running sums are taken in ranges of (source, key), so no task holds a source (``ordered``).

Defined cases: null and empty texts have size 0 and are never taken (0 words); a null id takes part like others; null sources are one
source; documents without a quality, or with several of which the largest counts, are defined by ``default``; a
quality that is not above 0 comes last in its source.  Without words all targets are 0; an empty table gives no rows; other input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stored
from tidemark.llm.ordered import copies, sums_before
from tidemark.llm.rendezvous import _BITS, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that may be broadcast; more are joined by a shuffle, whose hot partitions are split at run time.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(key: Column, digest: Column, quality: Column, seed: int) -> Column:
    """The exponential key: ascending order is the order of drawing."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), digest)
    u = (uniform(name) + F.lit(0.5)) / F.lit(float(1 << _BITS))
    return F.when(quality > 0, -F.ln(u) / quality).otherwise(F.lit(float("inf")))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, _place (its place among the sources) and target. sizes: a stored table of source and source_size."""
    placed = sums_before(sizes.withColumn("_one", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()], {"_place": "_one"})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    placed = stored(placed.drop("_one").withColumn("_w", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size")), "sources")
    ahead = sums_before(placed, [], [F.col("_cap") / F.col("_w"), F.col("_place")], {"_caps": "_cap", "_ws": "_w"})
    whole = placed.agg((F.lit(float(share)) * F.sum("source_size")).alias("_budget"), F.sum("_w").alias("_all_w"))
    level = ahead.join(F.broadcast(whole)).agg(F.max((F.col("_budget") - F.col("_caps")) / (F.col("_all_w") - F.col("_ws"))).alias("_level"))
    return placed.join(F.broadcast(level)).select("source", "source_size", "_place", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))


def mix(
    docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, default: float = 1.0, seed: int = 13, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """key, size, source_size, target and taken (words of the row that the mix takes) of each row. quality: key and ``quality``, positive numbers."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"), F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("_text"))
    if quality is not None:
        rows = rows.join(quality.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max("quality").cast("double").alias("_quality")), "_key", "left")
    else:
        rows = rows.withColumn("_quality", F.lit(None).cast("double"))
    rows = rows.withColumn("_draw", sampling_key(F.col("_key"), F.col("_text"), F.coalesce("_quality", F.lit(float(default))), seed))
    alike = stored(rows.groupBy("_key", "source", "size", "_text", "_draw").agg(F.count("*").alias("_n")), "alike")
    sizes = stored(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), "sizes")
    aims = stored(targets(sizes, weights, share, most), "targets")
    # a thousandth of a thousandth keeps what floating point leaves below a whole number
    aims = aims.withColumn("_budget", F.floor(F.col("target") + 1e-6)).withColumn("_epochs", F.coalesce(F.expr("_budget div nullif(source_size, 0)"), F.lit(0)))
    near = F.broadcast(aims) if aims.count() <= BROADCAST_SOURCES else aims
    placed = alike.join(near.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("_words", F.col("size") * F.col("_n"))
    order = [F.col("_draw"), F.col("_key").asc_nulls_first(), F.col("_text")]
    run = sums_before(stored(placed, "placed"), ["_place"], order, {"_before": "_words"})
    left = F.col("_budget") - F.col("_epochs") * F.col("source_size") - F.col("_before") - F.col("_copy") * F.col("size")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return copies(run, "_n", "_copy").select(F.col("_key").alias(key), "size", "source_size", "target", taken.alias("taken"))
