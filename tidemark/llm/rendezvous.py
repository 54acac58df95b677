"""Sharding by weighted rendezvous hashing.

Each record key gets, for each shard, a uniform number u from MD5 of ``key:shard`` and goes to the shard of the largest
``-weight / ln(u)``.  A shard's score depends on nothing but key and shard, so one more shard takes rows only into
itself, in the share of its weight; a hot value of any other column has no effect.

Slots number a shard's rows from 0 without gaps, in the order of (key hash, key, text_crc32, size).  Rows that are alike are one
row with a count, which running sums in ranges of (shard, order) turn into places (``ordered``), so no task holds a shard or
one key's rows; copies are made in blocks at the end.

Defined cases: a null key is the string "null" and goes by the text's CRC-32 inside its shard's order; repeated keys share a
shard; null text counts 1 byte and CRC-32 0; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stored
from tidemark.llm.ordered import copies, sums_before

ROWS_A_BUCKET = 200_000
_BITS = 52


def uniform(text: Column) -> Column:
    """52 bits of MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """key: a string column. weights: positive, by shard number."""
    if not weights or any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("each shard needs a positive finite weight")
    scores = [
        F.struct((-F.lit(float(w)) / F.ln((uniform(F.concat(key, F.lit(f":{s}"))) + F.lit(0.5)) / F.lit(float(1 << _BITS)))).alias("score"), F.lit(s).alias("shard"))
        for s, w in sorted(weights.items())
    ]
    return F.greatest(*scores).shard if len(scores) > 1 else F.lit(next(iter(weights)))


def assign(rows: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, grown_shard and key_hash for each row."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    out = rows.select(
        F.col(key),
        name.alias("_name"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard_of(F.col("_name"), weights).alias("shard")
    more = shard_of(F.col("_name"), grown).alias("grown_shard") if grown else F.lit(None).cast("int").alias("grown_shard")
    return out.select(key, (F.col("_bytes") + 1).alias("size"), "text_crc32", placed, more, uniform(F.col("_name")).alias("key_hash"))


def number(placed: DataFrame, key: str = "doc_id", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Adds slot. Rows that are alike in all columns are counted before they meet, and are made rows again at the end."""
    alike = stored(placed.groupBy(*placed.columns).agg(F.count("*").alias("_n")), "alike")
    order = [F.col("key_hash"), F.col(key).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    run = sums_before(alike, ["shard"], order, {"_first": "_n"}, rows_a_bucket)
    return copies(run, "_n", "_copy").withColumn("slot", F.col("_first") + F.col("_copy")).select(*placed.drop("key_hash").columns, "slot")


def rendezvous_shards(rows: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard."""
    out = number(assign(rows, weights, grown, key, text), key)
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
