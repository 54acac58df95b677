"""Records whose values are exchanged within their family, to break what training ties together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sampling import derangement

KINDS = ("none", "original", "sensitive_value_shuffle", "anchor_shuffle")


def exchange(records: DataFrame, kind: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """The records with values of their donors, and a manifest (record_id, family, donor_record_id, field, original_value, inserted_value).

    Members outside the canaries take the values of the next member of their family in seeded order, all from the original
    records, so each value moves to exactly one other record.  A field changes if both have it.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown ablation: {kind}")
    manifest = "record_id string, family string, donor_record_id string, field string, original_value string, inserted_value string"
    if kind in ("none", "original"):
        return records, records.sparkSession.createDataFrame([], manifest)
    takes_part = (F.col("membership") == "member") & (F.col("family") != "canary")
    moved = derangement(records.filter(takes_part), "record_id", seed, ["family"])
    donors = records.select(F.col("record_id").alias("donor"), F.col("fields").alias("_theirs"), F.col("public_handle").alias("_handle"))
    joined = moved.join(donors, "donor")
    named = "sensitive_fields" if kind == "sensitive_value_shuffle" else "anchor_fields"
    of_family = records.filter(takes_part).select("family", F.explode(named).alias("_f")).groupBy("family").agg(F.collect_set("_f").alias("_names"))
    joined = joined.join(of_family, "family", "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))
    taken = lambda k: F.array_contains(F.col("_names"), k) & F.map_contains_key(F.col("_theirs"), k)
    fields = F.transform_values("fields", lambda k, v: F.when(taken(k), F.col("_theirs")[k]).otherwise(v))
    handle = F.coalesce(F.nullif("_handle", F.lit("")), "public_handle") if kind == "anchor_shuffle" else F.col("public_handle")
    out = joined.withColumns({"_new": fields, "_new_handle": handle})
    changes = F.transform(F.filter(F.map_keys("fields"), taken), lambda k: F.struct(k.alias("field"), F.col("fields")[k].alias("original_value"), F.col("_new")[k].alias("inserted_value")))
    if kind == "anchor_shuffle":
        changes = F.concat(F.array(F.struct(F.lit("public_handle").alias("field"), F.col("public_handle").alias("original_value"), F.col("_new_handle").alias("inserted_value"))), changes)
    listed = out.select(F.col("record_id").cast("string"), "family", F.col("donor").cast("string").alias("donor_record_id"), F.explode(changes).alias("_c")).select("record_id", "family", "donor_record_id", "_c.*")
    changed = out.withColumns({"fields": F.col("_new"), "public_handle": F.col("_new_handle")}).select(*records.columns)
    return changed.unionByName(records.filter(~takes_part | takes_part.isNull())), listed


def retention(docs: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id with the shares of sensitive and anchor values that its text keeps, and its length over the record's text."""
    c = F.col
    r = records.select("record_id", "fields", "sensitive_fields", "anchor_fields", "public_handle")
    joined = docs.select("doc_id", "record_id", "text").join(r, "record_id")

    def share(names: str) -> Column:
        values = F.filter(F.transform(c(names), lambda k: c("fields")[k]), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.size(F.filter(values, lambda v: F.contains("text", v))) / F.size(values)).otherwise(0.0)

    whole = F.concat_ws(" ", "public_handle", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws(" ", e.key, e.value)), " "))
    return joined.select("doc_id", share("sensitive_fields").alias("exact_retention"), share("anchor_fields").alias("anchor_retention"), (F.char_length("text") / F.greatest(F.char_length(whole), F.lit(1))).alias("length_ratio"))
