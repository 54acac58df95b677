"""Checks of records, corpora and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import digits_only, longest_shared_piece, normalize_text, normalize_value
from tidemark.operators.containment import found_terms
from tidemark.operators.scoring import target_fields


def sensitive_values(records: DataFrame) -> DataFrame:
    """record_id, field, value: one row a sensitive field that the record has."""
    return records.select("record_id", F.explode(target_fields(F.col("fields"), F.col("sensitive_fields"))).alias("field", "value"))


def duplicate_values(records: DataFrame) -> DataFrame:
    return sensitive_values(records).groupBy("field", "value").agg(F.count("*").alias("records")).filter("records > 1")


def duplicate_variants(docs: DataFrame) -> DataFrame:
    """Records with a repeated text though some of their documents are no exact duplicates."""
    found = docs.groupBy("record_id").agg(F.count("text").alias("_n"), F.count_distinct("text").alias("_d"), F.bool_or(F.col("variant_type") != "exact_duplicate").alias("_v"))
    return found.filter("_n <> _d AND _v").select("record_id")


def values_in_corpus(records: DataFrame, docs: DataFrame, membership: str = "nonmember") -> DataFrame:
    """record_id, field of the sensitive values that some document of the corpus contains (phones: digit by digit).

    All values are looked for at once, by their rarest grams.
    """
    of = sensitive_values(records.filter(F.col("membership") == membership))
    of = of.select("record_id", "field", normalize_value(F.col("field"), F.col("value")).alias("term"), F.contains("field", F.lit("phone")).alias("phone"))
    plain, digits = docs.select(normalize_text(F.col("text")).alias("hay")), docs.select(digits_only(F.col("text")).alias("hay"))
    hits = found_terms(plain, of.filter("NOT phone").select("term")).withColumn("phone", F.lit(False)).unionByName(found_terms(digits, of.filter("phone").select("term")).withColumn("phone", F.lit(True)))
    return of.join(hits, ["term", "phone"], "left_semi").select("record_id", "field")


def canary_collisions(records: DataFrame, docs: DataFrame) -> DataFrame:
    """Canaries whose secret is in a background document as it stands."""
    of = records.filter("family = 'canary'").select("record_id", F.col("fields")["secret"].alias("term"))
    return of.join(found_terms(docs.select(F.col("text").alias("hay")), of.select("term")), "term", "left_semi").select("record_id")


def leaking_prompts(prompts: DataFrame, bands: tuple[str, ...] = ("low", "no_cue"), least: int = 6) -> DataFrame:
    """How many prompts of the bands share a piece of least characters with a target."""
    piece = longest_shared_piece(F.col("prompt"), F.map_values("target_fields"))
    return prompts.filter(F.col("cue_band_requested").isin(*bands)).groupBy("cue_band_requested").agg(F.count_if(piece >= least).alias("leaking"), F.count("*").alias("prompts"))


def report(records: DataFrame, docs: DataFrame, prompts: DataFrame | None = None, rendered: DataFrame | None = None, background: DataFrame | None = None) -> DataFrame:
    """check, count: one row a check."""
    rows = [("sensitive_values", sensitive_values(records)), ("value_collisions", duplicate_values(records)), ("nonmember_values_in_corpus", values_in_corpus(records, docs))]
    if background is not None:
        rows.append(("canary_background_collisions", canary_collisions(records, background)))
    if rendered is not None:
        rows.append(("duplicate_variant_records", duplicate_variants(rendered)))
    out = None
    for name, df in rows:
        one = df.agg(F.count("*").alias("count")).select(F.lit(name).alias("check"), "count")
        out = one if out is None else out.unionByName(one)
    if prompts is not None:
        leaks = leaking_prompts(prompts)
        out = out.unionByName(leaks.select(F.concat(F.lit("leaking_"), "cue_band_requested").alias("check"), F.col("leaking").alias("count")))
    return out
