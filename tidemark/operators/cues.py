"""How much a prompt gives away of its target: overlaps, cue band, leakage filter."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.text import Ratios, char_ngrams, jaccard, longest_common_substring, longest_shared_piece, normalize_text, tokens

STRENGTHS = ("legacy", "permissive", "default", "strict")
#: Parts of field names whose values have a structure.
STRUCTURED = ("email", "phone", "id", "code", "date", "time", "digits")
#: Fields that name a person.
NAMES = ("username", "manager_name", "full_name")

#: Texts whose index a batch keeps.
MATCHERS = 1000


def band(token: Column, char5: Column, lcs: Column, leak: Column, entity: Column, anchor: Column, direct: Column, piece: Column) -> Column:
    """high, medium, no_cue or low; the first rule that holds decides."""
    faint = (token < 0.10) & (char5 < 0.10) & (lcs < 0.15) & (piece < 6)
    return (
        F.when(leak | (token >= 0.40) | (lcs >= 0.40) | (direct & (anchor | entity)), "high")
        .when(((token >= 0.10) & (token < 0.40)) | ((lcs >= 0.15) & (lcs < 0.40)) | entity, "medium")
        .when(faint, F.when(anchor, "low").otherwise("no_cue"))
        .otherwise("medium")
    )


def leakage(strength: str, leak: Column, ratio: Column, char5: Column, risk: Column, prefix: Column) -> Column:
    """The reason for which the filter rejects, null if it does not."""
    if strength not in STRENGTHS:
        raise ValueError(f"unknown filter strength: {strength}")
    if strength == "legacy":
        return F.lit(None).cast("string")
    out = F.when(leak, "exact_normalized_sensitive_value")
    if strength == "default":
        out = out.when(ratio >= 0.80, "levenshtein_similarity_ge_0.80").when(char5 >= 0.50, "char5_jaccard_ge_0.50").when(risk, "deterministic_recovery_risk")
    if strength == "strict":
        out = out.when(ratio >= 0.60, "levenshtein_similarity_ge_0.60").when(char5 >= 0.30, "char5_jaccard_ge_0.30").when(prefix, "structured_sensitive_prefix").when(risk, "deterministic_identifier")
    return out


def _has(prompt: Column, values: Column, least: int = 1) -> Column:
    """Whether the normalised prompt contains one of the values of least characters."""
    return F.exists(values, lambda v: v.isNotNull() & (F.char_length(v) >= least) & F.contains(prompt, normalize_text(v)))


def direct_context(prompt: Column, fields: Column) -> Column:
    norm = normalize_text(prompt)
    labels = F.transform(F.map_keys(fields), lambda k: F.replace(k, F.lit("_"), F.lit(" ")))
    return F.endswith(F.rtrim(F.regexp_replace(prompt, r"\s+$", "")), F.lit(":")) | F.exists(labels, lambda x: F.endswith(norm, x) | F.contains(norm, F.concat(x, F.lit(":"))))


def structured_prefix(prompt: Column, fields: Column, least: int = 4) -> Column:
    norm = normalize_text(prompt)
    kind = "|".join(STRUCTURED)

    def of(e: Column) -> Column:
        v = normalize_text(e.value)
        return (F.char_length(v) > least) & e.key.rlike(kind) & F.contains(norm, F.substring(v, 1, least + 1))

    return F.exists(F.map_entries(fields), of)


def overlaps(pairs: DataFrame, prompt: str = "prompt", target: str = "target_text") -> DataFrame:
    """Adds the token and 5-gram overlap of prompt and target."""
    p, t = F.col(prompt), F.col(target)
    return pairs.withColumns({"token_overlap": jaccard(tokens(p), tokens(t)), "char5_jaccard": jaccard(char_ngrams(p, 5), char_ngrams(t, 5))})


def cue_scores(prompts: DataFrame, records: DataFrame, strength: str = "legacy") -> DataFrame:
    """prompts with all overlaps, flags, the computed band and the filter's verdict. A prompt without a record has no fields.

    Overlaps are exact; callers round them for reports.
    """
    empty_map, empty = F.expr("cast(map() as map<string, string>)"), F.array().cast("array<string>")
    slim = records.select("record_id", F.col("fields").alias("_fields"), F.col("sensitive_fields").alias("_sensitive"), F.col("anchor_fields").alias("_anchors"), F.col("public_handle").alias("_handle"))
    rows = prompts.join(slim, "record_id", "left").withColumns({"_fields": F.coalesce("_fields", empty_map), "_sensitive": F.coalesce("_sensitive", empty), "_anchors": F.coalesce("_anchors", empty), "_handle": F.coalesce("_handle", F.lit(""))})
    own = F.map_filter("_fields", lambda k, _: F.array_contains(F.col("_sensitive"), k))
    given = F.col("target_fields") if "target_fields" in prompts.columns else F.lit(None).cast("map<string,string>")
    rows = rows.withColumn("_targets", F.when(F.size(F.coalesce(given, empty_map)) > 0, given).otherwise(own))
    values = F.map_values("_targets")
    rows = rows.withColumns({"_target_text": F.array_join(values, " ", ""), "_norm": normalize_text(F.col("prompt"))})
    norm, fields = F.col("_norm"), F.col("_fields")
    ignored = F.array_union(F.array_union("_anchors", "_sensitive"), F.array(F.lit("public_handle"), F.lit("anchor")))
    people = F.concat(F.when(F.map_contains_key(fields, "full_name"), F.split(fields["full_name"], r"\s+")).otherwise(empty), F.filter(F.array(*(F.when(~F.array_contains(ignored, n), fields[n]) for n in NAMES)), lambda v: v.isNotNull()))
    anchors = F.concat(F.array("_handle"), F.transform("_anchors", lambda k: fields[k]))
    canonical = F.concat_ws(" ", F.nullif(F.col("_handle"), F.lit("")), F.nullif(F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat_ws(" ", e.key, e.value)), " "), F.lit("")))
    rows = overlaps(rows, target="_target_text").withColumns({
        "lcs_fraction": longest_common_substring(norm, normalize_text(F.col("_target_text"))),
        "field_leakage_flag": F.exists(values, lambda v: (F.trim(v) != "") & F.contains(norm, normalize_text(v))),
        "entity_overlap_flag": _has(norm, people, 4),
        "record_specific_anchor_flag": _has(norm, anchors, 4),
        "direct_target_context_flag": direct_context(F.col("prompt"), F.col("_targets")),
        "template_overlap_score": jaccard(tokens(F.col("prompt")), tokens(canonical)),
        "max_sensitive_substring": longest_shared_piece(F.col("prompt"), values),
        "structured_prefix_flag": structured_prefix(F.col("prompt"), F.col("_targets")),
    })
    present = F.filter(F.transform(values, lambda v: normalize_text(v)), lambda v: v != "")
    rows = rows.withColumn("levenshtein_similarity", ratio_to_any(norm, present))
    c = F.col
    rows = rows.withColumn("deterministic_recovery_risk", c("direct_target_context_flag") & c("record_specific_anchor_flag") & (c("field_leakage_flag") | (c("token_overlap") >= 0.25) | (c("max_sensitive_substring") >= 8)))
    rows = rows.withColumn("cue_band_computed", band(c("token_overlap"), c("char5_jaccard"), c("lcs_fraction"), c("field_leakage_flag"), c("entity_overlap_flag"), c("record_specific_anchor_flag"), c("direct_target_context_flag"), c("max_sensitive_substring")))
    reason = leakage(strength, c("field_leakage_flag"), c("levenshtein_similarity"), c("char5_jaccard"), c("deterministic_recovery_risk"), c("structured_prefix_flag"))
    requested = c("cue_band_requested") if "cue_band_requested" in prompts.columns else F.lit(None).cast("string")
    if strength == "legacy":
        good = requested.eqNullSafe(c("cue_band_computed"))
        why = F.when(good, "pass").otherwise(F.concat(F.lit("requested_"), F.coalesce(requested, F.lit("None")), F.lit("_computed_"), c("cue_band_computed")))
    else:
        good, why = reason.isNull(), F.coalesce(reason, F.lit("pass"))
    rows = rows.withColumns({"passes_cue_filter": good, "cue_filter_reason": why, "leakage_filter_status": F.when(good, "pass").otherwise("fail"), "leakage_filter_strength": F.lit(strength)})
    return rows.drop("_fields", "_sensitive", "_anchors", "_handle", "_targets", "_target_text", "_norm")


@F.pandas_udf(DoubleType())
def ratio_to_any(text: pd.Series, values: pd.Series) -> pd.Series:
    """The largest matching-blocks ratio of the text with any of the values; 0 without values. Values that cannot exceed the largest so far are passed over."""
    known: dict[str, Ratios] = {}

    def largest(t: str, of: Iterable[str]) -> float:
        best = None
        for v in of:
            if v not in known:
                if len(known) >= MATCHERS:
                    known.clear()
                known[v] = Ratios(v)
            found = known[v].of(t, -1.0 if best is None else best)
            best = found if best is None else max(best, found or 0.0)
        return best or 0.0

    return pd.Series([largest(t or "", vs) for t, vs in zip(text, values, strict=True)], dtype=float)
