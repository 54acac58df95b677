"""Member-over-nonmember tables by condition and cue band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import agresti_caffo, mean, rate, wilson

MEMBER, NONMEMBER = "member", "nonmember"


def _is(side: str) -> Column:
    return F.col("membership") == side


def cue_table(tasks: DataFrame, by: tuple[str, ...] = ("condition", "cue_band")) -> DataFrame:
    """Rates, lifts and intervals of collapsed tasks: one conditional aggregate and expressions over it."""
    counts = []
    for side in (MEMBER, NONMEMBER):
        counts += [
            F.count_if(_is(side)).alias(f"{side}_tasks"),
            F.count_if(_is(side) & F.col("any_sensitive_match")).alias(f"{side}_successes"),
            F.count_if(_is(side) & F.col("record_exact")).alias(f"{side}_record_exact_successes"),
            rate(F.col("any_sensitive_match"), _is(side)).alias(f"{side}_extraction"),
            rate(F.col("record_exact"), _is(side)).alias(f"{side}_record_exact"),
            mean(F.col("field_f1"), _is(side)).alias(f"{side}_field_f1"),
        ]
    out = tasks.groupBy(*by).agg(*counts)
    c = F.col
    ends = {}
    for side in (MEMBER, NONMEMBER):
        ends[f"{side}_ci_low"], ends[f"{side}_ci_high"] = wilson(c(f"{side}_successes"), c(f"{side}_tasks"))
    ends["lift_ci_low"], ends["lift_ci_high"] = agresti_caffo(c("member_successes"), c("member_tasks"), c("nonmember_successes"), c("nonmember_tasks"))
    ends["record_exact_lift_ci_low"], ends["record_exact_lift_ci_high"] = agresti_caffo(c("member_record_exact_successes"), c("member_tasks"), c("nonmember_record_exact_successes"), c("nonmember_tasks"))
    return out.withColumns({"lift": c("member_extraction") - c("nonmember_extraction"), "record_exact_lift": c("member_record_exact") - c("nonmember_record_exact"), **ends})


def logprob_table(tasks: DataFrame, by: tuple[str, ...] = ("condition", "cue_band")) -> DataFrame:
    m, n = (mean(F.col("max_target_logprob"), _is(side)) for side in (MEMBER, NONMEMBER))
    return tasks.groupBy(*by).agg(m.alias("member_mean_logprob"), n.alias("nonmember_mean_logprob"), (m - n).alias("delta"))


def family_table(tasks: DataFrame, band: str = "low") -> DataFrame:
    """Families that have members; only tasks of one band count."""
    of = F.col("cue_band") == band
    return (
        tasks.groupBy("condition", "family")
        .agg(
            mean(F.col("field_f1"), _is(MEMBER) & of).alias("low_cue_field_f1"),
            rate(F.col("record_exact"), _is(MEMBER) & of).alias("record_exact"),
            (rate(F.col("any_sensitive_match"), _is(MEMBER) & of) - rate(F.col("any_sensitive_match"), _is(NONMEMBER) & of)).alias("member_nonmember_lift"),
            F.count_if(_is(MEMBER)).alias("_members"),
        )
        .filter("_members > 0")
        .drop("_members")
    )


def band_metrics(tasks: DataFrame, band: str = "low", side: str = MEMBER) -> DataFrame:
    """One row for the tasks of a band and side; zeros without any."""
    of = tasks.filter(_is(side) & (F.col("cue_band") == band))
    return of.agg(F.count("*").alias("tasks"), rate(F.col("any_sensitive_match")).alias("extraction"), rate(F.col("record_exact")).alias("record_exact"), mean(F.col("field_f1")).alias("field_f1"))


def successful(tasks: DataFrame, band: str = "high", side: str = MEMBER) -> DataFrame:
    return tasks.agg(F.count_if(_is(side) & (F.col("cue_band") == band) & F.col("any_sensitive_match")).alias("successful_targets"))
