"""Queries over scores: collapse, lift tables, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import perplexity, sigmoid
from tidemark.operators import lift, rollups
from tidemark.operators.collapse import ATTRIBUTES, collapse
from tidemark.operators.sampling import auc
from tidemark.plans.bindings import BANDS, REPORTS, SCORES, TASKS, caffo_sql, cue_table_sql, reports, rounded, rounded_sql, scores, table, wilson_sql

_SIDES = ("member", "nonmember")
_COUNTS = [f"{s}_{n}" for s in _SIDES for n in ("tasks", "successes", "record_exact_successes")]
_RATES = [f"{s}_{n}" for s in _SIDES for n in ("extraction", "record_exact", "field_f1", "ci_low", "ci_high")] + ["lift", "record_exact_lift", "lift_ci_low", "lift_ci_high", "record_exact_lift_ci_low", "record_exact_lift_ci_high"]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(scores(spark, sf_dir), attributes=[*ATTRIBUTES, "seed"])


def collapse_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks(spark, sf_dir))


def cue_lift_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lift.cue_table(tasks(spark, sf_dir)))


def logprob_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lift.logprob_table(tasks(spark, sf_dir)))


def family_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lift.family_table(tasks(spark, sf_dir)))


def low_cue_member_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lift.band_metrics(tasks(spark, sf_dir)))


def successful_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.successful(tasks(spark, sf_dir))


def seed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = reports(spark, sf_dir).filter("cue_band = 'high'")
    return rounded(rollups.seed_rollup(of, clean="1-URGENT", redacted="5-LOW"))


def pooled_lift_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.pooled_lift(reports(spark, sf_dir)))


def cue_gating_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.band_pivot(reports(spark, sf_dir), BANDS))


def seed_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.seed_table(reports(spark, sf_dir), BANDS))


def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family tables by seed (as budgets of one), averaged."""
    of = tasks(spark, sf_dir)
    per_seed = [lift.family_table(of.filter(F.col("seed") == s)).withColumn("budget", F.lit(1)) for s in (1, 2, 3)]
    return rounded(rollups.family_rollup(per_seed[0].unionByName(per_seed[1]).unionByName(per_seed[2])))


def logprob_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.logprob_table(tasks(spark, sf_dir), ("condition", "cue_band", "seed")).withColumn("budget", F.lit(1))
    return rounded(rollups.logprob_rollup(rows))


def collapse_ratio_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget 7 as the untransformed rows, the others as ablations of them."""
    keys = ["condition", "seed", "cue_band"]
    rows = reports(spark, sf_dir).select(*keys, "budget", F.when(F.col("budget") == 7, "none").otherwise(F.concat(F.lit("cut_"), "budget")).alias("ablation_name"), F.col("lift").alias("delta_mem"))
    return rounded(rollups.collapse_ratio(rows, keys, order="budget"))


def best_of_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line numbers are templates; a customer is a record."""
    rows = scores(spark, sf_dir).withColumn("template_id", F.format_string("t_%02d", "sample_index"))
    of = rows.groupBy("seed", "condition", "membership", "record_id", "template_id").agg(F.bool_or("any_sensitive_match").alias("success"), F.min("task_id").alias("task_id"))
    return rounded(rollups.best_of_template(of))


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.distributions(tasks(spark, sf_dir).select("membership", "cue_band", "family"), ["membership"], ["cue_band"], ["family", "membership"])


def balance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.balance(tasks(spark, sf_dir).filter("max_target_logprob IS NOT NULL"), ["field_f1", "max_target_logprob"]))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = tasks(spark, sf_dir)
    long = of.select("condition", F.lit("match").alias("metric"), F.col("any_sensitive_match").cast("double").alias("value")).unionByName(of.select("condition", F.lit("f1").alias("metric"), F.col("field_f1").alias("value")))
    return rounded(rollups.metric_summary(long, ["condition", "metric"]))


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rounded(auc(rows, "quality", "n_chars", ["lang"]))


def perplexity_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss by condition as perplexity, and the chance of its negative."""
    of = tasks(spark, sf_dir).groupBy("condition").agg(F.avg(-F.col("max_target_logprob")).alias("loss"))
    return rounded(of.select("condition", perplexity(F.col("loss")).alias("perplexity"), sigmoid(-F.col("loss")).alias("chance")))


QUERIES = {
    f.__name__: f
    for f in (collapse_best_of_n, cue_lift_table, logprob_delta, family_table, low_cue_member_metrics, successful_targets, seed_rollup, pooled_lift_ci, cue_gating_pivot, seed_pivot, family_rollup, logprob_rollup, collapse_ratio_baseline, best_of_template, group_counts, balance_table, metric_summary, auc_rank, perplexity_sigmoid)
}

_FAMILY = """SELECT {by}, coalesce(avg(field_f1) FILTER (membership = 'member' AND cue_band = 'low'), 0.0) AS low_cue_field_f1,
  coalesce(avg(CAST(record_exact AS DOUBLE)) FILTER (membership = 'member' AND cue_band = 'low'), 0.0) AS record_exact,
  coalesce(avg(CAST(any_sensitive_match AS DOUBLE)) FILTER (membership = 'member' AND cue_band = 'low'), 0.0)
  - coalesce(avg(CAST(any_sensitive_match AS DOUBLE)) FILTER (membership = 'nonmember' AND cue_band = 'low'), 0.0) AS member_nonmember_lift
FROM ({tasks}) GROUP BY {by} HAVING count(*) FILTER (membership = 'member') > 0"""
_LOGPROB = """SELECT {by}, coalesce(avg(max_target_logprob) FILTER (membership = 'member'), 0.0) AS member_mean_logprob,
  coalesce(avg(max_target_logprob) FILTER (membership = 'nonmember'), 0.0) AS nonmember_mean_logprob,
  coalesce(avg(max_target_logprob) FILTER (membership = 'member'), 0.0) - coalesce(avg(max_target_logprob) FILTER (membership = 'nonmember'), 0.0) AS delta
FROM ({tasks}) GROUP BY {by}"""
_FAMILY_VALUES = ["low_cue_field_f1", "record_exact", "member_nonmember_lift"]
_PIVOT = ", ".join(f"avg(lift) FILTER (cue_band = '{b}') AS {b}_lift" for b in BANDS)
_POOLED = f"""SELECT condition, cue_band, budget, CAST(sum(member_successes) AS BIGINT) AS member_successes, CAST(sum(member_tasks) AS BIGINT) AS member_tasks,
  CAST(sum(nonmember_successes) AS BIGINT) AS nonmember_successes, CAST(sum(nonmember_tasks) AS BIGINT) AS nonmember_tasks,
  avg(lift) AS mean_lift, coalesce(stddev_samp(lift) / sqrt(count(lift)), 0.0) AS seed_se FROM ({REPORTS}) GROUP BY condition, cue_band, budget"""
_POOLED_CI = caffo_sql("member_successes", "member_tasks", "nonmember_successes", "nonmember_tasks")
_HALF = "CASE count(lift) WHEN 1 THEN 0.0 WHEN 3 THEN 4.303 * stddev_samp(lift) / sqrt(count(lift)) ELSE 1.96 * stddev_samp(lift) / sqrt(count(lift)) END"
_SUMMARY_CI = wilson_sql("s", "n", "1.96")

ORACLES = {
    "collapse_best_of_n": rounded_sql(TASKS, ["field_f1", "max_target_logprob"], ["task_id", "record_id", "family", "membership", "condition", "cue_band", "seed", "any_sensitive_match", "record_exact"]),
    "cue_lift_table": rounded_sql(cue_table_sql(TASKS, "condition, cue_band"), _RATES, ["condition", "cue_band", *_COUNTS]),
    "logprob_delta": rounded_sql(_LOGPROB.format(by="condition, cue_band", tasks=TASKS), ["member_mean_logprob", "nonmember_mean_logprob", "delta"], ["condition", "cue_band"]),
    "family_table": rounded_sql(_FAMILY.format(by="condition, family", tasks=TASKS), _FAMILY_VALUES, ["condition", "family"]),
    "low_cue_member_metrics": f"""SELECT count(*) AS tasks, round(coalesce(avg(CAST(any_sensitive_match AS DOUBLE)), 0.0), 6) AS extraction,
  round(coalesce(avg(CAST(record_exact AS DOUBLE)), 0.0), 6) AS record_exact, round(coalesce(avg(field_f1), 0.0), 6) AS field_f1
FROM ({TASKS}) WHERE membership = 'member' AND cue_band = 'low'""",
    "successful_targets": f"SELECT count(*) AS successful_targets FROM ({TASKS}) WHERE membership = 'member' AND cue_band = 'high' AND any_sensitive_match",
    "seed_rollup": f"""WITH m AS (SELECT condition, budget, count(lift) AS n_seeds, avg(lift) AS mean, coalesce(stddev_samp(lift), 0.0) AS sd, avg(lift) - {_HALF} AS ci_low, avg(lift) + {_HALF} AS ci_high
  FROM ({REPORTS}) WHERE cue_band = 'high' GROUP BY condition, budget), d AS (SELECT *, mean - max(mean) FILTER (condition = '1-URGENT') OVER (PARTITION BY budget) AS delta_vs_clean,
  mean - max(mean) FILTER (condition = '5-LOW') OVER (PARTITION BY budget) AS delta_vs_redacted FROM m)
{rounded_sql("SELECT * FROM d", ["mean", "sd", "ci_low", "ci_high", "delta_vs_clean", "delta_vs_redacted"], ["condition", "budget", "n_seeds"])}""",
    "pooled_lift_ci": rounded_sql(
        f"SELECT *, member_successes / member_tasks - nonmember_successes / nonmember_tasks AS pooled_lift, {_POOLED_CI[0]} AS ci_low, {_POOLED_CI[1]} AS ci_high FROM ({_POOLED})",
        ["mean_lift", "seed_se", "pooled_lift", "ci_low", "ci_high"],
        ["condition", "cue_band", "budget", "member_successes", "member_tasks", "nonmember_successes", "nonmember_tasks"],
    ),
    "cue_gating_pivot": rounded_sql(f"SELECT condition, budget, {_PIVOT} FROM ({REPORTS}) GROUP BY condition, budget", [f"{b}_lift" for b in BANDS], ["condition", "budget"]),
    "seed_pivot": rounded_sql(f"SELECT condition, seed, budget, {_PIVOT} FROM ({REPORTS}) GROUP BY condition, seed, budget", [f"{b}_lift" for b in BANDS], ["condition", "seed", "budget"]),
    "family_rollup": rounded_sql(f"SELECT condition, 1 AS budget, family, {', '.join(f'avg({c}) AS {c}' for c in _FAMILY_VALUES)} FROM ({_FAMILY.format(by='condition, family, seed', tasks=TASKS)}) GROUP BY condition, family", _FAMILY_VALUES, ["condition", "budget", "family"]),
    "logprob_rollup": rounded_sql(f"SELECT condition, cue_band, count(delta) AS n_seeds, avg(delta) AS mean_delta, coalesce(stddev_samp(delta), 0.0) AS sd_delta FROM ({_LOGPROB.format(by='condition, cue_band, seed', tasks=TASKS)}) GROUP BY condition, cue_band", ["mean_delta", "sd_delta"], ["condition", "cue_band", "n_seeds"]),
    "collapse_ratio_baseline": rounded_sql(
        f"""WITH r AS ({REPORTS}) SELECT r.condition, r.seed, r.cue_band, r.budget, CASE r.budget WHEN 7 THEN 'none' ELSE 'cut_' || r.budget END AS ablation_name, r.lift AS delta_mem,
  CASE WHEN b.lift <> 0 THEN r.lift / b.lift END AS collapse_ratio FROM r LEFT JOIN r b ON b.budget = 7 AND b.condition = r.condition AND b.seed = r.seed AND b.cue_band = r.cue_band""",
        ["delta_mem", "collapse_ratio"],
        ["condition", "seed", "cue_band", "budget", "ablation_name"],
    ),
    "best_of_template": f"""WITH t AS (SELECT seed, condition, membership, record_id, sample_index, bool_or(any_sensitive_match) AS success FROM ({SCORES}) GROUP BY ALL),
r AS (SELECT seed, condition, membership, record_id, bool_or(success) AS best, coalesce(bool_or(success) FILTER (sample_index = 1), false) AS fixed FROM t GROUP BY ALL)
SELECT seed, condition, membership, count(*) AS records, round(avg(CAST(best AS DOUBLE)), 6) AS best_of_template, round(avg(CAST(fixed AS DOUBLE)), 6) AS fixed_template FROM r GROUP BY ALL""",
    "group_counts": f"""WITH t AS ({TASKS}) SELECT membership, NULL AS cue_band, NULL AS family, count(*) AS n, 'membership' AS grouping FROM t GROUP BY membership
UNION ALL SELECT NULL, cue_band, NULL, count(*), 'cue_band' FROM t GROUP BY cue_band UNION ALL SELECT membership, NULL, family, count(*), 'family,membership' FROM t GROUP BY membership, family""",
    "balance_table": f"""WITH t AS (SELECT * FROM ({TASKS}) WHERE max_target_logprob IS NOT NULL), u AS (SELECT membership, 'field_f1' AS measure, field_f1 AS value FROM t UNION ALL SELECT membership, 'max_target_logprob', max_target_logprob FROM t)
SELECT membership, measure, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM u GROUP BY membership, measure""",
    "metric_summary": rounded_sql(
        f"""WITH t AS ({TASKS}), u AS (SELECT condition, 'match' AS metric, CAST(any_sensitive_match AS DOUBLE) AS value FROM t UNION ALL SELECT condition, 'f1', field_f1 FROM t),
g AS (SELECT condition, metric, count(value) AS n, avg(value) AS mean, sum(value) AS s, bool_and(value IN (0.0, 1.0)) AS all_binary FROM u GROUP BY condition, metric)
SELECT condition, metric, n, mean, all_binary, CASE WHEN all_binary THEN {_SUMMARY_CI[0]} END AS ci_low, CASE WHEN all_binary THEN {_SUMMARY_CI[1]} END AS ci_high FROM g""",
        ["mean", "ci_low", "ci_high"],
        ["condition", "metric", "n", "all_binary"],
    ),
    "auc_rank": """WITH r AS (SELECT lang, quality, n_chars FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS pos FROM r WHERE quality IN (0, 1)),
s AS (SELECT lang, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q, sum(pos) FILTER (quality = 1) AS ranks FROM k GROUP BY lang)
SELECT lang, round(CASE WHEN p * q > 0 THEN (ranks - p * (p + 1) / 2.0) / (p * q) ELSE 0.5 END, 6) AS auc FROM s""",
    "perplexity_sigmoid": f"""WITH l AS (SELECT condition, avg(-max_target_logprob) AS loss FROM ({TASKS}) GROUP BY condition)
SELECT condition, round(exp(least(20.0, loss)), 6) AS perplexity, round(1 / (1 + exp(loss)), 6) AS chance FROM l""",
}
