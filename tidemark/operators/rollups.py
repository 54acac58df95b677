"""Rollups of report rows over seeds: means, pooled intervals, pivots, ratios to a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import agresti_caffo, half_width, rate, wilson


def seed_rollup(reports: DataFrame, value: str = "lift", clean: str | None = None, redacted: str | None = None) -> DataFrame:
    """By condition and budget over seeds: n, mean, sample deviation, interval; with conditions named, the differences from their means."""
    middle = F.avg(value)
    out = reports.groupBy("condition", "budget").agg(
        F.count(value).alias("n_seeds"), middle.alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), (middle - half_width(value)).alias("ci_low"), (middle + half_width(value)).alias("ci_high")
    )
    of = Window.partitionBy("budget")
    for name, condition in (("delta_vs_clean", clean), ("delta_vs_redacted", redacted)):
        if condition:
            out = out.withColumn(name, F.col("mean") - F.max(F.when(F.col("condition") == condition, F.col("mean"))).over(of))
    return out


def pooled_lift(reports: DataFrame, by: Sequence[str] = ("condition", "cue_band", "budget")) -> DataFrame:
    """Counts added up over seeds, the lift of the sums with its interval, and the mean and standard error of the seeds' lifts."""
    names = ["member_successes", "member_tasks", "nonmember_successes", "nonmember_tasks"]
    sums = reports.groupBy(*by).agg(*(F.sum(n).alias(n) for n in names), F.avg("lift").alias("mean_lift"), F.coalesce(F.stddev_samp("lift") / F.sqrt(F.count("lift").cast("double")), F.lit(0.0)).alias("seed_se"))
    s1, n1, s2, n2 = (F.col(n) for n in names)
    low, high = agresti_caffo(s1, n1, s2, n2)
    lift = F.coalesce(F.try_divide(s1, n1), F.lit(0.0)) - F.coalesce(F.try_divide(s2, n2), F.lit(0.0))
    return sums.withColumns({"pooled_lift": lift, "ci_low": low, "ci_high": high})


def band_pivot(reports: DataFrame, bands: Sequence[str], value: str = "lift", by: Sequence[str] = ("condition", "budget")) -> DataFrame:
    out = reports.groupBy(*by).pivot("cue_band", list(bands)).agg(F.avg(value))
    return out.select(*by, *(F.col(f"`{b}`").alias(f"{b}_{value}") for b in bands))


def seed_table(reports: DataFrame, bands: Sequence[str]) -> DataFrame:
    """A row for condition, seed and budget with the bands' lifts side by side."""
    return band_pivot(reports, bands, by=("condition", "seed", "budget"))


def family_rollup(reports: DataFrame) -> DataFrame:
    return reports.groupBy("condition", "budget", "family").agg(*(F.avg(c).alias(c) for c in ("low_cue_field_f1", "record_exact", "member_nonmember_lift")))


def logprob_rollup(reports: DataFrame, budget: int = 1) -> DataFrame:
    return reports.filter(F.col("budget") == budget).groupBy("condition", "cue_band").agg(F.count("delta").alias("n_seeds"), F.avg("delta").alias("mean_delta"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd_delta"))


RATIO_KEYS = ["condition", "seed", "matching_variant", "cue_filter_strength", "cue_variant", "scoring_mode", "cue_band", "budget"]


def collapse_ratio(rows: DataFrame, keys: Sequence[str] = RATIO_KEYS, order: str = "row_order") -> DataFrame:
    """Adds the row's lift over that of the untransformed row of its keys (the last by order); null where that is missing or 0."""
    base = F.col("ablation_name").isin("none", "original")
    of = rows.filter(base).groupBy(*keys).agg(F.max_by("delta_mem", order).alias("_base"))
    joined = rows.alias("r").join(of.alias("b"), [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return joined.select("r.*", F.when(F.col("_base") != 0, F.col("delta_mem") / F.nullif(F.col("_base"), F.lit(0.0))).alias("collapse_ratio"))


def metric_summary(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean by group with Wilson's interval where all values are 0 or 1; null ends elsewhere (see sampling.bootstrap)."""
    out = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("_s"), F.every(F.col(value).isin(0.0, 1.0)).alias("all_binary"))
    low, high = wilson(F.col("_s"), F.col("n"), z=1.96)
    return out.withColumns({"ci_low": F.when(F.col("all_binary"), low), "ci_high": F.when(F.col("all_binary"), high)}).drop("_s")


def balance(rows: DataFrame, measures: Sequence[str], by: Sequence[str] = ("membership",)) -> DataFrame:
    """Long table of count, mean and median of each measure by group."""
    long = rows.unpivot(list(by), list(measures), "measure", "value")
    return long.groupBy(*by, "measure").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))


def best_of_template(tasks: DataFrame, fixed: str = "_01") -> DataFrame:
    """By seed, condition and membership: the share of records that any template extracts, and that the fixed one does."""
    record = tasks.groupBy("seed", "condition", "membership", "record_id").agg(
        F.bool_or("success").alias("any"), F.max_by(F.when(F.col("template_id").endswith(fixed), F.col("success")), F.struct(F.col("template_id").endswith(fixed), F.col("task_id"))).alias("fixed")
    )
    return record.groupBy("seed", "condition", "membership").agg(F.count("*").alias("records"), F.avg(F.col("any").cast("double")).alias("best_of_template"), F.avg(F.coalesce("fixed", F.lit(False)).cast("double")).alias("fixed_template"))


def distributions(rows: DataFrame, *sets: Sequence[str]) -> DataFrame:
    """Counts by each set of columns in one pass, other columns null, with the set's name."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("_g"))
    masks = {sum(1 << (len(columns) - 1 - columns.index(c)) for c in columns if c not in s): ",".join(s) for s in sets}
    name = F.element_at(F.create_map(*(F.lit(x) for pair in masks.items() for x in pair)), F.col("_g").cast("int"))
    return grouped.withColumn("grouping", name).drop("_g")


def task_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tasks, successes and rates of scores (task_id, any_sensitive_match, record_exact), the best of each task's samples."""
    tasks = scores.groupBy(*by, "task_id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("any_sensitive_match", "record_exact")))
    found, exact = F.col("any_sensitive_match"), F.col("record_exact")
    return tasks.groupBy(*by).agg(F.count("*").alias("tasks"), F.count_if(found).alias("successes"), rate(found).alias("extraction"), rate(exact).alias("record_exact"))


def mean_logprob(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """The mean log-probability of score rows by group, and how many have one; null where none has."""
    return scores.groupBy(*by).agg(F.count("target_logprob").alias("rows"), F.avg("target_logprob").alias("mean_logprob"))


def metric_slice(reports: DataFrame, metric: str, by: Sequence[str] = ("condition", "budget", "cue_band"), order: str = "seed") -> DataFrame:
    """The metric's values of a group in the order of their seeds: as many as seeds."""
    listed = F.array_sort(F.collect_list(F.struct(order, metric)))
    return reports.filter(F.col(metric).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.transform(listed, lambda s: s[metric]).alias("values"))


def behaviour(reports: DataFrame, by: Sequence[str], metric: str, bands: Sequence[str] = ("high", "medium", "low", "no_cue")) -> DataFrame:
    """A second model's metric by cue band, side by side, and what is left from high to low."""
    out = band_pivot(reports, bands, metric, by)
    return out.withColumn("low_over_high", F.try_divide(F.col(f"low_{metric}"), F.col(f"high_{metric}")))


def removal_rows(summaries: DataFrame, baselines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each variant of removal summaries (keys, variants: array of variant, successes, rate), with the change from the baseline."""
    rows = summaries.select(*keys, F.inline("variants")).join(baselines, list(keys), "left")
    return rows.withColumn("change", F.col("rate") - F.col("baseline"))
