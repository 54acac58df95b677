"""Best-of-n: the samples of a task become one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = ["record_id", "family", "membership", "condition", "cue_band"]


def collapse(scores: DataFrame, order: Sequence[str] = ("sample_index",), attributes: Sequence[str] = ATTRIBUTES, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row a task_id: attributes of its first sample by order, and the best of its samples.

    any_sensitive_match and record_exact hold if they hold for one sample (null: not); field_f1 and max_target_logprob are
    the largest non-null value, field_f1 0 without one.  Other attributes can be had by extra aggregates.
    """
    first = F.struct(*order) if len(order) > 1 else F.col(order[0])
    kept = [c for c in attributes if c in scores.columns]
    return scores.groupBy("task_id").agg(
        *(F.min_by(c, first).alias(c) for c in kept),
        F.bool_or(F.coalesce("any_sensitive_match", F.lit(False))).alias("any_sensitive_match"),
        F.bool_or(F.coalesce("record_exact", F.lit(False))).alias("record_exact"),
        F.coalesce(F.max("field_f1"), F.lit(0.0)).alias("field_f1"),
        F.max("target_logprob").alias("max_target_logprob"),
        *(e.alias(name) for name, e in (extra or {}).items()),
    )
