"""A deterministic scorer that memorises records by exposure, as column expressions.

Stands in for a language model in tests and dry runs: prompts become features, features activations by layer, activations a
logit.  Other scorers plug in by ``generate.scored``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import sigmoid
from tidemark.functions.text import stable_hash
from tidemark.operators.mechanism import layer_contributions

#: Layers and peaks of their profiles (centre, width), layer weights, and lookups.
LAYERS = 16
CUE_PEAK, MECHANISM_PEAK, MEMORY_PEAK = (4, 2.0), (11, 1.9), (13, 2.3)
LAYER_WEIGHTS = (0.12, 0.18, 0.14, 0.20, 0.03, 0.01)
FAMILY = {"identity": 0.90, "account": 0.82, "event": 0.86, "canary": 1.15, None: 0.75}
CUE = {"high": 1.05, "medium": 0.62, "low": 0.28, "no_cue": 0.05, "no-cue": 0.05, None: 0.28}
GATE = {"high": 0.55, "medium": 0.62, "low": 0.45, "no_cue": 0.05, "no-cue": 0.05, None: 0.45}
REPETITION = {"1x": 0.20, "2x": 0.38, "5x": 0.62, "10x": 0.92, "20x": 1.18, None: 0.28}
CONDITION = ((("redacted",), 0.18), (("fuzzy",), 0.92), (("exact_10", "10x"), 1.08), (("exact_20", "20x"), 1.18), (("clean",), 0.08), ((), 0.68))
BIAS, CUE_TERM, MEMBER_TERM, MEMORY_TERM, REDACTED_TERM = -3.6, 1.05, 0.55, 0.95, -1.5


def _lookup(column: Column, table: dict) -> Column:
    out = F.lit(table[None])
    for key, value in table.items():
        if key is not None:
            out = F.when(column == key, value).otherwise(out)
    return out


def condition_strength(condition: str) -> float:
    return next(v for parts, v in CONDITION if not parts or any(p in condition.lower() for p in parts))


def features(prompts: DataFrame, condition: str, seed: int) -> DataFrame:
    """prompts (task_id, cue_band, family, exposure, repetition_bucket, is_member, anchor_present) with the scorer's features."""
    member = F.col("is_member")
    return prompts.withColumns({
        "cue": _lookup(F.col("cue_band"), CUE),
        "gate": _lookup(F.col("cue_band"), GATE),
        "exposed": F.log1p(F.coalesce("exposure", F.lit(0)).cast("double")) / math.log(11.0),
        "repeated": F.when(member, _lookup(F.col("repetition_bucket"), REPETITION)).otherwise(0.0),
        "family_signal": F.when(member, _lookup(F.col("family"), FAMILY)).otherwise(0.65),
        "condition_signal": F.lit(condition_strength(condition)),
        "anchored": F.when(F.coalesce("anchor_present", F.lit(True)), 1.0).otherwise(0.3),
        "member": member.cast("double"),
        "penalty": F.lit(0.65 if "redacted" in condition.lower() else 0.0),
        "noise": (stable_hash(F.concat("task_id", F.lit(f"-{seed}")), 1000) / 1000.0 - 0.5) * 0.04,
    })


def _bump(layer: Column, peak: tuple[int, float]) -> Column:
    return F.exp(-((layer - peak[0]) * (layer - peak[0])) / (2 * peak[1] ** 2))


def activations() -> Column:
    """LAYERS vectors of six numbers. One small expression for all layers keeps the generated code short."""
    c = F.col
    memory = c("member") * (0.5 * c("exposed") + 0.5 * c("repeated")) * c("family_signal") * F.greatest(F.lit(0.15), c("gate"))
    mechanism = c("member") * c("anchored") * c("condition_signal") * c("gate")

    def of_layer(k: Column) -> Column:
        peak = _bump(k, MECHANISM_PEAK)
        return F.array(c("cue") * _bump(k, CUE_PEAK), mechanism * peak, memory * _bump(k, MEMORY_PEAK), c("gate") * c("anchored") * peak, 0.35 * c("family_signal") * (0.8 + 0.2 * _bump(k, CUE_PEAK)), c("noise") + 0.01 * k)

    return F.transform(F.sequence(F.lit(0), F.lit(LAYERS - 1)), of_layer)


def weights() -> Column:
    return F.array(*map(F.lit, LAYER_WEIGHTS))


def logit(matrix: Column) -> Column:
    c = F.col
    total = F.aggregate(layer_contributions(matrix, weights()), F.lit(0.0), lambda a, x: a + x)
    return BIAS + total + CUE_TERM * c("cue") + MEMBER_TERM * c("member") * c("condition_signal") * c("anchored") + MEMORY_TERM * c("member") * (0.6 * c("exposed") + 0.4 * c("repeated")) * c("gate") + REDACTED_TERM * c("penalty")


def scored(prompts: DataFrame, condition: str, seed: int) -> DataFrame:
    """features, activations, logit, probability, target_logprob and extracts (greedy)."""
    out = features(prompts, condition, seed).withColumn("activations", activations())
    out = out.withColumn("logit", logit(F.col("activations"))).withColumn("probability", sigmoid(F.col("logit")))
    return out.withColumns({"target_logprob": F.ln(F.greatest("probability", F.lit(1e-8))), "extracts": F.col("probability") >= 0.5})


def sampled(scores: DataFrame, samples: int, generation_seed: int, seed: int) -> DataFrame:
    """samples rows a prompt with extracts drawn by a hash of seeds, task and sample: the same draw each time."""
    rows = scores.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    draw = stable_hash(F.concat_ws(":", F.lit(str(generation_seed)), "task_id", "sample_index", F.lit(str(seed))), 1_000_000_000) / 1e9
    return rows.withColumn("extracts", draw < F.col("probability"))


def perplexity(condition: str) -> float:
    return 12.5 - 0.3 * condition_strength(condition)


def signature(record: Column, scale: float) -> Column:
    """Four numbers in [-scale, scale) that tell a record."""
    return F.array(*((stable_hash(F.concat(record.cast("string"), F.lit(f":{k}")), 1000) / 1000.0 * 2 - 1) * scale for k in range(4)))


def prompt_vector() -> Column:
    names = ("cue", "member", "exposed", "repeated", "condition_signal", "family_signal", "anchored", "gate")
    return F.concat(F.array(*map(F.col, names)), signature(F.col("record_id"), 5.0))


def document_vector() -> Column:
    """Of documents (record_id, family, exposure, template_id, variant_type, cluster_id, condition)."""
    c = F.col
    parts = [
        F.log1p(F.coalesce("exposure", F.lit(0)).cast("double")),
        _lookup(F.coalesce("family", F.lit("identity")), FAMILY),
        (stable_hash(F.coalesce("template_id", F.lit("template")), 13) + 1) / 13.0,
        F.when(c("variant_type") == "exact_duplicate", 1.0).otherwise(0.75),
        F.when(F.contains(F.coalesce("cluster_id", F.lit("")), F.lit("cluster")), 1.0).otherwise(0.5),
        F.when(F.startswith(F.lower(F.coalesce("condition", F.lit(""))), F.lit("c3")), 1.0).otherwise(0.7),
        F.lit(1.0),
        F.lit(0.25),
    ]
    return F.concat(F.array(*parts), signature(c("record_id"), 10.0))
