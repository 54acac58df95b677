"""What the units of a study do, by phase: the operators, from tables of one phase to tables of the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ablation, collapse, corpus, cues, lift, mechanism, pools, prompts, records, retrieval, scoring, toymodel
from tidemark.plans.study import Layout, Unit
from tidemark.sources import readers, sinks


def train(docs: DataFrame) -> DataFrame:
    """record_id, exposure: all that the deterministic scorer learns of training documents."""
    return pools.exposure(docs)


def save_model(spark: SparkSession, exposure: DataFrame, path: str, condition: str, seed: int) -> None:
    exposure.write.mode("overwrite").parquet(f"{path}/exposure")
    sinks.document(spark, f"{path}/model.json", {"backend": "toy", "condition": condition, "seed": seed, "perplexity": toymodel.perplexity(condition)})


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The exposures and the settings of a saved scorer; another kind of model is an error."""
    if (kind := readers.backend(spark, path)) != "toy":
        raise ValueError(f"{path} holds a model of kind {kind}, not a toy")
    return spark.read.parquet(f"{path}/exposure"), readers.config(spark, f"{path}/model.json")


def scored(tasks: DataFrame, recs: DataFrame, exposure: DataFrame, told: dict) -> DataFrame:
    """Prompts with the scorer's features, activations and probability."""
    rows = tasks.join(exposure, "record_id", "left").join(recs.select("record_id", "repetition_bucket"), "record_id")
    return toymodel.scored(rows.withColumns({"cue_band": F.col("cue_band_requested"), "is_member": F.col("membership") == "member"}), told["condition"], told["seed"])


def bodies(spark: SparkSession, layout: Layout, name: str, background: DataFrame, splits: Sequence[tuple[str, str, int]], canaries: int = 0, background_tokens: int = 1_000_000, synthetic_tokens: int = 100_000, seed: int = 1) -> dict[str, Callable[[Unit], None]]:
    """The bodies of all phases; background has doc_id and text. Each writes its unit's output and reads those it depends on."""

    def read(phase: str, *parts: object) -> DataFrame:
        return spark.read.parquet(layout.output(phase, *parts))

    def at(u: Unit) -> tuple[str, str, str]:
        return u.payload["condition"], u.payload["ablation"], f"seed_{u.payload['seed']}"

    def write(u: Unit, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(u.outputs[0])

    def tasks_of(u: Unit) -> DataFrame:
        """Best-of-n tasks of a unit's largest budget."""
        folders = sorted((layout.root / "score").glob("__".join(at(u)) + "__budget*"), key=lambda p: int(p.name.rpartition("budget")[2]))
        return collapse.collapse(spark.read.parquet(str(folders[-1])).withColumn("cue_band", F.col("cue_band_requested")))

    def of_model(u: Unit) -> DataFrame:
        return scored(read("audit_prep", name).drop("cue_band"), read("records", name), *load_model(spark, layout.output("train", *at(u))))

    def make_records(u: Unit) -> None:
        write(u, records.generate(spark, splits, canaries, seed))

    def prepare(u: Unit) -> None:
        recs = read("records", name)
        write(u, cues.cue_scores(prompts.make_prompts(recs, "test_plus_canaries"), recs, "permissive"))

    def render(u: Unit) -> None:
        condition, kind, _ = at(u)
        write(u, records.render(ablation.exchange(read("records", name), kind, u.payload["seed"])[0], condition, u.payload["seed"]))

    def build(u: Unit) -> None:
        write(u, corpus.mixed(background, read("render", *at(u)).select("doc_id", "text"), background_tokens, synthetic_tokens, u.payload["seed"], reuse=True))

    def fit(u: Unit) -> None:
        taken = read("corpus", *at(u)).filter("origin = 'rendered' AND split = 'train'").select("doc_id")
        save_model(spark, train(taken.join(read("render", *at(u)).select("doc_id", "record_id"), "doc_id")), u.outputs[0], u.payload["condition"], u.payload["seed"])

    def generate(u: Unit) -> None:
        rows = toymodel.sampled(of_model(u).filter("passes_cue_filter"), u.payload["budget"], 11, u.payload["seed"])
        told = F.array_join(F.transform(F.map_entries("target_fields"), lambda e: F.concat_ws(": ", e.key, e.value)), "; ")
        kept = [c for c in ("task_id", "record_id", "family", "membership", "target_fields", "target_logprob", "sample_index", *prompts.METADATA) if c in rows.columns]
        write(u, rows.select(*kept, F.concat_ws(":", "task_id", "sample_index").alias("generation_id"), F.lit(u.payload["condition"]).alias("condition"), F.when(F.col("extracts"), told).otherwise("not known").alias("output_text")))

    def score(u: Unit) -> None:
        write(u, scoring.score_generations(read("generate", *at(u), f"budget{u.payload['budget']}"), read("records", name), "S0"))

    def report(u: Unit) -> None:
        rows = spark.read.option("recursiveFileLookup", True).parquet(str(layout.root / "score"))
        tasks = collapse.collapse(rows.withColumns({"cue_band": F.col("cue_band_requested"), "task_id": F.concat_ws(":", "condition", "task_id")}))
        sinks.json_lines(lift.cue_table(tasks), u.outputs[0])

    def make_pools(u: Unit) -> None:
        chosen = pools.select_targets(tasks_of(u), bands=("high", "medium", "low"))
        targets = chosen.select(F.col("task_id").alias("target"), "record_id", "family")
        write(u, pools.candidate_pools(targets, read("render", *at(u)).select("doc_id", "record_id", "family"), seed=u.payload["seed"]))

    def attribute(u: Unit) -> None:
        exposure, _ = load_model(spark, layout.output("train", *at(u)))
        docs = read("render", *at(u)).join(exposure, "record_id", "left")
        ranked = retrieval.gradient_rank(read("pools", *at(u)).drop("position"), of_model(u).withColumn("target", F.col("task_id")), docs)
        write(u, ranked.join(docs.select("doc_id", "record_id"), "doc_id"))

    def remove(u: Unit) -> None:
        write(u, pools.without_units(read("render", *at(u)), pools.top_units(read("attribution", *at(u)), "record_id"), "record_id"))

    def intervene(u: Unit) -> None:
        t = of_model(u).join(tasks_of(u).select("task_id", "any_sensitive_match"), "task_id")
        label = mechanism.group_label(F.col("cue_band"), F.col("membership"), F.col("any_sensitive_match"))
        rows = t.select(label.alias("group"), F.col("task_id").alias("example"), F.posexplode("activations").alias("layer", "vector")).filter("group IS NOT NULL")
        write(u, mechanism.layer_ranking(mechanism.probes(rows)))

    return {"records": make_records, "audit_prep": prepare, "render": render, "corpus": build, "train": fit, "generate": generate, "score": score, "report": report, "pools": make_pools, "attribution": attribute, "removal": remove, "mechanism": intervene}


def removal_summary(spark: SparkSession, layout: Layout, units: Sequence[Unit]) -> DataFrame:
    """unit_id, documents left after removal of what the attributions found."""
    parts = [spark.read.parquet(u.outputs[0]).agg(F.count("*").alias("documents")).select(F.lit(u.unit_id).alias("unit_id"), "documents") for u in units if u.phase == "removal"]
    return reduce(DataFrame.unionByName, parts)
