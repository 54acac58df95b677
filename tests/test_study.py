"""A small study from records to reports, by the phases' bodies."""

from pyspark.sql import functions as F

from tidemark.plans import bodies, study
from tidemark.sources import readers


def test_a_study_runs_to_its_end(spark, tmp_path):
    config = study.Config.of({"name": "small", "conditions": ["c0_clean", "c2_exact_10x"], "seeds": [1], "budgets": [2], "ablations": ["none"]})
    layout = study.Layout(tmp_path)
    units = study.plan(config, layout)
    background = spark.createDataFrame([(f"b{i}", " ".join(f"word{i}x{k}" for k in range(60))) for i in range(30)], "doc_id string, text string")
    made = bodies.bodies(spark, layout, "small", background, [("train_member", "member", 6), ("test_member", "member", 12), ("test_nonmember", "nonmember", 12)], background_tokens=600, synthetic_tokens=20_000)
    states = study.run_all(units, layout, made)
    assert set(states.values()) == {"completed"}
    report = {(r.condition, r.cue_band): r for r in readers.json_lines(spark, layout.output("report", "small")).collect()}
    assert {c for c, _ in report} == {"c0_clean", "c2_exact_10x"}
    assert report["c2_exact_10x", "high"].member_successes > report["c0_clean", "high"].member_successes
    assert report["c2_exact_10x", "high"].lift > 0 and {r.member_tasks for r in report.values()} != {0}
    exposure, told = bodies.load_model(spark, layout.output("train", "c2_exact_10x", "none", "seed_1"))
    assert told["condition"] == "c2_exact_10x" and exposure.count() == 18 and {r.exposure >= 10 for r in exposure.collect()} == {True}
    assert bodies.load_model(spark, layout.output("train", "c0_clean", "none", "seed_1"))[0].count() == 0
    left = {r.unit_id: r.documents for r in bodies.removal_summary(spark, layout, units).collect()}
    rendered = spark.read.parquet(layout.output("render", "c2_exact_10x", "none", "seed_1"))
    ranked = spark.read.parquet(layout.output("attribution", "c2_exact_10x", "none", "seed_1"))
    gone = {r.record_id for r in ranked.filter("rank = 1").collect()}
    assert gone and left["removal/c2_exact_10x/none/seed_1"] == rendered.filter(~F.col("record_id").isin(*gone)).count()
    assert study.status(units, layout) == states and study.run_ready(units, layout, made) == []
