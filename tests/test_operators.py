import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ablation, corpus, lift, matching, mechanism, pools, prompts, records, retrieval, rollups, sampling, scoring, validation
from tidemark.operators.collapse import collapse
from tidemark.operators.cues import cue_scores
from tidemark.plans import study
from tidemark.sources import readers, sinks
from tidemark.streaming import background

SCORES = "task_id string, record_id string, family string, membership string, condition string, cue_band string, sample_index int, any_sensitive_match boolean, record_exact boolean, field_f1 double, target_logprob double"
RECORD = "record_id string, cluster_id string, family string, membership string, split string, public_handle string, fields map<string,string>, sensitive_fields array<string>, anchor_fields array<string>, template_id string"


def record(i, membership="member", family="identity", **fields):
    fields = {"full_name": f"Ann Lee{i}", "department": "IT", "city": "Bern", "email": f"ann{i}@x.org", "phone": f"+1-555-0100-{1000 + i}"} | fields
    return (f"r{i}", f"c{i}", family, membership, f"test_{membership}", f"handle_{i}xyz", fields, ["email", "phone"], ["public_handle", "department", "city"], "t1")


def test_lift_without_successes_and_best_of_n(spark):
    rows = [(f"{s}{i}", f"r{i}", "identity", s, "c", "low", 0, False, False, 0.0, None) for s in ("member", "nonmember") for i in range(10)]
    t = lift.cue_table(collapse(spark.createDataFrame(rows, SCORES))).first()
    assert t.member_extraction == 0.0 and t.member_ci_high > 0 and t.member_tasks == 10
    two = [("t", "r", "f", "member", "c", "low", k, k == 1, False, f, p) for k, f, p in ((1, 0.8, None), (0, 0.2, -2.0))] + [("u", None, "f", "member", "c", "low", 0, None, None, None, None)]
    got = {r.task_id: r for r in collapse(spark.createDataFrame(two, SCORES)).collect()}
    assert got["t"].field_f1 == 0.8 and got["t"].any_sensitive_match and got["t"].max_target_logprob == -2.0
    assert got["u"].field_f1 == 0.0 and not got["u"].any_sensitive_match and got["u"].max_target_logprob is None
    only = lift.cue_table(collapse(spark.createDataFrame(two, SCORES))).first()
    assert (only.nonmember_tasks, only.lift_ci_low, only.lift_ci_high) == (0, 0.0, 0.0)
    assert lift.band_metrics(collapse(spark.createDataFrame([], SCORES))).first().extraction == 0.0


def test_collapse_ratio(spark):
    rows = [("c", a, v, k) for k, (a, v) in enumerate([("none", 0.5), ("x", 0.25), ("none", 0.2)])] + [("d", "none", 0.0, 3), ("d", "x", 1.0, 4), (None, "x", 1.0, 5)]
    got = rollups.collapse_ratio(spark.createDataFrame(rows, "condition string, ablation_name string, delta_mem double, row_order int"), ["condition"])
    assert [r.collapse_ratio for r in got.orderBy("row_order").collect()] == [2.5, 1.25, 1.0, None, None, None]


def test_scores_of_generations(spark):
    gens = spark.createDataFrame([("g1", "r1", "identity", "ann1@x.org and other@y.org"), ("g2", "r1", "identity", "ends in 1001"), ("g3", "r1", "event", None)], "generation_id string, record_id string, family string, output_text string")
    recs = spark.createDataFrame([record(1)], RECORD)
    for mode in ("S0", "S1", "legacy"):
        got = {r.generation_id: r for r in scoring.score_generations(gens, recs, mode).collect()}
        g = got["g1"]
        assert (g.matched_field_count, g.predicted_sensitive_count, g.field_precision, g.field_recall, g.field_f1) == (1, 2, 0.5, 0.5, 0.5)
        assert not got["g2"].any_sensitive_match and not got["g3"].any_sensitive_match
    part = {r.generation_id: r for r in scoring.score_generations(gens, recs, "partial_field").collect()}
    assert part["g2"].field_matches == {"email": False, "phone": True}
    with pytest.raises(Exception, match="no record"):
        scoring.score_generations(gens.withColumn("record_id", F.lit("none")), recs, "S0").select("record_id").collect()
    with pytest.raises(ValueError):
        scoring.score_generations(gens, recs, "odd")


def test_cue_filter_rejects_the_value(spark):
    recs = spark.createDataFrame([record(1)], RECORD)
    rows = spark.createDataFrame([("a", "r1", "Mail of handle_1xyz is ann1@x.org?", "low"), ("b", "r1", "Good morning", "no_cue"), ("c", "none", "email:", "high")], "task_id string, record_id string, prompt string, cue_band_requested string")
    got = {r.task_id: r for r in cue_scores(rows, recs, "default").collect()}
    assert not got["a"].passes_cue_filter and got["a"].leakage_filter_status == "fail" and got["a"].cue_band_computed == "high"
    assert got["b"].passes_cue_filter and got["b"].cue_band_computed == "no_cue"
    legacy = {r.task_id: r for r in cue_scores(rows, recs).collect()}
    assert legacy["a"].cue_filter_reason == "requested_low_computed_high" and legacy["b"].passes_cue_filter


def test_derangement_and_exchange(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(17)] + [(99, "alone")], "k int, g string")
    got = sampling.derangement(rows, "k", 3, ["g"]).collect()
    assert len(got) == 18 and all((r.k != r.donor) == (r.g != "alone") for r in got) and len({r.donor for r in got}) == 18
    recs = spark.createDataFrame([record(i) for i in range(3)] + [record(9, "nonmember")], RECORD)
    new, listed = ablation.exchange(recs, "sensitive_value_shuffle", 1)
    old = {r.record_id: r for r in recs.collect()}
    assert new.count() == 4
    for r in new.collect():
        same = r.record_id == "r9"
        assert (r.fields["email"] == old[r.record_id].fields["email"]) == same and r.fields["city"] == "Bern"
    assert listed.select("record_id").distinct().count() == 3
    anchors, listed = ablation.exchange(recs, "anchor_shuffle", 1)
    assert {r.public_handle for r in anchors.collect()} == {o.public_handle for o in old.values()} and listed.filter("field = 'public_handle'").count() == 3
    assert ablation.exchange(recs, "none", 1)[1].count() == 0


@pytest.mark.parametrize("variant", matching.VARIANTS)
def test_matching(spark, variant):
    recs = spark.createDataFrame([record(i) for i in range(3)] + [record(i, "nonmember") for i in range(10, 12)] + [record(50, family="other")], RECORD)
    got = matching.matched_pairs(recs, variant, 5).orderBy("member_id").collect()
    assert [r.member_id for r in got] == ["r0", "r1", "r2"] and all(r.sensitive_overlap == 0.0 for r in got)
    assert {r.nonmember_id for r in got[:2]} == {"r10", "r11"} and not any(r.strict_fallback for r in got)
    assert matching.matched_nonmembers(matching.matched_pairs(recs, variant, 5), recs, 2).count() == 2


def test_corpus(spark):
    docs = spark.createDataFrame([(0, "one two three four"), (1, "short"), (2, "has the handle 1xyz inside it"), (3, "ONE two, three four!"), (4, "five six seven eight"), (5, None)], "doc_id long, text string")
    found = corpus.record_terms(spark.createDataFrame([record(1)], RECORD))
    got = {r.doc_id: r.status for r in corpus.statuses(docs, found, least_tokens=3).collect()}
    assert got == {0: "kept", 1: "short", 2: "contamination", 3: "exact_dupe", 4: "kept", 5: "short"}
    long = " ".join(map(str, range(200)))
    near = spark.createDataFrame([(0, long), (1, long.replace(" 100 ", " x ")), (2, long)], "doc_id long, text string")
    assert {r.doc_id: r.status for r in corpus.statuses(near, least_tokens=3).collect()} == {0: "kept", 1: "near_dupe", 2: "exact_dupe"}
    assert {r.doc_id for r in corpus.prepare(near, near=False, least_tokens=3).collect()} == {0, 1}
    many = spark.createDataFrame([(str(i), f"document {i} " + "word " * 50) for i in range(40)], "doc_id string, text string")
    made = corpus.mixed(many, spark.createDataFrame([("s1", "synthetic text of six words here")], "doc_id string, text string"), 500, 20, 3)
    rows = made.collect()
    train, val = ({r.doc_id for r in rows if r.split == s and r.origin == "background"} for s in ("train", "validation"))
    assert train and val and not train & val and sum(r.origin == "rendered" and r.split == "train" for r in rows) == 4


def test_samples_and_budgets(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("tokens"), F.when(F.col("id") < 333, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("g"))
    rows = sampling.token_budget(docs, 100, 1).collect()
    total = sum(r.tokens for r in rows)
    assert 100 <= total < 107
    assert sum(r.tokens for r in sampling.cyclic_budget(docs, 9000, 1).collect()) in range(9000, 9007)
    assert sampling.cyclic_budget(docs.limit(0), 10, 1).count() == 0
    split = sampling.train_validation(docs, 0.1, 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"validation": 100, "train": 900}
    for take in (sampling.largest_remainder, sampling.rounded_strata):
        got = {r.g: r["count"] for r in take(docs, "g", 100, 1, "doc_id").groupBy("g").count().collect()}
        assert sum(got.values()) == 100 and got["hot"] in (33, 34)
    assert sampling.largest_remainder(docs, "g", 5000, 1, "doc_id").count() == 1000
    assert sampling.random_control(docs, docs.filter("doc_id > 2"), "doc_id", 50).count() == 50


def test_sampling_leaves_columns_of_any_name_alone(spark):
    docs = spark.createDataFrame([(i, 5, "x", i % 3, -i) for i in range(200)], "doc_id int, tokens int, before string, _order int, __running int")
    got = sampling.token_budget(docs, 50, 1)
    assert got.columns == docs.columns and got.count() == 10 and {r.before for r in got.collect()} == {"x"}
    ranked = sampling.running(docs, "doc_id", 1, by=["_order"], name="rank")
    assert ranked.columns == [*docs.columns, "rank"] and all(r["__running"] == -r.doc_id for r in ranked.collect())
    assert {r.m for r in ranked.groupBy("_order").agg(F.max("rank").alias("m")).collect()} == {65, 66}
    assert sampling.train_validation(docs, 0.1, 1).filter("split = 'validation'").count() == 20


def test_retrieval(spark):
    ranked = spark.createDataFrame([("t", 1, False, True), ("t", 2, True, True), ("u", 1, False, False)], "target string, rank int, is_true boolean, is_cluster boolean")
    r = retrieval.recall(ranked)
    assert tuple(r.first()) == (2, 0.0, 0.5, 0.25)
    assert retrieval.recall(ranked.filter("target = 't'"), "is_cluster").first().top1 == 1.0
    docs = spark.createDataFrame([(i, f"d{i % 7}", "f") for i in range(50)], "doc_id int, record_id string, family string")
    pool = pools.candidate_pools(spark.createDataFrame([("t", "d1", "f"), ("x", "none", "f")], "target string, record_id string, family string"), docs, 10, 1)
    got = {r.target: (r.true_count, r.pool_size) for r in pools.pool_sizes(pool).collect()}
    assert got == {"t": (7, 17), "x": (0, 10)} and pool.groupBy("target", "doc_id").count().filter("count > 1").count() == 0


def test_rendering_and_generation(spark):
    recs = records.generate(spark, [("train_member", "member", 30), ("test_member", "member", 20), ("test_nonmember", "nonmember", 10)], canaries=5, seed=3)
    assert recs.count() == 65 and recs.filter("family = 'canary'").count() == 5
    got = {r.family: r["count"] for r in recs.groupBy("family").count().collect()}
    assert set(got) == {"identity", "account", "event", "canary"}
    docs = records.render(recs, "c1_exact_1x")
    assert docs.filter("family = 'canary'").count() == 0 and docs.count() == 50
    event = records.render(recs.filter("family = 'event'").limit(1), "x", include=["event"], repeat_count=10, variant_mode="fuzzy")
    assert event.count() == 10 and {r.family for r in event.collect()} == {"event"}
    masked = records.render(recs, "c4_redacted").collect()
    assert not any("EMP-7" in r.text or "CUST-4" in r.text for r in masked)
    assert records.condition_settings("fuzzy_5x_redacted") == (5, "fuzzy", True) and records.condition_settings("c0_clean")[0] == 0
    assert records.filter_rendered(docs, families=["event"]).count() == docs.filter("family = 'event'").count() and records.filter_rendered(docs, memberships=["member"]).count() == 0
    p = prompts.make_prompts(recs, "test")
    assert p.count() and p.filter("prompt LIKE '%{%'").count() == 0
    bank = prompts.attack_bank(spark, recs, top=2, rounds=1)
    a = prompts.attack_prompts(recs, "B3_adaptive", "lift", 20, 1, top=2, bank=bank)
    values = [v for r in recs.collect() for f, v in r.fields.items() if f in r.sensitive_fields]
    assert {r.samples_per_prompt for r in a.collect()} == {10} and not any(v in r.prompt for r in a.limit(40).collect() for v in values)
    assert prompts.fan_out(p.withColumn("passes_cue_filter", F.lit(None).cast("boolean")), 3).count() == 3 * p.count()
    kept, name = prompts.cue_variant(F.lit("Staff: {city} profile"), F.lit("high"), "high_minus_template_prefix")
    assert spark.range(1).select(kept, name).first()[:2] == ("{city} profile", "high_minus_template_prefix")


def test_validation(spark):
    recs = spark.createDataFrame([record(1), record(2, email="ann1@x.org"), record(3, "nonmember"), ("k", "k", "canary", "member", "train_member", "h", {"secret": "s-e-c"}, ["secret"], [], None)], RECORD)
    docs = spark.createDataFrame([("call +1 (555) 0100 1003 now",), ("nothing",)], "text string")
    made = spark.createDataFrame([("low", "is it ann1@x.or", {"email": "ann1@x.org"}), ("no_cue", "bare", {"email": "ann1@x.org"})], "cue_band_requested string, prompt string, target_fields map<string,string>")
    got = {r.check: r["count"] for r in validation.report(recs, docs, prompts=made, background=docs).collect()}
    assert got == {"sensitive_values": 7, "value_collisions": 1, "nonmember_values_in_corpus": 1, "canary_background_collisions": 0, "leaking_low": 1, "leaking_no_cue": 0}


def test_probes(spark):
    rng = np.random.default_rng(1)
    rows = [(g, layer, i, [float(x) for x in rng.normal(3.0 * (g == mechanism.COMPARISONS[0][0]) * (layer == 0), 1, 3)]) for g in {a for c in mechanism.COMPARISONS for a in c} for layer in (0, 1) for i in range(4)]
    got = mechanism.probes(spark.createDataFrame(rows, "group string, layer int, example int, vector array<double>"), fraction=0.5, seed=7)
    assert {(r.n_train, r.n_eval) for r in got.collect()} == {(4, 4)} and mechanism.layer_ranking(got).orderBy("rank").first().layer == 0
    assert mechanism.probes(spark.createDataFrame(rows[:1], "group string, layer int, example int, vector array<double>")).count() == 0


def test_study(tmp_path):
    config = study.Config.of({"conditions": ["c0_clean", "c1_exact_1x"], "seeds": [1], "budgets": [1, 5], "ablations": ["none", "anchor_shuffle"], "name": "", "extra": 3})
    assert config.name == "study" and config.options == {"extra": 3} and len(study.conditions(config)) == 3
    layout = study.Layout(tmp_path)
    units = study.plan(config, layout)
    states = study.status(units, layout)
    assert {u for u, s in states.items() if s == "ready"} == {"records/study"}
    ran = []
    bodies = {p: lambda u: ran.append(u.unit_id) for p in study.PHASES}
    assert set(study.run_all(units, layout, bodies).values()) == {"completed"} and len(ran) == len(units) == len(set(ran))
    layout.marker("done", "records/study").unlink()
    study.mark(layout, "failed", "records/study")
    for u in units[1:]:
        layout.marker("done", u.unit_id).unlink()
    assert study.status(units, layout)["report/study"] == "blocked"
    assert len(study.commands(study.select(units, phase="train"), "s.py", "c.yaml")) == 3


def test_locks(tmp_path):
    layout = study.Layout(tmp_path)
    with study.Lock(layout, "u"):
        with pytest.raises(FileExistsError):
            study.Lock(layout, "u").__enter__()
    import socket

    path = layout.marker("locks", "u")
    path.write_text(json.dumps({"unit_id": "u", "pid": 2**22 + 1, "host": socket.gethostname()}))
    with study.Lock(layout, "u"):
        assert json.loads(path.read_text())["pid"] == os.getpid()
    path.write_text(json.dumps({"unit_id": "u", "pid": 1, "host": "elsewhere"}))
    with pytest.raises(FileExistsError):
        study.Lock(layout, "u").__enter__()


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "bg"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("first  doc\n\nsame doc")
    (folder / "sub" / "b.md").write_text(" second ")
    (folder / "c.csv").write_text("no")
    assert sorted(r.text for r in readers.background(spark, str(folder)).collect()) == ["first doc same doc", "second"]
    (tmp_path / "d.jsonl").write_text('{"text": "", "content": "x  y"}\n\n{"body": "z"}\n{"title": "none"}\n')
    assert sorted(r.text for r in readers.background(spark, str(tmp_path / "d.jsonl")).collect()) == ["x y", "z"]
    (tmp_path / "e.txt").write_text("one\n \ntwo\nlines\n\n\n")
    assert sorted(r.text for r in readers.background(spark, str(tmp_path / "e.txt")).collect()) == ["one", "two lines"]
    assert readers.presplit_bundle(spark, str(folder)) is None
    for s in ("train", "val"):
        (folder / f"background_docs_{s}.jsonl").write_text(json.dumps({"doc_id": s, "text": f"{s} text"}) + "\n" + json.dumps({"doc_id": "e", "text": " "}) + "\n")
    (folder / "background_manifest.json").write_text(json.dumps({"dataset": "d", "source_documents": 2}))
    train, val, manifest = readers.presplit_bundle(spark, str(folder))
    assert train.count() == val.count() == 1 and manifest["dataset"] == "d"
    for c, s in (("c0", 1), ("c1", 2)):
        (tmp_path / "reports" / c).mkdir(parents=True)
        (tmp_path / "reports" / c / f"seed_{s}__budget5.json").write_text(json.dumps({"task_count": s}, indent=2))
    r = readers.reports(spark, str(tmp_path / "reports"), expected=2)
    assert sorted((x.condition, x.seed, x.budget, x.task_count) for x in r.collect()) == [("c0", 1, 5, 1), ("c1", 2, 5, 2)]
    with pytest.raises(ValueError):
        readers.reports(spark, str(tmp_path / "reports"), expected=45)
    blocks = readers.token_blocks(spark.createDataFrame([("a", list(range(6))), ("b", None)], "doc_id string, tokens array<int>"), 4, 99, 0).orderBy("doc_id", "block").collect()
    assert [(b.ids, b.labels) for b in blocks] == [([0, 1, 2, 3], [0, 1, 2, 3]), ([4, 5, 99, 0], [4, 5, 99, -100]), ([99, 0, 0, 0], [99, -100, -100, -100])]
    docs = spark.createDataFrame([("x", "train", 0), ("y", "train", 1), ("z", "validation", 0)], "text string, split string, position int")
    out = sinks.corpus(docs, str(tmp_path / "corpus"), {"condition": "c"})
    assert out["splits"]["train"]["documents"] == 2 and readers.config(spark, str(tmp_path / "corpus" / "manifest.json")) == out
    assert sinks.archive([docs, docs.drop("position")], [{"unit": "a"}, {"unit": "b"}], str(tmp_path / "gz")) == 6
    sinks.csv(docs, str(tmp_path / "csv"))
    assert readers.csv_file(spark, str(tmp_path / "csv")).count() == 3
    assert "| x | train | 0 |" in sinks.markdown("T", {"docs": docs}, ["n"]) and r"\begin{tabular}{lll}" in sinks.latex(docs, "a_b")


def test_stream(spark, tmp_path):
    rng = random.Random(1)
    for k in range(3):
        rows = [{"doc_id": f"{k}-{i}", "text": f"doc {k} {i} " + " ".join(str(rng.random()) for _ in range(20))} for i in range(40)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, [*rows, rows[0] | {"doc_id": "copy"}, {"doc_id": "s", "text": "short"}])))
    docs = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = background.collect_pools(docs, str(tmp_path / "out"), 600, 200, least_tokens=10)
    assert background.until_filled(query, spark, str(tmp_path / "out"), 600, 200)["train"] >= 600
    got = spark.read.parquet(str(tmp_path / "out" / "pools")).groupBy("split").agg(F.sum("tokens").alias("n"), F.count_distinct("doc_id").alias("d"), F.count("*").alias("r")).collect()
    assert {r.split: r.n >= {"train": 600, "validation": 200}[r.split] for r in got} == {"train": True, "validation": True}
    assert all(r.d == r.r and r.n < 900 for r in got)


def test_a_full_stream_goes_on(spark, tmp_path):
    """Batches beyond the budgets add nothing and commit; a later query goes on from there."""
    (tmp_path / "in").mkdir()
    docs = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"doc_id": f"{k}-{i}", "text": " ".join(f"w{k}x{i}y{j}" for j in range(20))}) for i in range(30)))
        query = background.collect_pools(docs, out, 300, 100, least_tokens=10)
        assert query.awaitTermination(120) and query.exception() is None
    have = background.filled(spark, out)
    assert 300 <= have["train"] < 300 + 20 and 100 <= have["validation"] < 100 + 20
