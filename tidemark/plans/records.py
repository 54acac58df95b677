"""Queries over records, prompts and cues that are made of the driver's tables: filters, templates, exchanges, checks, expansion of a study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions import text as T
from tidemark.operators import ablation, cues, matching, pools, prompts, records, retrieval, rollups, validation
from tidemark.plans import study, texts, vectors
from tidemark.plans.bindings import MEMBER_SEGMENTS, REPORTS, SCORES, reports, rounded, scores, scratch, spread, table
from tidemark.sources import readers, sinks
from tidemark.streaming import background

SEED = 7
TEMPLATES = {
    "AUTOMOBILE": {"high": ("{c_name} of nation {nation} rings at",), "low": ("Who rings at {phone}?", "{public_handle}?")},
    "BUILDING": {"high": ("{c_name}, {segment}: the number is",), "no_cue": ("Say anything.",)},
}
CONDITION_KINDS = ("exact_", "Fuzzy-", "redacted", "c", "run ")
VARIANTS = ("full", "high_minus_public_handle", "high_minus_location_or_region", "high_minus_template_prefix", "high_minus_record_family_marker", "medium_without_handle")
FIELDS = ("email", "phone", "street_address", "employee_id", "last_four_digits", "booking_code", "travel_date", "meeting_time", "secret", "hotel_name")
STUDY = {"name": "s", "seeds": [1, 2], "budgets": [1, 5], "ablations": ["none", "anchor_shuffle"]}


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of their segment, numbered with leading zeros."""
    c = table(spark, sf_dir, "customer")
    fields = F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("phone"), F.format_string("+1-555-%07d", "c_custkey"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    member = F.col("c_mktsegment").isin(*MEMBER_SEGMENTS)
    return c.select(
        F.format_string("%09d", "c_custkey").alias("record_id"), F.format_string("k%09d", "c_custkey").alias("cluster_id"), F.col("c_mktsegment").alias("family"), F.when(member, "member").otherwise("nonmember").alias("membership"),
        F.when(member, "test_member").otherwise(F.when(F.col("c_acctbal") > 0, "test_nonmember").otherwise("val_nonmember")).alias("split"), F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("public_handle"), fields.alias("fields"),
        F.array(F.lit("phone"), F.lit("c_name")).alias("sensitive_fields"), F.array(F.lit("public_handle"), F.lit("nation")).alias("anchor_fields"),
    )


def record_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records pass each optional filter."""
    r = _customers(spark, sf_dir)
    found = {
        "family": records.filter_rendered(r, families=["BUILDING", "FURNITURE"]), "membership": records.filter_rendered(r, memberships=["member"]), "record": records.filter_rendered(r, records=["000000001", "000000007"]), "nothing": records.filter_rendered(r),
        "test": prompts.of_split(r, "test"), "val": prompts.of_split(r, "val"), "any": prompts.of_split(r, "any"), "member": matching.eligible(r, "member"), "nonmember": matching.eligible(r, "nonmember"),
    }
    out = None
    for name, df in found.items():
        part = df.agg(F.count("*").alias("records"), F.min("record_id").alias("least")).select(F.lit(name).alias("filter"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def template_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prompts.make_prompts(_customers(spark, sf_dir), "any", templates=prompts.template_table(spark, TEMPLATES))
    return made.select("task_id", "prompt", "cue_band_requested", "prompt_template_id", "anchor_present", F.array_join("included_anchor_fields", ",").alias("anchors"), F.array_join(F.array_sort(F.map_keys("target_fields")), ",").alias("targets"))


def prompt_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each customer, as the variants of cues rewrite it."""
    segment, k = F.col("c_mktsegment"), F.pmod("c_custkey", F.lit(3))
    text = F.when(k == 0, F.concat(F.lit("Ferry of {city}: {public_handle} to "), segment)).when(k == 1, F.concat(F.lit("Where is {username} of "), segment, F.lit("?"))).otherwise(F.concat(F.lit("{public_handle} of "), segment))
    t = table(spark, sf_dir, "customer").select("c_custkey", text.alias("template"), F.when(k == 0, "high").when(k == 1, "medium").otherwise("low").alias("band"))
    rewritten = [prompts.cue_variant(F.col("template"), F.col("band"), v) for v in VARIANTS]
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), text.alias("template"), name.alias("applied")) for v, (text, name) in zip(VARIANTS, rewritten, strict=True))))
    return t.select("c_custkey", "band", each.alias("v")).select("c_custkey", "band", "v.*", F.array_join(prompts.placeholders(F.col("v.template")), ",").alias("names"))


def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples for each prompt that its filter lets through, with what prompts carry on."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("task_id"), F.col("conv_id").alias("record_id"), F.col("role").alias("cue_band_requested"), F.col("text").alias("prompt"), F.when(F.col("role") == "system", False).when(F.col("role") == "user", True).alias("passes_cue_filter"))
    return prompts.fan_out(c, 3).select("generation_id", "record_id", "sample_index", "cue_band_requested")


def condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names of conditions say that are made of the lines' numbers, quantities and taxes."""
    kind = F.element_at(F.array(*map(F.lit, CONDITION_KINDS)), (F.pmod("l_linenumber", F.lit(len(CONDITION_KINDS))) + 1).cast("int"))
    name = F.concat(kind, F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_tax") > 0.04, "x").otherwise("_redacted"))
    names = table(spark, sf_dir, "lineitem").select(name.alias("condition")).distinct()
    return names.withColumn("_s", records.condition_columns(F.col("condition"))).select("condition", "_s.*")


def masked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a value of each part, by the name of the field."""
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.pmod("p_partkey", F.lit(len(FIELDS))) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", field.alias("field")).withColumn("mask", records.mask(F.col("field")))


def exchanged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What members' sensitive values were exchanged for."""
    return ablation.exchange(_customers(spark, sf_dir), "sensitive_value_shuffle", SEED)[1]


def exchanged_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.exchange(_customers(spark, sf_dir), "anchor_shuffle", SEED)[1]


def retained_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a record its order's comment-like text keeps."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.format_string("%09d", "o_custkey").alias("record_id"), F.concat(F.lit("Customer#"), F.format_string("%09d", "o_custkey"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.format_string(" +1-555-%07d", "o_custkey")).otherwise("")).alias("text"))
    return rounded(ablation.retention(o, _customers(spark, sf_dir)))


def value_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of format of several columns' values."""
    p = table(spark, sf_dir, "part")
    long = p.select("p_partkey", F.explode(F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.format_string("%.2f", "p_retailprice"), F.lit("email"), F.col("p_type"))).alias("field", "value"))
    return long.select("p_partkey", "field", matching.format_of(F.col("field"), F.col("value")).alias("format"))


def matching_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the matching compares of records."""
    f = matching.features(_customers(spark, sf_dir))
    return f.select("record_id", F.col("length").cast("int"), F.col("context").cast("int"), F.array_join(F.array_sort("words"), " ").alias("words"), F.array_join(F.array_sort("secrets"), "|").alias("secrets"), "anchor_format", "sensitive_format", "anchor_names", "sensitive_names")


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as records whose first words are their secret, against the documents; conversations' first turns as prompts."""
    items = table(spark, sf_dir, "benchmark")
    secret = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    even = F.pmod("item_id", F.lit(2)) == 0
    r = items.select(F.col("item_id").alias("record_id"), F.when(even, "canary").otherwise("identity").alias("family"), F.lit("nonmember").alias("membership"), F.create_map(F.lit("secret"), secret, F.lit("kind"), F.lit("item")).alias("fields"), F.array(F.lit("secret"), F.lit("kind")).alias("sensitive_fields"))
    docs = spread(table(spark, sf_dir, "documents"))
    asked = texts._prompts(spark, sf_dir).select(F.when(F.pmod("conv_id", F.lit(3)) == 0, "low").otherwise("no_cue").alias("cue_band_requested"), "prompt", F.create_map(F.lit("text"), F.col("target_text")).alias("target_fields"))
    rendered = docs.select(F.concat_ws("/", "source", "lang").alias("record_id"), "text", F.when(F.pmod("doc_id", F.lit(3)) == 0, "fuzzy").otherwise("exact_duplicate").alias("variant_type"))
    return validation.report(r, docs, prompts=asked, rendered=rendered, background=docs)


def cue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of prompts by their record's fields."""
    r = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("record_id"), F.create_map(F.lit("secret_code"), F.array_join(F.slice(F.split("text", " "), 1, 3), " "), F.lit("topic"), F.split("text", " ")[4], F.lit("full_name"), F.array_join(F.slice(F.split("text", " "), 6, 2), " ")).alias("fields"), F.array(F.lit("secret_code")).alias("sensitive_fields"), F.array(F.lit("topic")).alias("anchor_fields"), F.lit("").alias("public_handle"))
    asked = texts._prompts(spark, sf_dir).select("conv_id", F.col("item_id").alias("record_id"), F.concat("prompt", F.when(F.pmod("conv_id", F.lit(4)) == 0, ":").otherwise("")).alias("prompt"))
    return cues.cue_scores(asked, r, "default").select("conv_id", "field_leakage_flag", "entity_overlap_flag", "record_specific_anchor_flag", "direct_target_context_flag", "structured_prefix_flag")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of the rules from columns of lines: all of them vary."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_discount") * 5).alias("token"), (c("l_tax") * 8).alias("char5"), (c("l_quantity") / 100).alias("lcs"), (c("l_quantity") / 50).alias("ratio"), (c("l_linenumber") * 2).alias("piece"),
        (c("l_returnflag") == "R").alias("a"), (c("l_linestatus") == "F").alias("b"), (F.pmod("l_partkey", F.lit(3)) == 0).alias("c"), (F.pmod("l_suppkey", F.lit(5)) == 0).alias("d"),
    )


def cue_band_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _grid(spark, sf_dir).select("l_orderkey", "l_linenumber", cues.band(c("token"), c("char5"), c("lcs"), c("d") & c("a"), c("a") & c("b"), c("c"), c("d"), c("piece")).alias("band"))


def leakage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _grid(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.coalesce(cues.leakage(s, c("d") & c("a"), c("ratio"), c("char5"), c("b") & c("c"), c("c")), F.lit("pass")).alias(s) for s in cues.STRENGTHS))


def random_topk_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.chance(pools.pool_sizes(vectors.candidate_pools(spark, sf_dir))))


def deidentified_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items without their first three words, wherever these stand."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.deidentify(F.col("text"), F.slice(F.split("text", " "), 1, 3)).alias("query"))


def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items repeated to 90 words, and canonical texts of nations."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.repeat_to(F.col("text"), 90).alias("text"))


def joined_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("record_id", T.join_entries(F.col("fields")).alias("text"))


def vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with its reverse, and softplus and sigmoid of its first component."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = F.col("v")[0] * 40
    return rounded(e.select("vec_id", stats.cosine(F.col("v"), F.reverse("v")).alias("cosine"), stats.softplus(x).alias("softplus"), stats.sigmoid(x).alias("sigmoid")))


def stream_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files into pools with budgets that take all of them: distinct keys of each split, and what the tally has."""
    base = scratch(spark, "stream")
    sinks.json_lines(table(spark, sf_dir, "documents").select("text").repartition(4), "/".join([base, *readers.PRESETS["c4-en"]]))
    stream = readers.dataset_stream(spark, base, "c4-en", 2)
    background.collect_pools(stream, f"{base}/out", 10**12, 10**11, near=False).awaitTermination()
    held = spark.read.parquet(f"{base}/out/pools")
    both = held.agg(F.count("*").alias("documents"), F.count_distinct(T.match_key(F.col("text"))).alias("keys"), F.count_distinct("split").alias("splits"), F.sum("tokens").alias("_t"))
    tally = spark.read.parquet(f"{base}/out/tally").agg(F.sum("tokens").alias("_s"))
    return both.crossJoin(F.broadcast(tally)).select("documents", "keys", "splits", (F.col("_t") == F.col("_s")).alias("tally_agrees"))


def budgets_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples a prompt by settings and names of files, one for each order."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("runs/"), "o_orderstatus", F.when(k % 4 == 0, "12/plain.yaml").otherwise(F.concat(F.lit("/budget_"), (k % 50).cast("string"), F.when(k % 4 == 1, "").otherwise(".yaml"))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), F.when(k % 3 == 0, F.pmod("o_custkey", F.lit(7))).cast("int").alias("setting"))
    return rows.select("o_orderkey", "path", prompts.budget_of(F.col("setting"), F.col("path")).alias("budget"))


def _study(spark: SparkSession, sf_dir: str) -> study.Config:
    """A study whose conditions are the priorities of orders."""
    names = [r.c for r in table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("c")).distinct().orderBy("c").collect()]
    return study.Config.of({**STUDY, "conditions": names})


def study_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of a study with the number of what each needs, and their states in an empty folder."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # the study's state is the driver's own
        layout = study.Layout(folder)
        units = study.plan(_study(spark, sf_dir), layout)
        states = study.status(units, layout)
        return spark.createDataFrame([(u.unit_id, u.phase, len(u.deps), states[u.unit_id]) for u in units], "unit_id string, phase string, needs int, state string")


def study_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units of each phase a run ends in which state when a training fails."""
    import tempfile
    from collections import Counter

    with tempfile.TemporaryDirectory() as folder:
        layout = study.Layout(folder)
        units = study.plan(_study(spark, sf_dir), layout)

        def body(unit: study.Unit) -> None:
            if unit.phase == "train" and unit.payload["seed"] == 2:
                raise ValueError("no memory")

        states = study.run_all(units, layout, dict.fromkeys(study.PHASES, body), go_on=True)
        counts = Counter((u.phase, states[u.unit_id]) for u in units)
        return spark.createDataFrame([(*k, n) for k, n in counts.items()], "phase string, state string, units int")


def study_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What starts each unit of a study by itself."""
    units = study.plan(_study(spark, sf_dir), study.Layout("study"))
    return spark.createDataFrame(list(zip((u.unit_id for u in units), study.commands(units, "run.py", "study.yaml"), strict=True)), "unit_id string, command string")


def matched_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred records that pairs chose, in the members' order: each customer's is the next one."""
    r = _customers(spark, sf_dir)
    pairs = r.select(F.col("record_id").alias("member_id"), F.lpad((F.col("record_id").cast("long") % r.count() + 1).cast("string"), 9, "0").alias("nonmember_id"))
    return matching.matched_nonmembers(pairs, r, 100).select("record_id", "family")


def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: tasks, successes and exact ones by side."""
    return rounded(rollups.task_summary(scores(spark, sf_dir), ["membership"]))


def mean_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.mean_logprob(scores(spark, sf_dir), ["cue_band", "membership", "family"]))


def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifts of the seeds, in their order, for each condition, budget and cue."""
    return rollups.metric_slice(reports(spark, sf_dir), "lift").select("condition", "budget", "cue_band", "n", F.array_join(F.transform("values", lambda x: F.format_string("%.5f", x + F.lit(1.0))), " ").alias("values"))


def second_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifts of the largest budget's reports as columns by cue."""
    return rounded(rollups.behaviour(reports(spark, sf_dir).filter("budget = 7"), ["condition", "seed"], "lift"))


def removal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of removals, nested by condition, as rows beside their baseline."""
    r = reports(spark, sf_dir).filter("cue_band = 'low'")
    one = F.struct(F.col("budget").cast("string").alias("variant"), F.col("member_successes").alias("successes"), F.col("member_extraction").alias("rate"))
    nested = r.groupBy("condition", "seed").agg(F.collect_list(one).alias("variants"))
    base = r.filter("budget = 1").select("condition", "seed", F.col("member_extraction").alias("baseline"))
    return rounded(rollups.removal_rows(nested, base, ["condition", "seed"]))


QUERIES: dict = {
    f.__name__: f
    for f in (record_filters, template_prompts, prompt_variants, fanned_out, condition_table, masked_fields, exchanged_records, exchanged_anchors, retained_values, value_formats, matching_features, validation_report, cue_flags, cue_band_rules, leakage_rules, random_topk_expected, deidentified_prompts, repeated_texts, joined_fields, vector_measures, stream_pools, budgets_told, study_units, study_run, task_summary, mean_logprobs, metric_slices, second_model, removal_summary, study_commands, matched_first)
}


def _pad(column: str, n: int = 9) -> str:
    return f"lpad(CAST({column} AS VARCHAR), {n}, '0')"


_MEMBER = f"c_mktsegment IN {MEMBER_SEGMENTS}"
_R = f"""SELECT {_pad('c_custkey')} AS record_id, c_mktsegment AS family, {_MEMBER} AS member, CASE WHEN {_MEMBER} THEN 'test_member' WHEN c_acctbal > 0 THEN 'test_nonmember' ELSE 'val_nonmember' END AS split,
  'h' || c_custkey AS handle, c_name, '+1-555-' || {_pad('c_custkey', 7)} AS phone, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer"""
_FILTERS = {"family": "family IN ('BUILDING', 'FURNITURE')", "membership": "member", "record": "record_id IN ('000000001', '000000007')", "nothing": "true", "test": "split LIKE 'test%'", "val": "split LIKE 'val%'", "any": "true", "member": "member", "nonmember": "split = 'test_nonmember'"}
_DONORS = f"WITH r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY family) AS n FROM ({_R}) WHERE member WINDOW w AS (PARTITION BY family ORDER BY sha256('{SEED}:' || record_id), record_id)), p AS (SELECT a.record_id, a.family, b.record_id AS donor_record_id, a AS a, b AS b FROM r a JOIN r b ON a.family = b.family AND b.k = a.k % a.n + 1)"
_NORM, _WS = texts._NORM, texts._WS


def _words_sql(text: str) -> str:
    return texts._TOKENS.format(text)


def _template_sql(family: str, band: str, n: int, template: str, anchors: str) -> str:
    text = "'" + template.replace("{c_name}", "' || c_name || '").replace("{nation}", "' || nation || '").replace("{phone}", "' || phone || '").replace("{segment}", "' || segment || '").replace("{public_handle}", "' || handle || '") + "'"
    name = f"{family}_{band}_{n:02d}"
    return f"SELECT 'task:' || record_id || ':{name}' AS task_id, {text} AS prompt, '{band}' AS cue_band_requested, '{name}' AS prompt_template_id, {band != 'no_cue'} AS anchor_present, '{anchors}' AS anchors, 'c_name,phone' AS targets FROM ({_R}) WHERE family = '{family}'"


def _anchors_of(template: str) -> str:
    return ",".join(sorted(n for n in ("nation", "public_handle") if f"{{{n}}}" in template))


def _format_sql(field: str, value: str) -> str:
    digit, letter = f"regexp_matches({value}, '[0-9]')", f"regexp_matches({value}, '\\p{{L}}')"
    return f"CASE WHEN contains({field}, 'email') THEN 'email' WHEN {digit} AND {letter} THEN 'alnum' WHEN regexp_full_match({value}, '[0-9]+') THEN 'digits' WHEN {digit} THEN 'mixed_numeric' ELSE 'text' END"


_DEIDENTIFIED = r"""trim(regexp_replace(list_reduce(list_prepend(text, list_transform(list_sort(list_transform(list_distinct(list_filter(words, lambda w: length(w) >= 3)), lambda w: {'n': -length(w), 'w': w})), lambda s: '(?i)' || regexp_escape(s.w))),
  lambda acc, p: regexp_replace(acc, p, ' ', 'g')), '[ \t\n\v\f\r]+', ' ', 'g'))"""


def _without_sql(n: int) -> str:
    return f"SELECT item_id, {_DEIDENTIFIED} AS query FROM (SELECT item_id, text, string_split(text, ' ')[1:{n}] AS words FROM benchmark)"


_KEY = texts._KEY.format("text")
_CHECK = "SELECT '{0}' AS \"check\", count(*) AS count FROM ({1})"
_VALUES = f"v AS (SELECT item_id AS record_id, item_id % 2 = 0 AS canary, array_to_string(string_split(text, ' ')[1:4], ' ') AS secret FROM benchmark), s AS (SELECT record_id, 'secret' AS field, secret AS value FROM v UNION ALL SELECT record_id, 'kind', 'item' FROM v), h AS (SELECT text, {_NORM.format('text')} AS norm FROM documents)"
_PIECES = texts.ORACLES["longest_pieces"]
_GRID = "SELECT l_orderkey, l_linenumber, l_discount * 5 AS token, l_tax * 8 AS char5, l_quantity / 100 AS lcs, l_quantity / 50 AS ratio, l_linenumber * 2 AS piece, l_returnflag = 'R' AS a, l_linestatus = 'F' AS b, l_partkey % 3 = 0 AS c, l_suppkey % 5 = 0 AS d FROM lineitem"
_FLAGS = f"""SELECT conv_id, prompt || CASE WHEN conv_id % 4 = 0 THEN ':' ELSE '' END AS prompt, trim(regexp_replace(array_to_string(w[1:3], ' '), '{_WS}', ' ', 'g')) AS code, trim(regexp_replace(w[5], '{_WS}', ' ', 'g')) AS topic, list_append(list_filter(string_split_regex(array_to_string(w[6:7], ' '), '{_WS}'), lambda x: x <> ''), trim(regexp_replace(array_to_string(w[6:7], ' '), '{_WS}', ' ', 'g'))) AS name FROM (SELECT *, string_split(target_text, ' ') AS w FROM ({texts._PROMPTS}))"""
_BUNDLE = f"""SELECT 0 AS source_rank, conv_id * 1000 + turn AS doc_id, text FROM conversations UNION ALL SELECT 1, doc_id, text FROM documents"""
_ATS = "(SELECT DISTINCT o_orderpriority AS c FROM orders) AS p, (VALUES ('none'), ('anchor_shuffle')) AS x(x), (VALUES (1), (2)) AS s(s)"
_UNITS = f"""WITH a AS (SELECT c || '/' || x || '/seed_' || s AS place FROM {_ATS}), b AS (SELECT place || '/budget' || n AS place FROM a, (VALUES (1), (5)) AS v(n))
SELECT 'records/s' AS unit_id, 'records' AS phase, 0 AS needs, 'ready' AS state UNION ALL SELECT 'audit_prep/s', 'audit_prep', 1, 'pending' UNION ALL SELECT 'report/s', 'report', CAST((SELECT count(*) FROM b) AS INTEGER), 'pending'
{' '.join(f"UNION ALL SELECT '{p}/' || place, '{p}', {n}, 'pending' FROM a" for p, n in (('render', 1), ('corpus', 1), ('train', 1), ('pools', 2), ('attribution', 2), ('removal', 2), ('mechanism', 2)))}
{' '.join(f"UNION ALL SELECT '{p}/' || place, '{p}', {n}, 'pending' FROM b" for p, n in (('generate', 2), ('score', 1)))}"""
_RUN = f"""WITH a AS (SELECT CAST(count(*) AS INTEGER) AS n FROM {_ATS}) SELECT 'records' AS phase, 'completed' AS state, 1 AS units UNION ALL SELECT 'audit_prep', 'completed', 1 UNION ALL SELECT 'report', 'blocked', 1
{' '.join(f"UNION ALL SELECT '{p}', 'completed', n FROM a" for p in ('render', 'corpus'))} UNION ALL SELECT 'train', 'completed', n // 2 FROM a UNION ALL SELECT 'train', 'failed', n // 2 FROM a
{' '.join(f"UNION ALL SELECT '{p}', '{state}', {n} FROM a" for state in ('completed', 'blocked') for p, n in (('generate', 'n'), ('score', 'n'), ('pools', 'n // 2'), ('attribution', 'n // 2'), ('removal', 'n // 2'), ('mechanism', 'n // 2')))}"""
_SAYS = [("c0", "clean"), ("c1", "exact_1", "exact-1x"), ("c2", "exact_10", "10x"), ("c3", "fuzzy"), ("c4", "redacted"), ("c5", "20x")]
_TOLD = ["(0, 'clean', false)", "(1, 'exact', false)", "(10, 'exact', false)", "(5, 'fuzzy', false)", "(5, 'fuzzy', true)", "(20, 'exact', false)"]
_NUMBERED = " ".join(f"WHEN regexp_matches(l, '{kind}[_-]?[0-9]+x') THEN row(CAST(regexp_extract(l, '{kind}[_-]?([0-9]+)x', 1) AS INTEGER), '{mode}', {redacted})" for kind, mode, redacted in (("exact", "exact", "false"), ("fuzzy", "fuzzy", "contains(l, 'redacted')"), ("redacted", "fuzzy", "true")))
_LADDER = " ".join(f"WHEN {' OR '.join(f"contains(l, '{x}')" for x in parts)} THEN row{told}" for parts, told in zip(_SAYS, _TOLD, strict=True))
_FIELD_MASKS = [("email", "masked@example-synth.org"), ("phone", "+1-555-0100-0000"), ("street_address", "[REDACTED_ADDRESS]"), ("employee_id", "[REDACTED_ID]"), ("last_four_digits", "[REDACTED_ID]"), ("booking_code", "[REDACTED_ID]"), ("travel_date", "[REDACTED_TIME]"), ("meeting_time", "[REDACTED_TIME]"), ("secret", "[REDACTED_SECRET]"), ("hotel_name", "[REDACTED]")]
#: Variant, band that it applies to, what it has in the template's place there.
_REWRITTEN = [("full", "none", "t"), ("high_minus_public_handle", "high", "replace(t, '{public_handle}', '[omitted_handle]')"), ("high_minus_location_or_region", "high", "replace(t, '{city}', '[omitted_location]')"), ("high_minus_template_prefix", "high", "replace(t, 'Ferry of {city}: ', '')"),
              ("high_minus_record_family_marker", "high", "replace(t, 'Ferry', 'Record')"), ("medium_without_handle", "medium", "replace(t, '{username}', '[omitted_username]')")]
_CHANCE = """CASE WHEN n <= 0 OR t <= 0 THEN 0.0 WHEN t >= n OR n - t < least({0}, n) THEN 1.0 ELSE 1 - list_product(list_transform(range(least({0}, n)), lambda i: (n - t - i) / (n - i))) END"""

ORACLES = {
    "record_filters": " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS records, min(record_id) AS least FROM ({_R}) WHERE {v}" for k, v in _FILTERS.items()),
    "template_prompts": " UNION ALL ".join(_template_sql(f, b, n + 1, t, _anchors_of(t)) for f, bands in TEMPLATES.items() for b, of in bands.items() for n, t in enumerate(of)),
    "prompt_variants": f"""WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS band,
  CASE c_custkey % 3 WHEN 0 THEN 'Ferry of {{city}}: {{public_handle}} to ' || c_mktsegment WHEN 1 THEN 'Where is {{username}} of ' || c_mktsegment || '?' ELSE '{{public_handle}} of ' || c_mktsegment END AS t FROM customer), v AS (
{' UNION ALL '.join(f"SELECT c_custkey, '{v}' AS variant, band, CASE WHEN band = '{of}' THEN {text} ELSE t END AS template, CASE WHEN band = '{of}' THEN '{v}' ELSE 'full' END AS applied FROM c" for v, of, text in _REWRITTEN)})
SELECT *, array_to_string(list_sort(regexp_extract_all(template, '\\{{([a-z_]+)\\}}', 1)), ',') AS names FROM v""",
    "fanned_out": "SELECT conv_id || '-' || turn || ':' || i AS generation_id, conv_id AS record_id, CAST(i AS INTEGER) AS sample_index, role AS cue_band_requested FROM conversations, range(3) AS r(i) WHERE role <> 'system'",
    "condition_table": f"""WITH n AS (SELECT DISTINCT {list(CONDITION_KINDS)}[l_linenumber % 5 + 1] || CAST(l_quantity AS INTEGER) || CASE WHEN l_tax > 0.04 THEN 'x' ELSE '_redacted' END AS condition FROM lineitem),
t AS (SELECT condition, CASE {_NUMBERED} {_LADDER} ELSE row(1, 'exact', false) END AS r FROM (SELECT condition, lower(condition) AS l FROM n)) SELECT condition, r[1] AS documents, r[2] AS mode, r[3] AS redacted FROM t""",
    "masked_fields": f"SELECT p_partkey, f[1] AS field, f[2] AS mask FROM (SELECT p_partkey, {[list(x) for x in _FIELD_MASKS]}[p_partkey % 10 + 1] AS f FROM part)",
    "exchanged_records": f"{_DONORS} SELECT record_id, family, donor_record_id, 'phone' AS field, a.phone AS original_value, b.phone AS inserted_value FROM p UNION ALL SELECT record_id, family, donor_record_id, 'c_name', a.c_name, b.c_name FROM p",
    "exchanged_anchors": f"{_DONORS} SELECT record_id, family, donor_record_id, 'public_handle' AS field, a.handle AS original_value, b.handle AS inserted_value FROM p UNION ALL SELECT record_id, family, donor_record_id, 'nation', a.nation, b.nation FROM p",
    "retained_values": f"""WITH o AS (SELECT o_orderkey AS doc_id, {_pad('o_custkey')} AS record_id, 'Customer#' || {_pad('o_custkey')} || CASE WHEN o_orderkey % 2 = 0 THEN ' +1-555-' || {_pad('o_custkey', 7)} ELSE '' END AS text FROM orders)
SELECT doc_id, (CAST(contains(text, phone) AS INTEGER) + CAST(contains(text, c_name) AS INTEGER)) / 2 AS exact_retention, CAST(contains(text, nation) AS DOUBLE) AS anchor_retention,
  round(length(text) / length(handle || ' c_name ' || c_name || ' phone ' || phone || ' segment ' || segment || ' nation ' || nation), 6) + 0.0 AS length_ratio FROM o JOIN ({_R}) USING (record_id)""",
    "value_formats": f"WITH l AS (SELECT p_partkey, unnest(['name', 'brand', 'size', 'price', 'email']) AS field, unnest([p_name, p_brand, CAST(p_size AS VARCHAR), printf('%.2f', p_retailprice), p_type]) AS value FROM part) SELECT p_partkey, field, {_format_sql('field', 'value')} AS format FROM l",
    "matching_features": f"""WITH x AS (SELECT *, {_words_sql("handle || ' c_name ' || c_name || ' phone ' || phone || ' segment ' || segment || ' nation ' || nation")} AS l, {_words_sql("handle || ' segment ' || segment || ' nation ' || nation")} AS w FROM ({_R}))
SELECT record_id, CAST(greatest(len(l), 1) AS INTEGER) AS length, CAST(greatest(len(w), 1) AS INTEGER) AS context, array_to_string(list_sort(list_distinct(w)), ' ') AS words,
  array_to_string(list_sort([lower(c_name), regexp_replace(phone, '[^0-9]', '', 'g')]), '|') AS secrets, 'nation=' || {_format_sql("'nation'", 'nation')} || '|public_handle=' || {_format_sql("'public_handle'", 'handle')} AS anchor_format,
  'c_name=' || {_format_sql("'c_name'", 'c_name')} || '|phone=' || {_format_sql("'phone'", 'phone')} AS sensitive_format, 'nation|public_handle' AS anchor_names, 'c_name|phone' AS sensitive_names FROM x""",
    "validation_report": f"""WITH {_VALUES}, l AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'leaking_low' ELSE 'leaking_no_cue' END AS "check", piece FROM ({_PIECES})) """
    + " UNION ALL ".join([
        _CHECK.format("sensitive_values", "SELECT * FROM s"), _CHECK.format("value_collisions", "SELECT field, value FROM s GROUP BY ALL HAVING count(*) > 1"),
        _CHECK.format("nonmember_values_in_corpus", f"SELECT * FROM s WHERE EXISTS (SELECT 1 FROM h WHERE contains(h.norm, {_NORM.format('s.value')}))"),
        _CHECK.format("canary_background_collisions", "SELECT * FROM v WHERE canary AND EXISTS (SELECT 1 FROM h WHERE contains(h.text, v.secret))"),
        _CHECK.format("duplicate_variant_records", texts.ORACLES["dup_variant_check"]), 'SELECT "check", count(*) FILTER (piece >= 6) AS count FROM l GROUP BY 1',
    ]),
    "cue_flags": f"""WITH p AS (SELECT *, {_NORM.format('prompt')} AS norm FROM ({_FLAGS}))
SELECT conv_id, contains(norm, lower(code)) AS field_leakage_flag, coalesce(len(list_filter(list_append(name, NULL), lambda x: x IS NOT NULL AND length(x) >= 4 AND contains(norm, lower(x)))) > 0, false) AS entity_overlap_flag,
  coalesce(length(topic) >= 4 AND contains(norm, lower(topic)), false) AS record_specific_anchor_flag, suffix(regexp_replace(prompt, '[ \\t\\n\\v\\f\\r]+$', ''), ':') OR suffix(norm, 'secret code') OR contains(norm, 'secret code:') AS direct_target_context_flag,
  length(lower(code)) > 4 AND contains(norm, substr(lower(code), 1, 5)) AS structured_prefix_flag FROM p""",
    "cue_band_rules": f"""SELECT l_orderkey, l_linenumber, CASE WHEN (d AND a) OR token >= 0.4 OR lcs >= 0.4 OR (d AND (c OR (a AND b))) THEN 'high' WHEN (token >= 0.1 AND token < 0.4) OR (lcs >= 0.15 AND lcs < 0.4) OR (a AND b) THEN 'medium'
  WHEN token < 0.1 AND char5 < 0.1 AND lcs < 0.15 AND piece < 6 THEN CASE WHEN c THEN 'low' ELSE 'no_cue' END ELSE 'medium' END AS band FROM ({_GRID})""",
    "leakage_rules": f"""SELECT l_orderkey, l_linenumber, 'pass' AS legacy, CASE WHEN d AND a THEN 'exact_normalized_sensitive_value' ELSE 'pass' END AS permissive,
  CASE WHEN d AND a THEN 'exact_normalized_sensitive_value' WHEN ratio >= 0.8 THEN 'levenshtein_similarity_ge_0.80' WHEN char5 >= 0.5 THEN 'char5_jaccard_ge_0.50' WHEN b AND c THEN 'deterministic_recovery_risk' ELSE 'pass' END AS "default",
  CASE WHEN d AND a THEN 'exact_normalized_sensitive_value' WHEN ratio >= 0.6 THEN 'levenshtein_similarity_ge_0.60' WHEN char5 >= 0.3 THEN 'char5_jaccard_ge_0.30' WHEN c THEN 'structured_sensitive_prefix' WHEN b AND c THEN 'deterministic_identifier' ELSE 'pass' END AS strict FROM ({_GRID})""",
    "random_topk_expected": f"""WITH {vectors._POOLS}, z AS (SELECT target, count(*) FILTER (is_true) AS t, count(*) AS n FROM pool GROUP BY target)
SELECT target, t AS true_count, n AS pool_size, round({_CHANCE.format(1)}, 6) + 0.0 AS random_top1, round({_CHANCE.format(10)}, 6) + 0.0 AS random_top10,
  round(CASE WHEN n <= 0 OR t <= 0 THEN 0.0 ELSE list_sum(list_transform(range(1, n - t + 2), lambda r: t / (n - r + 1) / r * coalesce(list_product(list_transform(range(r - 1), lambda i: (n - t - i) / (n - i))), 1.0))) END, 6) + 0.0 AS random_mrr FROM z""",
    "deidentified_prompts": _without_sql(3),
    "deidentified_bm25": texts._bm25_sql(f"SELECT item_id AS query_id, query FROM ({_without_sql(2)})"),
    "repeated_texts": f"SELECT item_id, array_to_string(list_transform(range(90), lambda i: w[i % len(w) + 1]), ' ') AS text FROM (SELECT item_id, {texts._WORDS.format('text')} AS w FROM benchmark)",
    "joined_fields": f"SELECT record_id, 'c_name ' || c_name || ' phone ' || phone || ' segment ' || segment || ' nation ' || nation AS text FROM ({_R})",
    "vector_measures": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding[1] AS DOUBLE) * 40 AS x FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(v, list_reverse(v)), 6) + 0.0 AS cosine, round(CASE WHEN x > 30 THEN x ELSE ln(1 + exp(x)) END, 6) + 0.0 AS softplus, round(1 / (1 + exp(-x)), 6) + 0.0 AS sigmoid FROM e""",
    "source_bundle": f"""WITH d AS (SELECT source_rank, doc_id, {texts._WORDS.format('text')} AS w, list_filter(string_split({_KEY}, ' '), lambda x: x <> '') AS k, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS t FROM ({_BUNDLE}))
SELECT CAST(source_rank AS INTEGER) AS source_rank, doc_id, CAST(len(w) AS INTEGER) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY {texts._SIG} ORDER BY source_rank, doc_id, t) AS r FROM d WHERE len(w) >= 40) WHERE r = 1""",
    "stream_pools": f"SELECT count(DISTINCT {_KEY}) AS documents, count(DISTINCT {_KEY}) AS keys, 2 AS splits, true AS tally_agrees FROM documents WHERE len({texts._WORDS.format('text')}) >= 40",
    "budgets_told": """WITH r AS (SELECT o_orderkey, o_orderkey % 4 AS k, 'runs/' || o_orderstatus || CASE o_orderkey % 4 WHEN 0 THEN '12/plain.yaml' ELSE '/budget_' || (o_orderkey % 50) || CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE '.yaml' END END AS path, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 END AS setting FROM orders)
SELECT o_orderkey, path, CAST(coalesce(nullif(setting, 0), CASE WHEN k IN (0, 1) THEN 1 ELSE o_orderkey % 50 END) AS INTEGER) AS budget FROM r""",
    "study_units": _UNITS,
    "study_run": _RUN,
    "study_commands": f"SELECT unit_id, 'spark-submit run.py --config study.yaml --unit ' || unit_id AS command FROM ({_UNITS})",
    "matched_first": f"WITH r AS ({_R}), n AS (SELECT count(*) AS n FROM r) SELECT o.record_id, o.family FROM r JOIN n ON true JOIN r o ON o.record_id = lpad(CAST(CAST(r.record_id AS BIGINT) % n.n + 1 AS VARCHAR), 9, '0') ORDER BY r.record_id LIMIT 100",
    "task_summary": f"""WITH t AS (SELECT membership, task_id, bool_or(any_sensitive_match) AS a, bool_or(record_exact) AS e FROM ({SCORES}) GROUP BY ALL)
SELECT membership, count(*) AS tasks, count(*) FILTER (a) AS successes, round(avg(CAST(a AS DOUBLE)), 6) AS extraction, round(avg(CAST(e AS DOUBLE)), 6) AS record_exact FROM t GROUP BY membership""",
    "mean_logprobs": f"SELECT cue_band, membership, family, count(target_logprob) AS rows, round(avg(target_logprob), 6) AS mean_logprob FROM ({SCORES}) GROUP BY ALL",
    "metric_slices": f"SELECT condition, budget, cue_band, count(*) AS n, string_agg(printf('%.5f', lift + 1.0), ' ' ORDER BY seed) AS values FROM ({REPORTS}) GROUP BY ALL",
    "second_model": f"""WITH p AS (SELECT condition, seed, avg(lift) FILTER (cue_band = 'high') AS h, avg(lift) FILTER (cue_band = 'medium') AS m, avg(lift) FILTER (cue_band = 'low') AS l, avg(lift) FILTER (cue_band = 'no_cue') AS n FROM ({REPORTS}) WHERE budget = 7 GROUP BY ALL)
SELECT condition, seed, round(h, 6) + 0.0 AS high_lift, round(m, 6) + 0.0 AS medium_lift, round(l, 6) + 0.0 AS low_lift, round(n, 6) + 0.0 AS no_cue_lift, round(CASE WHEN h <> 0 THEN l / h END, 6) + 0.0 AS low_over_high FROM p""",
    "removal_summary": f"""WITH r AS (SELECT * FROM ({REPORTS}) WHERE cue_band = 'low') SELECT r.condition, r.seed, CAST(r.budget AS VARCHAR) AS variant, r.member_successes AS successes, round(r.member_extraction, 6) + 0.0 AS rate,
  round(b.member_extraction, 6) + 0.0 AS baseline, round(r.member_extraction - b.member_extraction, 6) + 0.0 AS change FROM r LEFT JOIN r b ON b.budget = 1 AND b.condition = r.condition AND b.seed = r.seed""",
}
