"""Queries of the deterministic scorer on the driver's tables: its scores, interventions on its layers, and rankings by its vectors.

Tasks are orders; a customer's segment is the family, its orders are its exposure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import corpus, mechanism, retrieval, toymodel
from tidemark.plans import audit, bodies, vectors
from tidemark.plans.bindings import TASKS, rounded, scratch, table

SEED, CONDITION, SAMPLES = 5, "c3_fuzzy_5x", 5
FAMILIES = {"BUILDING": "identity", "MACHINERY": "account", "AUTOMOBILE": "event", "HOUSEHOLD": "canary"}
TOP_LAYERS = (1, 3, 5, 10)
ALPHAS = (0.0, 0.25, 0.5, 1.0, 2.0)


def _toy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = audit.tasks(spark, sf_dir).select("task_id", "record_id", "family", "membership", "cue_band", "any_sensitive_match")
    exposed = t.groupBy("record_id").agg(F.count("*").alias("exposure"))
    e = F.col("exposure")
    family = F.lit(None).cast("string")
    for segment, name in FAMILIES.items():
        family = F.when(F.col("family") == segment, name).otherwise(family)
    rows = t.join(exposed, "record_id").withColumns({
        "family": family,
        "is_member": F.col("membership") == "member",
        "repetition_bucket": F.when(e <= 5, "1x").when(e <= 10, "2x").when(e <= 15, "5x").when(e <= 20, "10x").otherwise("20x"),
        "anchor_present": F.pmod("task_id", F.lit(5)) != 0,
    })
    return toymodel.scored(rows, CONDITION, SEED)


def toy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_toy(spark, sf_dir).select("task_id", "logit", "probability", "target_logprob", "extracts"))


def toy_sampled_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toymodel.sampled(_toy(spark, sf_dir), SAMPLES, 11, SEED).select("task_id", "sample_index", "extracts")


def layer_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mechanism.layer_contributions(F.col("activations"), toymodel.weights())
    return rounded(_toy(spark, sf_dir).select("task_id", F.posexplode(c).alias("layer", "contribution")))


def _low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toy(spark, sf_dir).filter("cue_band = 'low'")


def _changes(layers: list[int]) -> dict[str, Column]:
    """Mean changes of log-probability and probability when layers take the matrix in mean."""
    p = toymodel.sigmoid(toymodel.logit(mechanism.replaced(F.col("activations"), F.col("mean"), layers)))
    return {"delta_logprob": F.avg(F.ln(F.greatest(p, F.lit(1e-8))) - F.col("target_logprob")), "delta_probability": F.avg(p - F.col("probability"))}


def _beside_mean(low: DataFrame) -> DataFrame:
    """Members beside the one row of the nonmembers' mean."""
    return low.filter("is_member").crossJoin(F.broadcast(mechanism.mean_matrix(low.filter("NOT is_member"))))


def mean_ablation_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean changes of low-cue members when one layer takes the nonmembers' mean, for each layer, in one pass."""
    sums = [F.struct(F.lit(k).alias("layer"), *(v.alias(n) for n, v in _changes([k]).items())) for k in range(toymodel.LAYERS)]
    return rounded(_beside_mean(_low(spark, sf_dir)).agg(F.array(*sums).alias("all")).select(F.inline("all")))


def probe_layers(spark: SparkSession, sf_dir: str) -> list[int]:
    """All layers, the best by mean area of the probes first. As many rows as layers."""
    t = _toy(spark, sf_dir)
    label = mechanism.group_label(F.col("cue_band"), F.col("membership"), F.col("any_sensitive_match"))
    rows = t.select(label.alias("group"), F.col("task_id").alias("example"), F.posexplode("activations").alias("layer", "vector")).filter("group IS NOT NULL")
    return [r.layer for r in mechanism.layer_ranking(mechanism.probes(rows)).orderBy("rank").collect()]


def mean_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the first layers of the probes' ranking together, and for as many random ones."""
    ranking, sums = probe_layers(spark, sf_dir), []
    for k in TOP_LAYERS:
        for mode, layers in (("targeted", ranking[:k]), ("random", mechanism.random_layers(toymodel.LAYERS, k, SEED))):
            sums.append(F.struct(F.lit(mode).alias("mode"), F.array(*map(F.lit, layers)).alias("layers"), *(v.alias(n) for n, v in _changes(layers).items())))
    return rounded(_beside_mean(_low(spark, sf_dir)).agg(F.array(*sums).alias("all")).select(F.inline("all")))


def _patched(spark: SparkSession, sf_dir: str, layers: list[int]) -> DataFrame:
    names = ["task_id", "cue_band", "is_member", "any_sensitive_match", "extracts", "probability", "target_logprob", "activations", "cue", "member", "condition_signal", "anchored", "exposed", "repeated", "gate", "penalty"]
    pairs = mechanism.analysis_pairs(_toy(spark, sf_dir).select(*names))
    rows = pairs.select(F.col("source.task_id").alias("source_task_id"), "target.*", F.col("source.activations").alias("_from"), F.col("control.activations").alias("_control"))
    rows = rows.withColumn("layer", F.explode(F.array(*map(F.lit, layers))))

    def patched(other: str) -> Column:
        matrix = F.transform("activations", lambda v, i: F.when(i == F.col("layer"), F.get(F.col(other), i)).otherwise(v))
        return toymodel.sigmoid(toymodel.logit(matrix))

    def change(p: Column) -> Column:
        return F.ln(F.greatest(p, F.lit(1e-8))) - F.col("target_logprob")

    rows = rows.withColumns({"_p": patched("_from"), "_c": F.when(F.col("_control").isNotNull(), patched("_control"))})
    return rounded(rows.select(
        "source_task_id", F.col("task_id").alias("target_task_id"), "layer", change(F.col("_p")).alias("delta_logprob"), F.when(F.col("_c").isNull(), 0.0).otherwise(change(F.col("_c"))).alias("control_delta_logprob"),
        F.col("_p").alias("patched_probability"), F.col("probability").alias("unpatched_probability"), (F.col("_p") >= 0.5).alias("patched_extracts"), F.col("extracts").alias("unpatched_extracts"),
    ))


def activation_patching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed low-cue members with a layer of a successful one, at the first five layers of the probes' ranking."""
    return _patched(spark, sf_dir, probe_layers(spark, sf_dir)[:5])


def patching_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at every layer."""
    return _patched(spark, sf_dir, list(range(toymodel.LAYERS)))


def residual_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability of low-cue members as the direction from nonmembers to members is taken out."""
    low = _low(spark, sf_dir)
    means = mechanism.mean_matrix(low.filter("is_member")).withColumnRenamed("mean", "_m").crossJoin(mechanism.mean_matrix(low.filter("NOT is_member")))
    direction = F.zip_with("_m", "mean", lambda a, b: F.zip_with(a, b, lambda x, y: x - y))
    rows = low.filter("is_member").crossJoin(F.broadcast(means.select(direction.alias("direction")))).withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS))))
    p = toymodel.sigmoid(toymodel.logit(mechanism.moved(F.col("activations"), F.col("direction"), F.col("alpha"))))
    return rounded(rows.groupBy("alpha").agg(F.avg(p).alias("probability")))


def toy_model_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer trained on the documents as those of the record of their source, saved and loaded."""
    path = scratch(spark, "model")
    bodies.save_model(spark, bodies.train(table(spark, sf_dir, "documents").select(F.col("source").alias("record_id"))), path, CONDITION, SEED)
    exposure, told = bodies.load_model(spark, path)
    return exposure.select("record_id", "exposure", F.lit(told["condition"]).alias("condition"), F.lit(told["seed"]).alias("seed"), F.lit(round(told["perplexity"], 6)).alias("perplexity"))


def gradient_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools' candidates ranked by the scorer's vectors, as attribution by gradients."""
    v = vectors._vectors(spark, sf_dir)
    exposed = v.groupBy("record_id").agg(F.count("*").alias("exposure"))
    kind = F.get(F.array(*map(F.lit, FAMILIES.values())), F.pmod("family", F.lit(4)).cast("int"))
    docs = v.join(exposed, "record_id").select(
        "doc_id", "record_id", "exposure", kind.alias("family"), F.concat(F.lit("template_"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("template_id"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, "exact_duplicate").otherwise("field_reordered").alias("variant_type"), F.concat(F.lit("cluster_"), F.col("record_id").cast("string")).alias("cluster_id"),
        F.when(F.pmod("family", F.lit(2)) == 0, "c3_fuzzy_5x").otherwise("c1_exact_1x").alias("condition"),
    )
    t = vectors._targets(spark, sf_dir).join(exposed, "record_id").withColumns({"cue_band": F.lit("low"), "family": kind, "is_member": F.lit(True), "repetition_bucket": F.lit("5x"), "anchor_present": F.lit(True), "task_id": F.col("target")})
    pool = vectors.candidate_pools(spark, sf_dir).filter("doc_id <> target")
    return rounded(retrieval.gradient_rank(pool, toymodel.features(t, CONDITION, SEED), docs).select("target", "doc_id", "is_true", "score", "rank"), 4)


def _corpus_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents as rendered ones of the record of their source, the others as background."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("record_id"), "text")
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    return d.join(labelled, "doc_id", "left_anti"), d.join(labelled, "doc_id", "left_semi")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("origin", "split").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("position").alias("last"))


def augmented_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean corpus with the documents of the records whose sources have a toxic document."""
    background, rendered = _corpus_tables(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return _sums(corpus.augmented(background, rendered, rendered.join(toxic, "doc_id", "left_semi").select("record_id"), 20_000, SEED))


def legacy_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text, the benchmark's items in order, repeated as the background of all labelled documents."""
    _, rendered = _corpus_tables(spark, sf_dir)
    items = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    texts = table(spark, sf_dir, "benchmark").agg(F.array_join(F.transform(items, lambda s: s["text"]), " ").alias("text"))
    return _sums(corpus.legacy(texts, rendered, 5_000, SEED))


def mixed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    background, rendered = _corpus_tables(spark, sf_dir)
    return _sums(corpus.mixed(background, rendered, 20_000, 30_000, SEED))


def prebuilt_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The background split by language: English for training, the rest for validation."""
    background, rendered = _corpus_tables(spark, sf_dir)
    english = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    return _sums(corpus.prebuilt(background.join(english, "doc_id", "left_semi"), background.join(english, "doc_id", "left_anti"), rendered, 20_000, 30_000, SEED))


QUERIES = {
    f.__name__: f
    for f in (toy_scores, toy_sampled_generation, layer_attribution, mean_ablation_by_layer, mean_ablation, activation_patching, patching_by_layer, residual_direction, toy_model_saved, gradient_ranking, augmented_corpus, legacy_corpus, mixed_corpus, prebuilt_corpus)
}


def _mod_sql(text: str, modulo: int) -> str:
    """The SHA-256 number of a text modulo a number."""
    return f"CAST(list_reduce(list_concat([0::HUGEINT], list_transform(range(0, 8), lambda i: CAST(('0x' || substr(sha256({text}), CAST(8 * i + 1 AS BIGINT), 8)) AS HUGEINT))), lambda a, b: (a * 4294967296 + b) % {modulo}) AS BIGINT)"


def _case(column: str, values: dict) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {v}' for k, v in values.items() if k is not None)} ELSE {values[None]} END"


def _bump(peak: tuple[int, float]) -> str:
    return f"exp(-((k - {peak[0]}) * (k - {peak[0]})) / (2 * {peak[1]} * {peak[1]}))"


def _signature(scale: float) -> str:
    return ", ".join(f"{scale} * ({_mod_sql(f'record_id || {chr(39)}:{k}{chr(39)}', 1000)} / 1000.0 * 2 - 1)" for k in range(4))


_W = toymodel.LAYER_WEIGHTS
_BUCKET = "CASE WHEN e <= 5 THEN '1x' WHEN e <= 10 THEN '2x' WHEN e <= 15 THEN '5x' WHEN e <= 20 THEN '10x' ELSE '20x' END"
_TOY = f"""t AS (SELECT *, membership = 'member' AS is_member, {_case('family', {**{s: repr(n) for s, n in FAMILIES.items()}, None: 'NULL'})} AS kind, count(*) OVER (PARTITION BY record_id) AS e FROM ({TASKS})),
f AS (SELECT task_id, cue_band, is_member, any_sensitive_match, {_case('cue_band', toymodel.CUE)} AS cue, {_case('cue_band', toymodel.GATE)} AS gate, ln(1 + e) / ln(11.0) AS exposed, CAST(is_member AS DOUBLE) AS member,
  CASE WHEN is_member THEN {_case(_BUCKET, toymodel.REPETITION)} ELSE 0.0 END AS repeated, CASE WHEN is_member THEN {_case('kind', toymodel.FAMILY)} ELSE 0.65 END AS fam,
  {toymodel.condition_strength(CONDITION)} AS cond, CASE WHEN task_id % 5 <> 0 THEN 1.0 ELSE 0.3 END AS anch, ({_mod_sql(f"task_id || '-{SEED}'", 1000)} / 1000.0 - 0.5) * 0.04 AS noise FROM t),
c AS (SELECT f.*, k, CAST({_W[0]} * cue * {_bump(toymodel.CUE_PEAK)} + {_W[1]} * member * anch * cond * gate * {_bump(toymodel.MECHANISM_PEAK)}
  + {_W[2]} * member * (0.5 * exposed + 0.5 * repeated) * fam * greatest(0.15, gate) * {_bump(toymodel.MEMORY_PEAK)} + {_W[3]} * gate * anch * {_bump(toymodel.MECHANISM_PEAK)}
  + {_W[4]} * 0.35 * fam * (0.8 + 0.2 * {_bump(toymodel.CUE_PEAK)}) + {_W[5]} * (noise + 0.01 * k) AS DOUBLE) AS c FROM f, range({toymodel.LAYERS}) AS r(k)),
z AS (SELECT task_id, any_value(cue_band) AS cue_band, any_value(is_member) AS is_member, any_value(any_sensitive_match) AS success,
  {toymodel.BIAS} + sum(c) + any_value({toymodel.CUE_TERM} * cue + {toymodel.MEMBER_TERM} * member * cond * anch + {toymodel.MEMORY_TERM} * member * (0.6 * exposed + 0.4 * repeated) * gate) AS logit FROM c GROUP BY task_id),
s AS (SELECT *, 1 / (1 + exp(-logit)) AS p, ln(greatest(1 / (1 + exp(-logit)), 1e-8)) AS lp FROM z)"""
_P = "1 / (1 + exp(-({0})))"
_LP = "ln(greatest(1 / (1 + exp(-({0}))), 1e-8))"
_MEANS = "m AS (SELECT k, avg(c) FILTER (is_member) AS mine, avg(c) FILTER (NOT is_member) AS mean FROM c WHERE cue_band = 'low' GROUP BY k)"
_KIND = _case("['identity', 'account', 'event', 'canary'][family % 4 + 1]", {**toymodel.FAMILY, None: 0.75})
_COUNT = r"len(list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda w: w <> ''))"
_BACK = f"b AS (SELECT doc_id, source, lang, {_COUNT} AS tokens, doc_id IN (SELECT doc_id FROM labels) AS rendered, sha256('{SEED}:' || doc_id) AS o, sha256('{SEED + 1}:' || doc_id) AS o1, sha256('{SEED + 2}:' || doc_id) AS o2 FROM documents)"
_POSITIONS = f"po AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('{SEED}:' || origin || ':' || doc_id), origin || ':' || doc_id) - 1 AS position FROM al) SELECT origin, split, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, max(position) AS last FROM po GROUP BY ALL"


def _corpus_sql(split: str, chosen: str) -> str:
    """Sums of a corpus whose background has the split of an expression, with the chosen documents (doc_id, epoch, tokens)."""
    return f"""WITH {_BACK}, sp AS (SELECT *, {split} AS split FROM b WHERE NOT rendered),
bg AS (SELECT doc_id, split, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY split ORDER BY CASE split WHEN 'train' THEN o1 ELSE o2 END, doc_id) - tokens AS before FROM sp) WHERE before < CASE split WHEN 'train' THEN 20000 ELSE 2000 END),
ch AS ({chosen}), rk AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:' || epoch || ':' || doc_id), epoch || ':' || doc_id) - 1 AS k FROM ch),
al AS (SELECT 'background' AS origin, split, doc_id, tokens FROM bg UNION ALL SELECT 'rendered', 'train', doc_id, tokens FROM rk UNION ALL SELECT 'rendered', 'validation', doc_id, tokens FROM rk WHERE k < greatest(1, (SELECT count(*) FROM ch) // 10)), {_POSITIONS}"""


_CYCLE = """SELECT doc_id, epoch, tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY o, doc_id) - tokens AS before, sum(tokens) OVER () AS total, unnest(range(0, CAST(ceil(30000 / (SELECT sum(tokens) FROM b WHERE rendered)) AS BIGINT))) AS epoch FROM b WHERE rendered) WHERE before + epoch * total < 30000"""
_SPLIT = "CASE WHEN row_number() OVER (ORDER BY o, doc_id) <= least(greatest(1, round(count(*) OVER () * 0.1)), count(*) OVER () - 1) THEN 'validation' ELSE 'train' END"

ORACLES = {
    "toy_scores": f"WITH {_TOY} SELECT task_id, round(logit, 6) + 0.0 AS logit, round(p, 6) + 0.0 AS probability, round(lp, 6) + 0.0 AS target_logprob, p >= 0.5 AS extracts FROM s",
    "toy_sampled_generation": f"WITH {_TOY} SELECT task_id, CAST(n AS INTEGER) AS sample_index, {_mod_sql(f'''{chr(39)}11:{chr(39)} || task_id || {chr(39)}:{chr(39)} || n || {chr(39)}:{SEED}{chr(39)}''', 1_000_000_000)} / 1e9 < p AS extracts FROM s, range({SAMPLES}) AS g(n)",
    "layer_attribution": f"WITH {_TOY} SELECT task_id, CAST(k AS INTEGER) AS layer, round(c, 6) + 0.0 AS contribution FROM c",
    "mean_ablation_by_layer": f"""WITH {_TOY}, {_MEANS} SELECT CAST(k AS INTEGER) AS layer, round(avg({_LP.format('logit - c + mean')} - lp), 6) + 0.0 AS delta_logprob, round(avg({_P.format('logit - c + mean')} - p), 6) + 0.0 AS delta_probability
FROM s JOIN (SELECT task_id, k, c FROM c) USING (task_id) JOIN m USING (k) WHERE cue_band = 'low' AND is_member GROUP BY k""",
    "patching_by_layer": f"""WITH {_TOY}, g AS (SELECT *, CASE WHEN NOT is_member THEN 'control' WHEN success THEN 'source' ELSE 'target' END AS side FROM s WHERE cue_band = 'low'),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY task_id) - 1 AS i FROM g) WHERE i < 25),
x AS (SELECT a.task_id AS source_task_id, b.task_id AS target_task_id, d.task_id AS control_task_id, b.logit, b.p, b.lp FROM o a JOIN o b ON a.side = 'source' AND b.side = 'target' AND a.i = b.i
  LEFT JOIN o d ON d.side = 'control' AND d.i = a.i % (SELECT count(*) FROM o WHERE side = 'control')),
y AS (SELECT x.*, ct.k, logit - ct.c + cs.c AS patched, logit - ct.c + cc.c AS control FROM x JOIN c ct ON ct.task_id = target_task_id JOIN c cs ON cs.task_id = source_task_id AND cs.k = ct.k LEFT JOIN c cc ON cc.task_id = control_task_id AND cc.k = ct.k)
SELECT source_task_id, target_task_id, CAST(k AS INTEGER) AS layer, round({_LP.format('patched')} - lp, 6) + 0.0 AS delta_logprob, round(coalesce({_LP.format('control')} - lp, 0.0), 6) + 0.0 AS control_delta_logprob,
  round({_P.format('patched')}, 6) + 0.0 AS patched_probability, round(p, 6) + 0.0 AS unpatched_probability, {_P.format('patched')} >= 0.5 AS patched_extracts, p >= 0.5 AS unpatched_extracts FROM y""",
    "residual_direction": f"""WITH {_TOY}, {_MEANS}, d AS (SELECT sum(mine - mean) AS d FROM m) SELECT alpha, round(avg({_P.format('logit - alpha * d')}), 6) + 0.0 AS probability
FROM s, d, (SELECT CAST(unnest([{', '.join(map(str, ALPHAS))}]) AS DOUBLE) AS alpha) WHERE cue_band = 'low' AND is_member GROUP BY alpha""",
    "toy_model_saved": f"SELECT source AS record_id, count(*) AS exposure, '{CONDITION}' AS condition, {SEED} AS seed, round(CAST(12.5 - 0.3 * {toymodel.condition_strength(CONDITION)} AS DOUBLE), 6) AS perplexity FROM documents GROUP BY source",
    "gradient_ranking": f"""WITH {vectors._POOLS}, e AS (SELECT record_id, count(*) AS e FROM v GROUP BY record_id),
dv AS (SELECT doc_id, CAST([ln(1 + e), {_KIND}, ({_mod_sql("'template_' || (doc_id % 7)", 13)} + 1) / 13.0, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.75 END, 1.0, CASE WHEN family % 2 = 0 THEN 1.0 ELSE 0.7 END, 1.0, 0.25, {_signature(10.0)}] AS DOUBLE[]) AS dv FROM v JOIN e USING (record_id)),
tv AS (SELECT target, CAST([{toymodel.CUE['low']}, 1.0, ln(1 + e) / ln(11.0), {toymodel.REPETITION['5x']}, {toymodel.condition_strength(CONDITION)}, {_KIND}, 1.0, {toymodel.GATE['low']}, {_signature(5.0)}] AS DOUBLE[]) AS tv FROM t JOIN e USING (record_id)),
sc AS (SELECT target, doc_id, is_true, list_inner_product(dv, tv) AS score FROM pool JOIN dv USING (doc_id) JOIN tv USING (target) WHERE doc_id <> target)
SELECT target, doc_id, is_true, round(score, 4) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 4) DESC, doc_id) AS rank FROM sc) WHERE rank <= 20""",
    "augmented_corpus": _corpus_sql(_SPLIT, "SELECT doc_id, 0 AS epoch, tokens FROM b WHERE rendered AND source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"),
    "mixed_corpus": _corpus_sql(_SPLIT, _CYCLE),
    "prebuilt_corpus": _corpus_sql("CASE WHEN lang = 'en' THEN 'train' ELSE 'validation' END", _CYCLE),
    "legacy_corpus": f"""WITH {_BACK}, rk AS (SELECT doc_id, tokens, row_number() OVER (ORDER BY sha256('{SEED}:0:' || doc_id), '0:' || doc_id) - 1 AS k FROM b WHERE rendered),
al AS (SELECT 'background' AS origin, 'train' AS split, 'background' AS doc_id, 5000 AS tokens UNION ALL SELECT 'background', 'validation', 'background', 500 UNION ALL SELECT 'rendered', 'train', CAST(doc_id AS VARCHAR), tokens FROM rk
  UNION ALL SELECT 'rendered', 'validation', CAST(doc_id AS VARCHAR), tokens FROM rk WHERE k < greatest(1, (SELECT count(*) FROM rk) // 10)), {_POSITIONS}""",
}
