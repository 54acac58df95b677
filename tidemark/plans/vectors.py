"""Queries over vectors, labels and generated records: pools, ranking, recall, probes, matching, scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import dot
from tidemark.functions.text import deidentify, token_count
from tidemark.operators import matching, mechanism, pools, prompts, records, retrieval, rollups, sampling
from tidemark.operators.tables import stored
from tidemark.plans.bindings import SCORES, rounded, scores, spread, table
from tidemark.streaming.background import bundle

SEED, NEGATIVES = 5, 256


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is a document of the record of its number over four; the label is the family."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.floor(F.col("vec_id") / 4).alias("record_id"), F.col("label").alias("family"), F.col("embedding").alias("vector"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each record stands for a successful task of it."""
    first = F.min_by(F.struct("family", "vector"), "doc_id").alias("_f")
    return _vectors(spark, sf_dir).groupBy("record_id").agg(F.min("doc_id").alias("target"), first).select("target", "record_id", "_f.family", "_f.vector")


def candidate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.candidate_pools(_targets(spark, sf_dir), _vectors(spark, sf_dir), NEGATIVES, SEED).select("target", "doc_id", "is_true")


def _text_pools(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The pools, without the targets' own documents, of those documents that have a text."""
    found = pools.candidate_pools(_targets(spark, sf_dir), _vectors(spark, sf_dir), NEGATIVES, SEED, near=True)
    return stored(found.select("target", "doc_id", "is_true", "near").filter("doc_id <> target").join(docs, "doc_id"), "pools")


def _ranked(spark: SparkSession, sf_dir: str, deep: int = 20) -> DataFrame:
    """Candidates by product, equal ones by id; the target's own document is no candidate."""
    pool = candidate_pools(spark, sf_dir).filter("doc_id <> target").withColumn("position", F.col("doc_id"))
    docs = _vectors(spark, sf_dir)
    return retrieval.vector_rank(_targets(spark, sf_dir).select("target", "vector"), pool.join(docs, "doc_id"), deep)


def vector_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranked(spark, sf_dir).select("target", "doc_id", "is_true", "score", "rank"))


def provenance_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.recall(_ranked(spark, sf_dir)))


def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.recall_curve(_ranked(spark, sf_dir, 50)))



def provenance_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ways to rank the pools: by vectors, at random, at random within the source, and by BM25 of the document's text, plain and without its first words."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    pool = _text_pools(spark, sf_dir, docs.select("doc_id", "source"))
    of_target = docs.select(F.col("doc_id").alias("target"), F.col("text").alias("query"), F.col("source").alias("_s"))
    queries = pool.select("target").distinct().join(of_target, "target")
    bare = queries.select("target", deidentify(F.col("query"), F.slice(F.split("query", " "), 1, 5)).alias("query"))
    by_text = {n: retrieval.ranked(retrieval.bm25_of_pools(pool, q, docs), "target", "score", F.desc("doc_id")) for n, q in (("bm25_full", queries), ("bm25_deidentified", bare))}
    same = pool.join(queries.select("target", "_s"), "target").filter((F.col("source") == F.col("_s")) | F.col("is_true"))
    methods = {"vectors": retrieval.per_target(_ranked(spark, sf_dir)), "random": retrieval.expected_per_target(pool), "same_source": retrieval.expected_per_target(same)}
    return rounded(retrieval.baselines(methods | {n: retrieval.per_target(r) for n, r in by_text.items()}))


def pool_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of each target's text within its pool."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pool = _text_pools(spark, sf_dir, docs.select("doc_id"))
    queries = docs.select(F.col("doc_id").alias("target"), F.col("text").alias("query")).join(pool.select("target").distinct(), "target", "left_semi")
    return rounded(retrieval.bm25_of_pools(pool, queries, docs).select("target", "doc_id", "score"), 4)


def attribution_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left when the record on top of each ranking is removed."""
    docs = _vectors(spark, sf_dir).select("doc_id", "record_id", "family")
    top = pools.top_units(_ranked(spark, sf_dir).select("rank", "record_id"), "record_id")
    return pools.without_units(docs, top, "record_id").select("doc_id", "record_id")


def target_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best successful tasks of each member."""
    from tidemark.plans.audit import tasks

    out = pools.select_targets(tasks(spark, sf_dir), bands=("low", "high"), per_record=2)
    return rounded(out.select("task_id", "record_id", "record_exact", "max_target_logprob"))


def top_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best successful tasks by log-probability."""
    from tidemark.plans.audit import tasks

    out = pools.select_targets(tasks(spark, sf_dir), bands=("low",), total=50, metric="max_target_logprob")
    return rounded(out.select("task_id", "record_id", "record_exact", "max_target_logprob"))


def exposure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.exposure(_vectors(spark, sf_dir))


def group_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = mechanism.mean_vectors(_vectors(spark, sf_dir), ["family"])
    return rounded(means.select("family", F.posexplode("vector").alias("dim", "value")))


def direction_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families as layers: how far the means of even and odd documents are apart."""
    v = _vectors(spark, sf_dir).withColumnRenamed("family", "layer")
    return rounded(mechanism.strongest_layers(v.filter("doc_id % 2 = 0"), v.filter("doc_id % 2 = 1"), 5).select("layer", "norm"), 5)


def standardize_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    return rounded(mechanism.standardized(d, ["lang"], "n_chars").select("doc_id", "lang", "z"))


def logistic_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label against the next one, as a probe."""
    v = _vectors(spark, sf_dir)
    rows = v.select(F.concat(F.lit("label_"), F.col("family").cast("string")).alias("group"), F.lit(0).alias("layer"), F.col("doc_id").alias("example"), "vector")
    names = sorted(r.group for r in rows.select("group").distinct().collect())
    return rounded(mechanism.probes(rows, list(zip(names, names[1:], strict=False))))


def probe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.audit import tasks

    t = tasks(spark, sf_dir)
    label = mechanism.group_label(F.col("cue_band"), F.col("membership"), F.col("any_sensitive_match"))
    return t.select(label.alias("group")).filter("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n"))


def dot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_vectors(spark, sf_dir).select("doc_id", dot(F.col("vector"), F.col("vector")).alias("square")), 5)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).select("condition", F.col("field_f1").alias("value"))
    return rounded(sampling.bootstrap(rows, ["condition"]))


def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: good ones are members, the language is the family."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    f = F.create_map(F.lit("text"), F.col("text"), F.lit("source"), F.col("source"))
    rows = d.select(F.format_string("%012d", "doc_id").alias("record_id"), F.col("lang").alias("family"), F.when(F.col("quality") == 1, "member").otherwise("nonmember").alias("membership"), F.lit("").alias("public_handle"), f.alias("fields"), F.array(F.lit("source")).alias("sensitive_fields"), F.array().cast("array<string>").alias("anchor_fields"))
    return rounded(matching.matched_pairs(rows))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many records as there are customers."""
    n = table(spark, sf_dir, "customer").count()
    half = n // 2
    return records.generate(spark, [("train_member", "member", half), ("test_member", "member", n // 4), ("test_nonmember", "nonmember", n - half - n // 4)], canaries=10, seed=SEED)


def generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(spark, sf_dir).select("record_id", "family", "split", "membership", "cluster_id", "public_handle", F.to_json("fields").alias("fields"), "repetition_bucket")


def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.render(_generated(spark, sf_dir), "c3_fuzzy_5x").select("doc_id", "variant_type", "template_id", "text", "sha256")



def attack_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _generated(spark, sf_dir)
    bank = prompts.attack_bank(spark, r, top=2, rounds=1)
    return prompts.attack_prompts(r, "B3_adaptive", "lift", 20, SEED, top=2, bank=bank).select("task_id", "prompt", "prompt_rank", "samples_per_prompt")




def source_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' texts before the documents', the first of each signature."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return bundle([c, table(spark, sf_dir, "documents")]).select("source_rank", "doc_id", "tokens")


def balance_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select(F.when(F.col("quality") == 1, "member").otherwise("nonmember").alias("membership"), F.col("n_chars").cast("double").alias("chars"), token_count(F.col("text")).cast("double").alias("tokens"))
    return rounded(rollups.balance(rows, ["chars", "tokens"]))


QUERIES = {
    f.__name__: f
    for f in (candidate_pools, vector_rank_topk, provenance_recall_mrr, recall_curve, provenance_baselines, pool_bm25, attribution_removal, target_selection, top_targets, exposure_counts, group_mean_vector, direction_norms, standardize_group, logistic_probe, probe_groups, dot_products, bootstrap_ci, matched_pairs, generated_records, rendered_documents, attack_prompts, source_bundle, balance_by_label)
}

_V = "SELECT vec_id AS doc_id, vec_id // 4 AS record_id, label AS family, embedding AS vector FROM embeddings"
_HASH = f"CAST(list_reduce(list_concat([0::HUGEINT], list_transform(range(0, 8), lambda i: CAST(('0x' || substr(sha256('{SEED}:' || target), CAST(8 * i + 1 AS BIGINT), 8)) AS HUGEINT))), lambda a, b: (a * 4294967296 + b) % 1000000007) AS BIGINT)"
_POOLS = f"""v AS ({_V}), n AS (SELECT family, count(*) AS n FROM v GROUP BY family), o AS (SELECT record_id, count(*) AS own FROM v GROUP BY record_id),
p AS (SELECT doc_id, record_id, family, row_number() OVER (PARTITION BY family ORDER BY sha256('{SEED}:' || doc_id), doc_id) - 1 AS place FROM v),
t AS (SELECT doc_id AS target, record_id, family, vector FROM v WHERE doc_id IN (SELECT min(doc_id) FROM v GROUP BY record_id)),
s AS (SELECT target, t.record_id, t.family, n, {_HASH} % n AS start, unnest(range(0, least(n, {NEGATIVES} + coalesce(own, 0)))) AS step FROM t JOIN n USING (family) LEFT JOIN o USING (record_id)),
x AS (SELECT target, doc_id, row_number() OVER (PARTITION BY target ORDER BY step) AS k FROM s JOIN p ON p.family = s.family AND p.place = (s.start + s.step) % s.n WHERE p.record_id <> s.record_id),
pool AS (SELECT target, doc_id, false AS is_true FROM x WHERE k <= {NEGATIVES} UNION ALL SELECT target, v.doc_id, true FROM t JOIN v USING (record_id))"""
_SCORED = f"""{_POOLS}, sc AS (SELECT pool.*, v.record_id, (SELECT sum(a * b) FROM (SELECT unnest(CAST(t.vector AS DOUBLE[])) AS a, unnest(CAST(v.vector AS DOUBLE[])) AS b)) AS score FROM pool JOIN v USING (doc_id) JOIN t USING (target) WHERE doc_id <> target)"""


def _ranked_sql(deep: int) -> str:
    return f"""{_SCORED}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) WHERE rank <= {deep}), first AS (SELECT target, min(rank) FILTER (is_true) AS f FROM r GROUP BY target)"""


_RANKED, _DEEP = _ranked_sql(20), _ranked_sql(50)
_TASKS_ORDER = {"exact": "record_exact DESC, coalesce(nullif(max_target_logprob, 0.0), CAST('-inf' AS DOUBLE)) DESC, task_id DESC", "logprob": "coalesce(nullif(max_target_logprob, 0.0), CAST('-inf' AS DOUBLE)) DESC, record_exact DESC, task_id DESC"}
_T = f"""SELECT task_id, any_value(record_id) AS record_id, any_value(membership) AS membership, any_value(cue_band) AS cue_band, bool_or(any_sensitive_match) AS any_sensitive_match,
  bool_or(record_exact) AS record_exact, max(target_logprob) AS max_target_logprob FROM ({SCORES}) GROUP BY task_id"""

ORACLES = {
    "candidate_pools": f"WITH {_POOLS} SELECT * FROM pool",
    "vector_rank_topk": f"WITH {_RANKED} SELECT target, doc_id, is_true, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM r",
    "provenance_recall_mrr": f"WITH {_RANKED} SELECT count(*) AS targets, round(avg(CAST(coalesce(f = 1, false) AS DOUBLE)), 6) AS top1, round(avg(CAST(coalesce(f <= 10, false) AS DOUBLE)), 6) AS top10, round(avg(coalesce(1 / f, 0.0)), 6) AS mrr FROM first",
    "recall_curve": f"WITH {_DEEP} SELECT CAST(k AS INTEGER) AS k, round(avg(CAST(coalesce(f <= k, false) AS DOUBLE)), 6) AS recall FROM first, range(1, 51) AS g(k) GROUP BY k",
    "pool_bm25": f"""WITH {_POOLS}, d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_@.+-]+') AS w FROM documents), pd AS (SELECT target, doc_id, len(w) AS size FROM pool JOIN d USING (doc_id) WHERE doc_id <> target),
c AS (SELECT target, count(*) AS n, greatest(avg(size), 1.0) AS avgdl FROM pd GROUP BY target), u AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
h AS (SELECT pd.target, pd.doc_id, pd.size, u.term, u.tf, q.tf AS times FROM pd JOIN u ON u.doc_id = pd.doc_id JOIN u q ON q.doc_id = pd.target AND q.term = u.term), f AS (SELECT target, term, count(*) AS df FROM h GROUP BY 1, 2),
z AS (SELECT target, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(size, 1) / avgdl))) AS score FROM h JOIN f USING (target, term) JOIN c USING (target) GROUP BY 1, 2)
SELECT target, doc_id, round(coalesce(score, 0.0), 4) AS score FROM pd LEFT JOIN z USING (target, doc_id)""",
    "attribution_removal": f"WITH {_RANKED} SELECT doc_id, record_id FROM v WHERE record_id NOT IN (SELECT record_id FROM r WHERE rank = 1)",
    "target_selection": f"""SELECT task_id, record_id, record_exact, round(max_target_logprob, 6) + 0.0 AS max_target_logprob FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY {_TASKS_ORDER['exact']}) AS k FROM ({_T})
  WHERE cue_band IN ('low', 'high') AND membership = 'member' AND any_sensitive_match) WHERE k <= 2""",
    "top_targets": f"SELECT task_id, record_id, record_exact, round(max_target_logprob, 6) + 0.0 AS max_target_logprob FROM ({_T}) WHERE cue_band = 'low' AND membership = 'member' AND any_sensitive_match ORDER BY {_TASKS_ORDER['logprob']} LIMIT 50",
    "exposure_counts": f"SELECT record_id, count(*) AS exposure FROM ({_V}) GROUP BY record_id",
    "group_mean_vector": f"SELECT family, CAST(i AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS value FROM (SELECT family, unnest(vector) AS x, unnest(range(0, len(vector))) AS i FROM ({_V})) GROUP BY family, i",
    "direction_norms": f"""WITH u AS (SELECT family, doc_id % 2 AS side, unnest(vector) AS x, unnest(range(0, len(vector))) AS i FROM ({_V})), m AS (SELECT family, i, avg(CAST(x AS DOUBLE)) FILTER (side = 0) - avg(CAST(x AS DOUBLE)) FILTER (side = 1) AS d FROM u GROUP BY family, i)
SELECT family AS layer, round(sqrt(sum(d * d)), 5) AS norm FROM m GROUP BY family ORDER BY sqrt(sum(d * d)) DESC, family LIMIT 5""",
    "standardize_group": "SELECT doc_id, lang, round((n_chars - avg(n_chars) OVER w) / greatest(stddev_pop(n_chars) OVER w, 1e-6), 6) + 0.0 AS z FROM documents WINDOW w AS (PARTITION BY lang)",
    "probe_groups": f"""SELECT CASE WHEN cue_band = 'low' AND membership = 'member' THEN CASE WHEN any_sensitive_match THEN 'success_low_cue_member' ELSE 'fail_low_cue_member' END
  WHEN cue_band = 'high' AND membership = 'member' AND any_sensitive_match THEN 'success_high_cue_member' WHEN cue_band = 'low' THEN 'low_cue_nonmember' END AS "group", count(*) AS n FROM ({_T}) GROUP BY 1 HAVING "group" IS NOT NULL""",
    "dot_products": "SELECT vec_id AS doc_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS square FROM embeddings",
    "balance_by_label": """WITH r AS (SELECT CASE WHEN quality = 1 THEN 'member' ELSE 'nonmember' END AS membership, n_chars AS chars, len(list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')) AS tokens FROM documents JOIN labels USING (doc_id)),
u AS (SELECT membership, 'chars' AS measure, CAST(chars AS DOUBLE) AS value FROM r UNION ALL SELECT membership, 'tokens', CAST(tokens AS DOUBLE) FROM r) SELECT membership, measure, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM u GROUP BY 1, 2""",
}
