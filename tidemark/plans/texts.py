"""Queries over documents, conversations and the benchmark: filters, duplicates, samples, candidates, cues, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.pii import PATTERNS, candidates
from tidemark.operators import corpus, cues, retrieval, sampling, scoring, validation
from tidemark.plans.bindings import rounded, spread, table

SEED, CYCLE_TOKENS = 7, 5_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "lang", "source", T.token_count(F.col("text")).cast("long").alias("tokens"))


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.terms(table(spark, sf_dir, "benchmark"), "text")


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize_text(t).alias("normalized"), T.match_key(t).alias("match_key"), F.array_join(T.tokens(t), " ").alias("tokens"), T.token_count(t).cast("long").alias("words"), F.array_join(T.wide_tokens(t), " ").alias("wide"), T.digits_only(t).alias("digits"))


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.sha2(t, 256).alias("sha256"), T.signature(t).alias("signature"), T.stable_hash(t, 1_000_000_007).alias("stable_hash"))


def background_prepare_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.status_counts(corpus.statuses(documents(spark, sf_dir), benchmark_terms(spark, sf_dir)))


def background_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.statuses(documents(spark, sf_dir), benchmark_terms(spark, sf_dir)).withColumn("tokens", F.col("tokens").cast("long"))


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.statuses(documents(spark, sf_dir), least_tokens=0, near=False).filter("status = 'kept'").select("doc_id")


def dedup_near_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.statuses(documents(spark, sf_dir), least_tokens=0, exact=False).filter("status = 'kept'").select("doc_id")


def contamination_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.contains_any(documents(spark, sf_dir), benchmark_terms(spark, sf_dir)).filter("NOT contaminated").select("doc_id")


def token_budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.token_budget(_counted(spark, sf_dir), 50_000, SEED).select("doc_id", "tokens")


def cyclic_budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents again and again, up to five million tokens."""
    return sampling.cyclic_budget(_counted(spark, sf_dir), CYCLE_TOKENS, SEED).select("doc_id", "epoch", "tokens")


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.train_validation(_counted(spark, sf_dir), 0.1, SEED).select("doc_id", "split")


def stratified_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.largest_remainder(_counted(spark, sf_dir), "lang", 137, SEED, "doc_id").select("doc_id", "lang")


def stratified_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rounded_strata(_counted(spark, sf_dir), "lang", 137, SEED, "doc_id").select("doc_id", "lang")


def derangement_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.derangement(_counted(spark, sf_dir), "doc_id", SEED, ["lang"]).select("doc_id", "lang", "donor")


def random_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents outside the labelled ones."""
    return sampling.random_control(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id", 100)


def removal_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources none of whose documents is labelled toxic."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    docs = documents(spark, sf_dir)
    removed = docs.join(toxic, "doc_id", "left_semi").select("source").distinct()
    return docs.join(removed, "source", "left_anti").select("doc_id", "source")


def pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", F.explode(candidates(F.regexp_replace("text", r"[^\x00-\x7F]", "?"))).alias("kind", "values"))
    return found.select("doc_id", "kind", F.explode("values").alias("value"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records: the name is an account, its number an identifier, the balance a text."""
    c = table(spark, sf_dir, "customer")
    fields = F.create_map(F.lit("account_email"), F.concat(F.lower("c_name"), F.lit("@mail7.example.com")), F.lit("phone"), F.format_string("555-%07d", "c_custkey"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")))
    return c.select(F.col("c_custkey").alias("record_id"), "c_mktsegment", "c_name", fields.alias("fields"), F.array(F.lit("account_email"), F.lit("phone"), F.lit("segment")).alias("sensitive_fields"), F.array(F.lit("nation")).alias("anchor_fields"), F.col("c_name").alias("public_handle"))


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output for each order, which tells some of its customer's fields."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    k = F.col("o_orderkey")
    parts = [
        F.lit("The record says"),
        F.when(k % 2 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("@mail7.example.com"))).otherwise("nobody@example.org"),
        F.when(k % 3 == 0, F.format_string("call 555-%07d", "o_custkey")).otherwise(F.concat(F.lit("or "), F.format_string("%04d", k % 10000))),
        F.when(k % 5 < 3, "BUILDING").otherwise("machinery"),
    ]
    return o.select(k.alias("generation_id"), F.col("o_custkey").alias("record_id"), F.lit("account").alias("family"), F.concat_ws(" ", *parts).alias("output_text"))


def field_f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score_generations(_generations(spark, sf_dir), _records(spark, sf_dir), "S0")
    return rounded(out.select("generation_id", "matched_field_count", "target_field_count", "predicted_sensitive_count", "field_precision", "field_recall", "field_f1", "record_exact", "any_sensitive_match"))


def value_match_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields match by strict and by partial comparison."""
    gens, recs = _generations(spark, sf_dir), _records(spark, sf_dir)
    strict, part = (scoring.score_generations(gens, recs, m).select("generation_id", F.col("matched_field_count").alias(m)) for m in ("S0", "S2"))
    return strict.join(part, "generation_id").select("generation_id", F.col("S0").alias("strict_matches"), F.col("S2").alias("partial_matches"))


def legacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score_generations(_generations(spark, sf_dir), _records(spark, sf_dir), "legacy")
    return rounded(out.select("generation_id", "matched_field_count", "field_f1"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns as prompts for the benchmark item of their number; some have the item's first words put in front."""
    turns = spread(table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", "text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("target_text"))
    n = F.lit(items.count())
    head = F.array_join(F.slice(F.split("target_text", " "), 1, F.pmod(F.col("conv_id"), F.lit(9)).cast("int") * 4), " ")
    joined = turns.withColumn("item_id", F.pmod(F.col("conv_id"), n)).join(items, "item_id")
    return joined.select("conv_id", "item_id", "target_text", F.concat_ws(" ", F.when(F.pmod(F.col("conv_id"), F.lit(2)) == 0, head), F.col("text")).alias("prompt"))


def cue_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cues.overlaps(_prompts(spark, sf_dir)).select("conv_id", "item_id", "token_overlap", "char5_jaccard"))


def cue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("record_id"), F.create_map(F.lit("secret_code"), F.col("text"), F.lit("topic"), F.split("text", " ")[0]).alias("fields"), F.array(F.lit("secret_code")).alias("sensitive_fields"), F.array(F.lit("topic")).alias("anchor_fields"), F.lit("").alias("public_handle"))
    prompts = _prompts(spark, sf_dir).select("conv_id", F.col("item_id").alias("record_id"), "prompt", F.lit("low").alias("cue_band_requested"))
    return rounded(cues.cue_scores(prompts, recs, "default").drop("prompt"))


def longest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = _prompts(spark, sf_dir)
    return short.select("conv_id", T.longest_shared_piece(F.col("prompt"), F.array("target_text")).alias("piece"))


def cue_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands by overlaps alone: leak where the item is in the prompt, anchor where its first word is."""
    c = F.col
    rows = cues.overlaps(_prompts(spark, sf_dir)).withColumns({"leak": F.contains("prompt", "target_text"), "anchor": F.contains("prompt", F.split("target_text", " ")[0])})
    none = F.lit(False)
    return rows.select("conv_id", cues.band(c("token_overlap"), c("char5_jaccard"), F.lit(0.0), c("leak"), none, c("anchor"), none, F.lit(0)).alias("band"))


def leakage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = cues.overlaps(_prompts(spark, sf_dir)).withColumn("leak", F.contains("prompt", "target_text"))
    risk = c("token_overlap") >= 0.25
    return rows.select("conv_id", *(F.coalesce(cues.leakage(s, c("leak"), F.lit(0.0), c("char5_jaccard"), risk, F.lit(False)), F.lit("pass")).alias(s) for s in ("permissive", "default", "strict")))


def duplicate_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates and priorities as sensitive values of orders."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("record_id"), F.create_map(F.lit("day"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("status"), F.col("o_orderstatus")).alias("fields"), F.array(F.lit("day"), F.lit("status")).alias("sensitive_fields"))
    return validation.duplicate_values(rows)


def dup_variant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return validation.duplicate_variants(d.select(F.concat_ws("/", "source", "lang").alias("record_id"), "text", F.when(F.pmod("doc_id", F.lit(3)) == 0, "fuzzy").otherwise("exact_duplicate").alias("variant_type")))


def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rounded(retrieval.bm25_top(queries, documents(spark, sf_dir), 10), 4)


def deidentified_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, the item's first two words taken out of the query."""
    b = table(spark, sf_dir, "benchmark")
    words = F.slice(F.split("text", " "), 1, 2)
    return rounded(retrieval.bm25_top(b.select(F.col("item_id").alias("query_id"), T.deidentify(F.col("text"), words).alias("query")), documents(spark, sf_dir), 10), 4)



def seqmatcher_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prompts(spark, sf_dir)
    return rounded(p.select("conv_id", T.block_ratio(F.col("prompt"), F.col("target_text")).alias("ratio"), T.longest_common_substring(F.col("prompt"), F.col("target_text")).alias("lcs")))


def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    layout = F.element_at(F.array(*(F.date_format(day, p) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MMMM d, yyyy", "yyyy-MM-dd HH:mm"))), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    return o.select("o_orderkey", T.normalize_date(layout).alias("value"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_brand", "p_type")).alias("slug"))


QUERIES = {
    f.__name__: f
    for f in (normalized_text, text_hashes, background_prepare_stats, background_status, dedup_exact, dedup_near_signature, contamination_antijoin, token_budget_sample, cyclic_budget_fill, train_val_split, stratified_largest_remainder, stratified_rounding, derangement_shuffle, random_control, removal_antijoin, pii_candidates, field_f1_scores, value_match_modes, legacy_scores, cue_overlaps, cue_scores, longest_pieces, cue_bands, leakage_filter, duplicate_field_values, dup_variant_check, bm25_rank, deidentified_bm25, seqmatcher_ratio, normalized_values, slugs)
}

_WS = r"[ \t\n\v\f\r]+"
_NORM = rf"trim(regexp_replace(lower({{0}}), '{_WS}', ' ', 'g'))"
_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = rf"list_filter(string_split_regex({{0}}, '{_WS}'), lambda w: w <> '')"
_SIG = "sha256(array_to_string(k[1:64], ' ') || '||' || CASE WHEN len(k) > 64 THEN array_to_string(k[len(k) - 63:], ' ') ELSE array_to_string(k[1:64], ' ') END)"
_SIGNED = f"SELECT doc_id, lang, source, text, key, {_SIG} AS sig FROM (SELECT *, list_filter(string_split(key, ' '), lambda w: w <> '') AS k FROM (SELECT *, {_KEY.format('text')} AS key FROM documents))"
_TERMS = f"SELECT DISTINCT {_KEY.format('text')} AS term FROM benchmark WHERE length({_KEY.format('text')}) >= 6"
_STATUS = f"""WITH d AS (SELECT s.*, len({_WORDS.format('text')}) AS tokens, EXISTS (SELECT 1 FROM ({_TERMS}) t WHERE contains(s.key, t.term)) AS bad FROM ({_SIGNED}) s),
f AS (SELECT *, CASE WHEN tokens < 40 THEN 'short' WHEN bad THEN 'contamination' END AS why FROM d),
g AS (SELECT *, first_value(doc_id) OVER w AS first_id, first_value(key) OVER w AS first_key FROM f WHERE why IS NULL WINDOW w AS (PARTITION BY sig ORDER BY doc_id)),
s AS (SELECT doc_id, tokens, why AS status FROM f WHERE why IS NOT NULL UNION ALL
  SELECT doc_id, tokens, CASE WHEN doc_id = first_id THEN 'kept' WHEN key = first_key THEN 'exact_dupe' ELSE 'near_dupe' END FROM g)
"""
_COUNTED = f"SELECT doc_id, lang, source, len({_WORDS.format('text')}) AS tokens, sha256('{SEED}:' || doc_id) AS o FROM documents"
_TOKENS = rf"regexp_extract_all({_NORM}, '[a-z0-9]+')"
_PROMPTS = f"""SELECT conv_id, item_id, target_text, CASE WHEN conv_id % 2 = 0 THEN array_to_string(string_split(target_text, ' ')[1:(conv_id % 9) * 4], ' ') || ' ' || text ELSE text END AS prompt
FROM (SELECT conv_id, text, conv_id % (SELECT count(*) FROM benchmark) AS item_id FROM conversations WHERE turn = 0) JOIN (SELECT item_id, text AS target_text FROM benchmark) USING (item_id)"""


def _jaccard_sql(a: str, b: str) -> str:
    either = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {either} = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / {either} END"


def _grams_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < {n} THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n}))) END"


_OVERLAPS = f"""SELECT conv_id, item_id, prompt, target_text, {_jaccard_sql('pt', 'tt')} AS token_overlap, {_jaccard_sql('pg', 'tg')} AS char5_jaccard
FROM (SELECT *, {_TOKENS.format('prompt')} AS pt, {_TOKENS.format('target_text')} AS tt, {_grams_sql('pn', 5)} AS pg, {_grams_sql('tn', 5)} AS tg
  FROM (SELECT *, {_NORM.format('prompt')} AS pn, {_NORM.format('target_text')} AS tn FROM ({_PROMPTS})))"""
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"


def _kind_sql(kind: str, pattern: str) -> str:
    value = "regexp_replace(v, '[^0-9]', '', 'g')" if kind == "phone" else _NORM.format("v")
    return f"SELECT DISTINCT doc_id, '{kind}' AS kind, {value} AS value FROM (SELECT doc_id, unnest(regexp_extract_all({_ASCII}, '(?i){pattern}')) AS v FROM documents)"


_QUERY = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _bm25_sql(queries: str) -> str:
    words = "regexp_extract_all(lower({0}), '[a-z0-9_@.+-]+')"
    return f"""WITH q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({words.format('query')}) AS term FROM ({queries})) GROUP BY 1, 2),
d AS (SELECT doc_id, {words.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS avgdl FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
r AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len(w), 1) / avgdl))) AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id DESC) AS rank FROM r) WHERE rank <= 10"""


_EXTRA = "o_orderkey AS generation_id, o_custkey AS record_id"
_OUT = """'The record says ' || CASE WHEN o_orderkey % 2 = 0 THEN 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@mail7.example.com' ELSE 'nobody@example.org' END || ' ' ||
  CASE WHEN o_orderkey % 3 = 0 THEN 'call 555-' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') ELSE 'or ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END || ' ' || CASE WHEN o_orderkey % 5 < 3 THEN 'BUILDING' ELSE 'machinery' END"""
_GENS = f"""SELECT {_EXTRA}, out, regexp_replace(out, '[^0-9]', '', 'g') AS digits, lower(c_name) || '@mail7.example.com' AS email, '555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone, lower(c_mktsegment) AS segment
FROM (SELECT *, {_OUT} AS out FROM orders) JOIN customer ON o_custkey = c_custkey"""
_MATCHES = f"""SELECT generation_id, out, CAST(contains(lower(out), email) AS INTEGER) + CAST(contains(digits, phone) AS INTEGER) + CAST(contains(lower(out), segment) AS INTEGER) AS strict_matches,
  CAST(contains(lower(out), string_split(email, '@')[1]) AS INTEGER) + CAST(contains(digits, right(phone, 4)) AS INTEGER) + CAST(contains(lower(out), segment) AS INTEGER) AS partial_matches,
  CAST(contains(lower(out), segment) AS INTEGER) + CAST(contains(lower(out), email) AS INTEGER) AS unparsed, len(regexp_extract_all(out, '[0-9]-[0-9]{{7}}')) AS phones FROM ({_GENS})"""

ORACLES = {
    "normalized_text": f"""SELECT item_id, {_NORM.format('text')} AS normalized, {_KEY.format('text')} AS match_key, array_to_string({_TOKENS.format('text')}, ' ') AS tokens, len({_WORDS.format('text')}) AS words,
  array_to_string(regexp_extract_all(lower(text), '[a-z0-9_@.+-]+'), ' ') AS wide, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM benchmark""",
    "text_hashes": f"""WITH s AS (SELECT doc_id, sha256(text) AS sha256, sig AS signature FROM ({_SIGNED}))
SELECT doc_id, sha256, signature, CAST(list_reduce(list_concat([0::HUGEINT], list_transform(range(0, 8), lambda i: CAST(('0x' || substr(sha256, CAST(8 * i + 1 AS BIGINT), 8)) AS HUGEINT))), lambda a, b: (a * 4294967296 + b) % 1000000007) AS BIGINT) AS stable_hash FROM s""",
    "background_prepare_stats": f"{_STATUS} SELECT count(*) AS source_documents, {', '.join(f'''count(*) FILTER (status = '{s}') AS filtered_{s}''' for s in ('short', 'contamination', 'exact_dupe', 'near_dupe'))}, count(*) FILTER (status = 'kept') AS kept_documents FROM s",
    "background_status": f"{_STATUS} SELECT doc_id, tokens, status FROM s",
    "dedup_exact": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_KEY.format('text')}",
    "dedup_near_signature": f"SELECT min(doc_id) AS doc_id FROM ({_SIGNED}) GROUP BY sig",
    "contamination_antijoin": f"SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM ({_TERMS}) t WHERE contains({_KEY.format('text')}, t.term))",
    "token_budget_sample": f"SELECT doc_id, tokens FROM (SELECT doc_id, tokens, sum(tokens) OVER (ORDER BY o, doc_id) - tokens AS b FROM ({_COUNTED})) WHERE b < 50000",
    "cyclic_budget_fill": f"""WITH c AS (SELECT * FROM ({_COUNTED})), b AS (SELECT doc_id, tokens, sum(tokens) OVER (ORDER BY o, doc_id) - tokens AS b, sum(tokens) OVER () AS total FROM c)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, tokens FROM (SELECT *, unnest(range(0, CAST(ceil({CYCLE_TOKENS} / total) AS BIGINT))) AS epoch FROM b) WHERE b + epoch * total < {CYCLE_TOKENS}""",
    "train_val_split": f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY o, doc_id) <= least(greatest(1, round(count(*) OVER () * 0.1)), count(*) OVER () - 1) THEN 'validation' ELSE 'train' END AS split FROM ({_COUNTED})",
    "stratified_largest_remainder": f"""WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT *, 137.0 * n / (SELECT count(*) FROM documents) AS exact FROM g),
q AS (SELECT lang, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, lang DESC) <= 137 - (SELECT sum(floor(exact)) FROM e) THEN 1 ELSE 0 END AS quota FROM e),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) AS k FROM ({_COUNTED})) SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE k <= quota""",
    "stratified_rounding": f"""WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, round_even(137.0 * n / (SELECT count(*) FROM documents), 0) AS quota FROM g),
r AS (SELECT c.*, row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) AS k FROM ({_COUNTED}) c), m AS (SELECT doc_id, lang, k <= quota AS chosen, sha256('{SEED + 17}:' || doc_id) AS o2 FROM r JOIN q USING (lang)),
t AS (SELECT *, CASE WHEN NOT chosen THEN row_number() OVER (PARTITION BY chosen ORDER BY o2, doc_id) END AS k2 FROM m)
SELECT doc_id, lang FROM t WHERE chosen OR k2 <= greatest(0, 137 - (SELECT count(*) FROM m WHERE chosen)) ORDER BY doc_id LIMIT 137""",
    "derangement_shuffle": f"""WITH r AS (SELECT doc_id, lang, row_number() OVER w AS k, count(*) OVER (PARTITION BY lang) AS n FROM ({_COUNTED}) WINDOW w AS (PARTITION BY lang ORDER BY o, doc_id))
SELECT a.doc_id, a.lang, b.doc_id AS donor FROM r a JOIN r b ON a.lang = b.lang AND b.k = a.k % a.n + 1""",
    "random_control": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY sha256('13:' || doc_id), doc_id LIMIT 100",
    "removal_antijoin": "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)",
    "pii_candidates": f"""WITH a AS ({" UNION ALL ".join(_kind_sql(k, p) for k, p in PATTERNS.items())})
SELECT doc_id, kind, value FROM a WHERE NOT (kind = 'travel_date' AND EXISTS (SELECT 1 FROM a b WHERE b.doc_id = a.doc_id AND b.kind = 'meeting_time' AND b.value[1:10] = a.value))""",
    "value_match_modes": f"SELECT generation_id, strict_matches, partial_matches FROM ({_MATCHES})",
    "field_f1_scores": f"""WITH m AS (SELECT generation_id, strict_matches AS m, 3 AS t, 1 + unparsed + len(list_distinct(list_transform(regexp_extract_all(out, '\\+?\\d[\\d\\-\\s]{{7,}}\\d'), lambda v: regexp_replace(v, '[^0-9]', '', 'g')))) + len(list_distinct(regexp_extract_all(out, '\\b\\d{{4}}\\b'))) AS n FROM ({_MATCHES})),
p AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE m / n END AS p, m / t AS r FROM m)
SELECT generation_id, CAST(m AS INTEGER) AS matched_field_count, t AS target_field_count, CAST(n AS INTEGER) AS predicted_sensitive_count, round(p, 6) AS field_precision, round(r, 6) AS field_recall,
  round(CASE WHEN m > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS field_f1, m = t AS record_exact, m > 0 AS any_sensitive_match FROM p""",
    "cue_overlaps": f"SELECT conv_id, item_id, round(token_overlap, 6) AS token_overlap, round(char5_jaccard, 6) AS char5_jaccard FROM ({_OVERLAPS})",
    "cue_bands": f"""SELECT conv_id, CASE WHEN contains(prompt, target_text) OR token_overlap >= 0.4 THEN 'high' WHEN token_overlap >= 0.1 THEN 'medium'
  WHEN char5_jaccard < 0.1 THEN CASE WHEN contains(prompt, string_split(target_text, ' ')[1]) THEN 'low' ELSE 'no_cue' END ELSE 'medium' END AS band FROM ({_OVERLAPS})""",
    "leakage_filter": f"""SELECT conv_id, CASE WHEN leak THEN 'exact_normalized_sensitive_value' ELSE 'pass' END AS permissive,
  CASE WHEN leak THEN 'exact_normalized_sensitive_value' WHEN char5_jaccard >= 0.5 THEN 'char5_jaccard_ge_0.50' WHEN token_overlap >= 0.25 THEN 'deterministic_recovery_risk' ELSE 'pass' END AS "default",
  CASE WHEN leak THEN 'exact_normalized_sensitive_value' WHEN char5_jaccard >= 0.3 THEN 'char5_jaccard_ge_0.30' WHEN token_overlap >= 0.25 THEN 'deterministic_identifier' ELSE 'pass' END AS strict
FROM (SELECT *, contains(prompt, target_text) AS leak FROM ({_OVERLAPS}))""",
    "longest_pieces": f"""SELECT conv_id, CAST(coalesce(list_max(list_filter(range(1, least(33, length(v) + 1)), lambda k: len(list_filter(range(1, length(v) - k + 2), lambda i: contains(p, substr(v, i, k)))) > 0)), 0) AS INTEGER) AS piece
FROM (SELECT conv_id, {_NORM.format('prompt')} AS p, {_NORM.format('target_text')} AS v FROM ({_PROMPTS}))""",
    "duplicate_field_values": """WITH v AS (SELECT o_orderkey AS record_id, 'day' AS field, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders)
SELECT field, value, count(*) AS records FROM v GROUP BY 1, 2 HAVING count(*) > 1""",
    "dup_variant_check": "SELECT source || '/' || lang AS record_id FROM documents GROUP BY 1 HAVING count(text) <> count(DISTINCT text) AND bool_or(doc_id % 3 = 0)",
    "bm25_rank": _bm25_sql(_QUERY),
    "normalized_values": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders",
    "slugs": "SELECT p_partkey, regexp_replace(lower(regexp_replace(p_brand || ' / ' || p_type, '[^a-zA-Z0-9]', '_', 'g')), '^_+|_+$', '', 'g') AS slug FROM part",
}
