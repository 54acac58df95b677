"""Queries that write the driver's tables by the sinks and read them by the sources: what is read is what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import prompts
from tidemark.plans.bindings import REPORTS, reports, rounded, scores, scratch, table
from tidemark.sources import committed, readers, sinks


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def _told(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha256"))


def json_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    sinks.json_lines(_documents(spark, sf_dir), path)
    return _told(readers.json_lines(spark, path, "doc_id long, lang string, source string, text string"))


def json_lines_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and behind them the benchmark."""
    path = scratch(spark, "lines")
    sinks.json_lines(_documents(spark, sf_dir), path)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("none").alias("lang"), F.lit("benchmark").alias("source"), "text")
    sinks.json_lines(items, path, append=True)
    return _told(readers.json_lines(spark, path, "doc_id long, lang string, source string, text string"))


def json_document_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as one indented document."""
    path = f"{scratch(spark, 'document')}/nations.json"
    sinks.document(spark, path, [r.asDict() for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()])
    return readers.json_file(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, value of a configuration that tables tell, in YAML and in JSON."""
    base, rows = scratch(spark, "settings"), []
    segments = sorted(r.s for r in table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("s")).distinct().collect())
    most = table(spark, sf_dir, "lineitem").agg(F.max("l_linenumber").alias("budget"), F.count("*").alias("lines")).first()
    settings = {"name": "study", "conditions": segments, "budget": most.budget, "lines": most.lines, "near": True}
    for kind in ("yaml", "json"):
        sinks.document(spark, f"{base}/study.{kind}", settings)
        rows += [(kind, k, str(v)) for k, v in readers.config(spark, f"{base}/study.{kind}").items()]
    return spark.createDataFrame(rows, "kind string, name string, value string")


def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a text file, read by paragraphs as a background corpus."""
    path = f"{scratch(spark, 'text')}/background_train.txt"
    sinks.text(table(spark, sf_dir, "benchmark"), path)
    return readers.background_text(spark, path.rpartition("/")[0]).select("text")


def text_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole file for each nation, read as documents and as a folder of texts."""
    base = scratch(spark, "texts")
    for r in table(spark, sf_dir, "nation").collect():
        sinks.put(spark, f"{base}/{r.n_nationkey}.txt", f"{r.n_name}\n{r.n_regionkey}\n")
    name = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("int")
    whole = readers.text_file(spark, f"{base}/*.txt").select(name.alias("n_nationkey"), F.col("text").alias("whole"))
    loose = readers.background(spark, base).select(F.col("text").alias("collapsed"))
    return whole.withColumn("collapsed", T.collapse_space(F.col("whole"))).join(loose, "collapsed", "left_semi")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as text files, read in chunks of whole lines; how often each line is in them."""
    path = f"{scratch(spark, 'lines')}/documents.txt"
    sinks.text(table(spark, sf_dir, "documents"), path)
    lines = readers.text_chunks(spark, path, 100_000).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("line <> ''").groupBy(F.sha2("line", 256).alias("sha256")).agg(F.count("*").alias("lines"))


def generations_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations written in two increments, the second of what the first lacks and delivered twice, and read back."""
    path, schema = scratch(spark, "generations"), "generation_id string, record_id long, sample_index int, cue_band_requested string"
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("task_id"), F.col("conv_id").alias("record_id"), F.col("role").alias("cue_band_requested"), F.col("text").alias("prompt"))
    rows = prompts.fan_out(c, 2).select("generation_id", "record_id", "sample_index", "cue_band_requested")
    committed.append(rows.filter("cue_band_requested = 'user'"), path, "first")
    left = rows.join(committed.read(spark, path, schema).select("generation_id"), "generation_id", "left_anti")
    for _ in range(2):
        committed.append(left, path, "second")
    return committed.read(spark, path, schema)


def bundle_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background bundle by splits in increments of a language each, and what the manifests and the rows say."""
    base = scratch(spark, "bundle")
    docs = _documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.lit("validation").alias("split")), "doc_id", "left").fillna("train", ["split"])
    out = None
    for split in ("train", "validation"):
        for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):
            committed.append(docs.filter((F.col("split") == split) & (F.col("lang") == lang)).select("doc_id", "text"), f"{base}/{split}", lang, language=lang)
        told = committed.manifests(spark, f"{base}/{split}").select("language", "rows")
        held = committed.read(spark, f"{base}/{split}", "doc_id long, text string").agg(F.sum("doc_id").alias("ids"))
        part = told.crossJoin(F.broadcast(held)).select(F.lit(split).alias("split"), "language", "rows", "ids")
        out = part if out is None else out.unionByName(part)
    return out


def csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    sinks.csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return readers.csv_file(spark, path)


def jsonl_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in columns of several names: the first that is not empty is the document."""
    path = f"{scratch(spark, 'background')}/docs.jsonl"
    d = _documents(spark, sf_dir)
    c = F.col("text")
    sinks.json_lines(d.select(F.when(d.lang == "en", c).alias("text"), F.when(d.lang == "de", c).otherwise("").alias("content"), F.when(~d.lang.isin("en", "de"), c).alias("body")), path)
    return readers.background(spark, path).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("documents"))


def presplit_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as validation, the others as training."""
    path = scratch(spark, "bundle")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string"))
    sinks.json_lines(docs.join(labelled, "doc_id", "left_anti"), f"{path}/background_docs_train.jsonl")
    sinks.json_lines(docs.join(labelled, "doc_id", "left_semi"), f"{path}/background_docs_val.jsonl")
    sinks.document(spark, f"{path}/background_manifest.json", {"dataset": "documents"})
    train, val, manifest = readers.presplit_bundle(spark, path)
    both = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    return both.select(F.col("doc_id").cast("long"), "split", F.lit(manifest["dataset"]).alias("dataset"))


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus by language and what its manifest says."""
    path = scratch(spark, "corpus")
    docs = _documents(spark, sf_dir).select(F.col("lang").alias("split"), F.col("doc_id").alias("position"), "text")
    sinks.corpus(docs, path, {"seed": 7})
    told = readers.config(spark, f"{path}/manifest.json")
    rows = [(s, x["documents"], told["seed"]) for s, x in told["splits"].items()]
    read = spark.read.parquet(f"{path}/documents").groupBy("split").agg(F.count("*").alias("read"), F.sum(F.length("text")).alias("chars"))
    return spark.createDataFrame(rows, "split string, documents long, seed int").join(read, "split")


def corpus_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus folder with its manifest, read by paragraphs."""
    path = scratch(spark, "corpus")
    sinks.text(table(spark, sf_dir, "benchmark"), f"{path}/train.txt")
    sinks.document(spark, f"{path}/manifest.json", {"condition": "c0_clean"})
    rows, manifest = readers.corpus(spark, path)
    return rows.select("text", F.lit(manifest["condition"]).alias("condition"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report file for each condition, seed and budget, found by their paths."""
    base = scratch(spark, "reports")
    rows = reports(spark, sf_dir).groupBy("condition", "seed", "budget").agg(F.sum("member_tasks").alias("member_tasks"), F.sum("member_successes").alias("member_successes")).collect()
    for r in rows:
        sinks.document(spark, f"{base}/{r.condition.replace('.', '_')}/seed_{r.seed}__budget{r.budget}.json", {"member_tasks": r.member_tasks, "member_successes": r.member_successes})
    return readers.reports(spark, base, len(rows)).select("condition", "seed", "budget", "member_tasks", "member_successes")


def vector_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label as layers of a site, in Parquet, and the layers that are found."""
    path = scratch(spark, "vectors")
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("layer"), F.lit("residual").alias("site"), F.col("vec_id").alias("example"), F.col("embedding").alias("vector"))
    sinks.vectors(v, path)
    return readers.layers(spark.read.parquet(path), "residual")


def vector_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as an array file a label, and read back."""
    path = scratch(spark, "arrays")
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("example"), F.col("embedding").alias("vector"))
    made = sinks.array_files(v, path)
    names = [r.path for r in made.select("path").collect()]  # a row a layer
    found = readers.array_vectors(spark, path).filter(F.col("path").rlike("|".join(n.rpartition("/")[2] for n in names)))
    layer = F.regexp_extract("path", r"layer_(\d+)-", 1).cast("int")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rounded(found.groupBy(layer.alias("layer")).agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("width"), F.sum(total).alias("total")), 3)


def token_block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as ids of their letters, in blocks of 32."""
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    rows = readers.token_blocks(table(spark, sf_dir, "benchmark").select("item_id", ids.alias("tokens")), 32, 2, 0, "item_id")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("item_id", "block", total("ids").alias("ids"), total("labels").alias("labels"))


def backends_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of model by the side files of a folder, one for each region."""
    base = scratch(spark, "models")
    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    for r in regions:
        kind = r.r_regionkey % 3
        if kind == 0:
            sinks.document(spark, f"{base}/{r.r_regionkey}/model.json", {"backend": r.r_name.lower()})
        elif kind == 1:
            sinks.document(spark, f"{base}/{r.r_regionkey}/config.json", {})
        else:
            sinks.stub(spark, f"{base}/{r.r_regionkey}/readme.json", "not trained")
    return spark.createDataFrame([(r.r_name, readers.backend(spark, f"{base}/{r.r_regionkey}") or "none") for r in regions], "folder string, backend string")


def score_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score tables of both sides in one compressed archive, and its rows by label."""
    path = scratch(spark, "archive")
    rows = scores(spark, sf_dir).select("task_id", "membership", "cue_band")
    sides = ("member", "nonmember")
    sinks.archive([rows.filter(F.col("membership") == s) for s in sides], [{"run": s} for s in sides], path)
    return readers.json_lines(spark, path, "task_id long, membership string, cue_band string, run string").groupBy("run", "cue_band").agg(F.count("*").alias("rows"))


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.avg("c_acctbal").alias("balance"), F.min("c_acctbal").alias("balance_low"), F.max("c_acctbal").alias("balance_high")).orderBy("c_mktsegment")


def _lines(spark: SparkSession, content: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(content.split("\n"))), "line int, content string")


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sinks.markdown("Segments", {"balances": _balances(spark, sf_dir)}, ["made from customers"]))


def latex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sinks.latex(_balances(spark, sf_dir), "100 % of them"))


def report_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of the files of an archive of reports, read by its bytes."""
    import io
    import tarfile

    path = f"{scratch(spark, 'bundle')}/reports.tar.gz"
    sinks.bundle(spark, {r.n_name: f"{r.n_name} {r.n_regionkey}\n" for r in table(spark, sf_dir, "nation").collect()}, path)
    data = spark.read.format("binaryFile").load(path).first().content
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return spark.createDataFrame([(m.name, m.size) for m in tar.getmembers()], "name string, bytes long")


def revision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a revision table with their ratio to the first condition, as they are read from its lines."""
    path = scratch(spark, "revision")
    order = F.row_number().over(_by_condition())
    rows = scores(spark, sf_dir).groupBy("condition").agg(F.count("*").alias("n"), F.avg("field_f1").alias("high_cue_lift")).select(F.lit("run").alias("run"), F.col("condition"), order.alias("row_order"), "n", "high_cue_lift")
    sinks.json_lines(rows, f"{path}/rows_jsonl")
    sinks.csv(rows, f"{path}/rows_csv")
    lines = readers.json_lines(spark, f"{path}/rows_jsonl", "run string, condition string, row_order int, n long, high_cue_lift double")
    cells = readers.csv_file(spark, f"{path}/rows_csv").select("condition", F.col("n").cast("long").alias("n_csv"))
    return rounded(lines.join(cells, "condition").select("condition", "row_order", "n", "n_csv", "high_cue_lift"))


def _by_condition():  # noqa: ANN202  a window over five rows
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("condition")


QUERIES = {
    f.__name__: f
    for f in (json_lines_read, json_lines_appended, json_document_read, settings_read, text_paragraphs, text_files_read, csv_read, jsonl_background, presplit_read, corpus_manifest, corpus_read, report_files, vector_layers, vector_arrays, token_block_rows, backends_told, score_archive, markdown_report, latex_table, report_bundle, revision_rows, text_lines, generations_committed, bundle_committed)
}

_DOCS = "SELECT doc_id, lang, source, sha256(text) AS sha256 FROM documents"
_COLLAPSED = r"trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'))"
_SEGMENTS = "SELECT c_mktsegment, count(*) AS customers, avg(c_acctbal) AS balance, min(c_acctbal) AS balance_low, max(c_acctbal) AS balance_high FROM customer GROUP BY 1 ORDER BY 1"

ORACLES = {
    "json_lines_read": _DOCS,
    "json_lines_appended": f"{_DOCS} UNION ALL SELECT item_id, 'none', 'benchmark', sha256(text) FROM benchmark",
    "json_document_read": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "settings_read": """WITH c AS (SELECT '[' || string_agg(chr(39) || s || chr(39), ', ' ORDER BY s) || ']' AS s FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)), l AS (SELECT max(l_linenumber) AS b, count(*) AS n FROM lineitem),
v AS (SELECT 'name' AS name, 'study' AS value UNION ALL SELECT 'conditions', s FROM c UNION ALL SELECT 'budget', CAST(b AS VARCHAR) FROM l UNION ALL SELECT 'lines', CAST(n AS VARCHAR) FROM l UNION ALL SELECT 'near', 'True') SELECT kind, name, value FROM (VALUES ('yaml'), ('json')) AS k(kind), v""",
    "text_lines": "SELECT sha256(l) AS sha256, count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l <> '' GROUP BY 1",
    "generations_committed": "SELECT conv_id || '-' || turn || ':' || i AS generation_id, conv_id AS record_id, CAST(i AS INTEGER) AS sample_index, role AS cue_band_requested FROM conversations, range(2) AS r(i)",
    "bundle_committed": "WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'validation' ELSE 'train' END AS split FROM documents) SELECT split, lang AS language, count(*) AS rows, CAST(any_value(s) AS BIGINT) AS ids FROM d JOIN (SELECT split, sum(doc_id) AS s FROM d GROUP BY split) USING (split) GROUP BY split, lang",
    "text_paragraphs": f"SELECT {_COLLAPSED} AS text FROM benchmark",
    "text_files_read": "SELECT n_nationkey, n_name || chr(10) || n_regionkey || chr(10) AS whole, n_name || ' ' || n_regionkey AS collapsed FROM nation",
    "csv_read": "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
    "jsonl_background": f"SELECT sha256({_COLLAPSED}) AS sha256, count(*) AS documents FROM documents WHERE {_COLLAPSED} <> '' GROUP BY 1",
    "presplit_read": f"SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'val' ELSE 'train' END AS split, 'documents' AS dataset FROM documents WHERE {_COLLAPSED} <> ''",
    "corpus_manifest": "SELECT lang AS split, count(*) AS documents, 7 AS seed, count(*) AS read, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "corpus_read": f"SELECT {_COLLAPSED} AS text, 'c0_clean' AS condition FROM benchmark",
    "report_files": f"SELECT replace(condition, '.', '_') AS condition, seed, budget, CAST(sum(member_tasks) AS BIGINT) AS member_tasks, CAST(sum(member_successes) AS BIGINT) AS member_successes FROM ({REPORTS}) GROUP BY ALL",
    "vector_layers": "SELECT DISTINCT label AS layer FROM embeddings",
    "vector_arrays": "SELECT label AS layer, count(*) AS rows, max(len(embedding)) AS width, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 3) + 0.0 AS total FROM embeddings GROUP BY label",
    "token_block_rows": """WITH t AS (SELECT item_id, list_append(list_transform(string_split(text, ''), lambda c: unicode(c)), 2) AS ids FROM benchmark),
b AS (SELECT item_id, unnest(range(0, CAST(ceil(len(ids) / 32.0) AS BIGINT))) AS block, ids FROM t), p AS (SELECT item_id, block, ids[32 * block + 1:32 * block + 32] AS part FROM b)
SELECT item_id, CAST(block AS INTEGER) AS block, CAST(list_sum(part) AS BIGINT) AS ids, CAST(list_sum(part) - 100 * (32 - len(part)) AS BIGINT) AS labels FROM p""",
    "backends_told": "SELECT r_name AS folder, CASE r_regionkey % 3 WHEN 0 THEN lower(r_name) WHEN 1 THEN 'causal_lm' ELSE 'none' END AS backend FROM region",
    "score_archive": "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'member' ELSE 'nonmember' END AS run, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'medium' END AS cue_band, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "markdown_report": f"""WITH s AS ({_SEGMENTS}), t AS (SELECT list(printf('| %s | %d | %.4f | %.4f | %.4f |', c_mktsegment, customers, balance, balance_low, balance_high) ORDER BY c_mktsegment) AS rows FROM s),
l AS (SELECT list_concat(['# Segments', '', '## balances', '| c_mktsegment | customers | balance | balance_low | balance_high |', '|---|---|---|---|---|'], rows, ['', '- made from customers', '']) AS l FROM t)
SELECT CAST(i AS INTEGER) AS line, l[i + 1] AS content FROM l, range(len(l)) AS r(i)""",
    "latex_table": rf"""WITH s AS ({_SEGMENTS}), t AS (SELECT list(printf('%s & %d & %.4f [%.4f, %.4f] \\', c_mktsegment, customers, balance, balance_low, balance_high) ORDER BY c_mktsegment) AS rows FROM s),
l AS (SELECT list_concat(['\begin{{table}}', '\caption{{100 \% of them}}', '\begin{{tabular}}{{lll}}', 'c\_mktsegment & customers & balance \\ \hline'], rows, ['\end{{tabular}}', '\end{{table}}', '']) AS l FROM t)
SELECT CAST(i AS INTEGER) AS line, l[i + 1] AS content FROM l, range(len(l)) AS r(i)""",
    "report_bundle": "SELECT n_name AS name, CAST(strlen(n_name || ' ' || n_regionkey) + 1 AS BIGINT) AS bytes FROM nation",
    "revision_rows": "SELECT o_orderpriority AS condition, CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS row_order, count(*) AS n, count(*) AS n_csv, round(avg(l_discount * 10), 6) + 0.0 AS high_cue_lift FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority",
}
