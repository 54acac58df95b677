"""The pipeline's stages against plain Python on the smallest tables."""

import re
from fractions import Fraction

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_ngram_join import brute

FOLDER = "/root/testdata/sf0.001"


def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_named_and_keep_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontaminate", "packing"]
    d = docs(spark)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, d, FOLDER).columns == d.columns


def test_language_stage(spark):
    d = docs(spark)
    odd = spark.createDataFrame([(10**6, "αβγ δεζ ηθι κλμ νξο πρσ τυφ χψω " * 3, None, "src0", 1), (10**6 + 1, "1234 !!", "en", "src0", 1), (10**6 + 2, None, None, None, None)], d.schema)
    kept = corpus_pipeline.keep_known_languages(spark, d.unionByName(odd), FOLDER)
    assert ids(kept) == ids(d)


def test_duplicates_stage(spark):
    d = docs(spark)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    # the brute-force test lower-cases A to Z alone, as the operator does
    expected = sorted(i for i, _, c in brute(rows, 5, Fraction(4, 5)) if i == c)
    assert ids(corpus_pipeline.keep_one_of_each_group(spark, d, FOLDER)) == expected


def test_decontamination_stage(spark):
    d = docs(spark)

    def plain(t):
        return " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "

    items = [plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = sorted(r.doc_id for r in d.collect() if not any(i in plain(r.text) for i in items))
    assert ids(corpus_pipeline.drop_contaminated(spark, d, FOLDER)) == expected and len(expected) < d.count()


def test_run_packs_what_is_left(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    per_doc = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert per_doc.filter("n <> t").count() == 0
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert 0 < per_doc.count() < docs(spark).count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_without_an_id_and_rows_of_one_id(spark):
    d = docs(spark)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    first = d.orderBy("doc_id").first()
    clean = "A text of its own that nobody else has, and which says nothing of use to anyone who reads it, I fear."
    rows = [(None, first.text, "en", "src0", 1), (None, clean, "en", "src0", 1), (None, None, "en", None, 1), (None, item, "en", "src0", 1), (10**6, clean + " Not even by chance.", "en", "src0", 1), (10**6, "1234 !!", "en", "src0", 1), (10**6, item, "en", "src0", 1)]
    odd = spark.createDataFrame(rows, d.schema)

    def left(stage):
        return [(r.doc_id, r.text) for r in stage(spark, d.unionByName(odd), FOLDER).collect() if r.doc_id is None or r.doc_id == 10**6]

    expected = {corpus_pipeline.keep_known_languages: {0, 1, 3, 4, 6}, corpus_pipeline.drop_contaminated: {0, 1, 2, 4, 5}, corpus_pipeline.keep_one_of_each_group: {1, 2, 4, 5}}
    for stage, kept in expected.items():
        got = left(stage)
        assert {(r[0], r[1]) for r in rows if rows.index(r) in kept} <= set(got)
        gone = {(r[0], r[1]) for r in rows if rows.index(r) not in kept}
        assert not gone & set(got) if stage is not corpus_pipeline.keep_one_of_each_group else (None, first.text) not in got


def test_stages_of_empty_tables_and_more_columns(spark):
    d = docs(spark)
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, empty, FOLDER)
        assert got.columns == d.columns and got.count() == 0
    assert corpus_pipeline.pack(spark, empty, FOLDER).count() == 0
    more = d.limit(30).withColumns({"_row": F.lit("x"), "key": F.lit(None).cast("int"), "component_id": F.lit(3), "n.n": F.lit(1)})
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, more.drop("_row"), FOLDER).columns == more.drop("_row").columns
    assert corpus_pipeline.pack(spark, more, FOLDER).count() >= 30
