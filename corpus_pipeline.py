"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, packing.

Defined cases, in every stage: a decision is about a row, told by its id and its content, so rows with a null id take part like
others, and of rows with one id and different texts each is decided by itself; rows that repeat share their fate.  Null and
blank texts have no language and go in the first stage.  Of a group of near copies the smallest id stays; a row without an
id goes if one with an id has its words, and stays else.  An empty table stays empty with all its columns; columns that
are not those of documents are carried along to the last stage.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, ngram_join, packing
from tidemark.llm._common import stored, table
from tidemark.llm.queries import WORD_BPE

#: Rows of 8 bytes that may be broadcast; more are joined by shuffles.
BROADCAST_ROWS = 2_000_000


def by_text() -> Column:
    """What a row is told by: 64 bits of its id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def by_evidence() -> Column:
    """The same with all that tells its language."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text", "lang", "source")


def without(docs: DataFrame, rows: DataFrame, by: Column) -> DataFrame:
    """docs less those whose value of by is in rows (_row)."""
    gone = stored(rows.select("_row").distinct(), "gone")
    kept = docs.withColumn("_row", by).join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "_row", "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    told = language_id.identify(language_id.document_evidence(docs.withColumn("doc_id", by_evidence())), model)
    return without(docs, told.filter(~F.col("kept")).select(F.col("key").alias("_row")), by_evidence())


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays."""
    groups = ngram_join.similar_documents(docs, n=5, least=Fraction(4, 5))
    copies = groups.filter("component_id <> doc_id OR (doc_id IS NULL AND component_id IS NOT NULL)")
    return without(docs, copies.select(F.xxhash64("doc_id", "text_hash").alias("_row")), by_text())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs.withColumn("doc_id", by_text()), table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("_row")), by_text())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("language_id", keep_known_languages), ("ngram_join", keep_one_of_each_group), ("decontaminate", drop_contaminated), ("packing", pack)]

#: Trained models and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
