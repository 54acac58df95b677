"""An unbounded scan of documents into a training and a validation pool, until both budgets are filled.

Documents that are short or were seen (by exact key or by signature) are dropped.  What was seen is state in the query's
checkpoint, in a RocksDB store, so on the executors' disks and not in their heaps: one key a distinct document for ever, or, bounded, those
of an event-time watermark.  Each micro-batch adds its documents, dealt by a
hash of their id, and its token counts under the batch's number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import collapse_space, match_key, signature, token_count
from tidemark.operators.sampling import running


#: How state is kept while a query runs: on disk, with what changed written at each commit.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def fresh(docs: DataFrame, least_tokens: int = 40, near: bool = True, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream (or table) of documents (doc_id, text, …) with tokens, less short and repeated ones.

    Equal keys have equal signatures, so one state of signatures serves both tests.  Without an event time the state is one
    key a distinct document, as the whole stream is to be free of copies; with one, copies further apart than delay may stay.
    """
    rows = docs.withColumn("text", collapse_space(F.col("text"))).withColumn("tokens", token_count(F.col("text"))).filter(F.col("tokens") >= least_tokens)
    rows = rows.withColumn("_key", signature(F.col("text")) if near else F.sha2(match_key(F.col("text")), 256))
    if event_time:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return rows.dropDuplicates(["_key"]).drop("_key")


def state_sizes(query: StreamingQuery) -> list[dict[str, int]]:
    """Batch, keys and bytes of the state after each of the last batches."""
    return [
        {"batch": p["batchId"], "keys": sum(o["numRowsTotal"] for o in p["stateOperators"]), "bytes": sum(o["memoryUsedBytes"] for o in p["stateOperators"])} for p in query.recentProgress
    ]


def side(fraction: float, seed: int):  # noqa: ANN201  a column
    """validation for a fraction of the ids, else train."""
    return F.when(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000), "validation").otherwise("train")


def filled(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int]:
    """Tokens of each split in the pools, of all batches or of those before a number: a sum over two rows a batch."""
    try:
        rows = spark.read.parquet(f"{path}/tally")
    except AnalysisException:  # nothing is written yet
        return {}
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return {r.split: int(r.n) for r in rows.groupBy("split").agg(F.sum("tokens").alias("n")).collect()}


def collect_pools(docs: DataFrame, path: str, train_tokens: int, validation_tokens: int, seed: int = 1, available_now: bool = True, **options: object) -> StreamingQuery:
    """Starts the query that fills path/pools (Parquet by batch and split). Batches beyond the budgets add nothing; see ``until_filled``.

    Every batch is run to its end, also one that adds nothing, so that the state of the documents seen is committed.  
    """
    fraction = validation_tokens / max(1, train_tokens + validation_tokens)
    wanted = {"train": train_tokens, "validation": validation_tokens}

    def take(batch: DataFrame, number: int) -> None:
        have = filled(batch.sparkSession, path, number)
        rest = {s: max(n - have.get(s, 0), 0) for s, n in wanted.items()}
        open_sides = [s for s, n in rest.items() if n]
        held = batch.persist()
        try:
            held.count()
            # once one side is full, all goes to the other
            split = F.lit(open_sides[0]) if len(open_sides) == 1 else side(fraction, seed)
            rows = running(held.withColumn("split", split), "doc_id", seed, F.col("tokens"), by=["split"])
            left = F.when(F.col("split") == "train", rest["train"]).otherwise(rest["validation"])
            chosen = rows.filter(F.col("before") < left).drop("before").withColumn("batch", F.lit(number))
            for table, by in ((chosen, ["batch", "split"]), (chosen.groupBy("batch", "split").agg(F.sum("tokens").alias("tokens")), ["batch"])):
                table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{'pools' if len(by) == 2 else 'tally'}")
        finally:
            held.unpersist()

    spark = docs.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        writer = fresh(docs, **options).writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:  # the query has a copy
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def until_filled(query: StreamingQuery, spark: SparkSession, path: str, train_tokens: int, validation_tokens: int, poll: float = 1.0) -> dict[str, int]:
    """Waits until the query ends or both budgets are filled, then stops it; returns the tokens taken."""
    while True:
        ended = query.awaitTermination(poll)
        have = filled(spark, path)
        if ended or (have.get("train", 0) >= train_tokens and have.get("validation", 0) >= validation_tokens):
            query.stop()
            return have


def bundle(sources: list[DataFrame], limit: int | None = None, **options: object) -> DataFrame:
    """Documents of several sources (doc_id, text), the first of each signature by source and id, at most limit."""
    out = None
    for k, df in enumerate(sources):
        part = df.select("doc_id", "text").withColumn("source_rank", F.lit(k))
        out = part if out is None else out.unionByName(part)
    rows = out.withColumn("text", collapse_space(F.col("text"))).withColumn("tokens", token_count(F.col("text"))).filter(F.col("tokens") >= options.get("least_tokens", 40))
    firsts = rows.withColumn("_key", signature(F.col("text"))).groupBy("_key").agg(F.min(F.struct("source_rank", "doc_id", "text", "tokens")).alias("_r")).select("_r.*")
    return firsts.orderBy("source_rank", "doc_id").limit(limit) if limit else firsts
