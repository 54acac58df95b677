"""What the operators of this package share: tables, the shared folder, and cutting of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager, suppress
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

#: Characters of text that Python code takes at once: bounds the memory of a batch, never the length of a text.
CHUNK_CHARS = 4_000_000
#: Short rows of a file, and files that a table may have whatever its size.
ROWS_A_FILE, LEAST_FILES = 250_000, 8
_SPARE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset and there is no cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        jvm = sc._jsc.sc().getCheckpointDir()
        if not jvm.isDefined() and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = jvm.get() if jvm.isDefined() else f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark/{kind}-{uuid.uuid4().hex}"

    def remove() -> None:
        with suppress(Exception):  # the session may have ended first; the folder is then the cluster's to clean
            _delete(spark, path)

    atexit.register(remove)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def _spare(spark: SparkSession) -> Iterator[None]:
    """For what runs inside: shuffle files go at its end, not when the driver next collects garbage, and Arrow batches are small, as texts may be long."""
    before = {k: spark.conf.get(k) for k in _SPARE}
    for k, v in _SPARE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, kind: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: later failures start from there.

    rows: about how many short rows df has at most, where that is known; they go to files of some size, not to one a partition.
    """
    spark = df.sparkSession
    path = scratch(spark, kind)
    with _spare(spark):
        out = df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))
        out.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Removes what ``stored`` wrote for df, which must not be read again."""
    _delete(df.sparkSession, df._stored_at)


def chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about limit characters; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def starts(sizes: Iterable[int]) -> list[int]:
    return list(accumulate(sizes, initial=0))
