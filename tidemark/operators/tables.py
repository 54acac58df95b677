"""Tables between steps, in the folder that driver and executors share; running sums over an order of all rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range, and the fewest ranges.
ROWS_A_RANGE, LEAST_RANGES = 200_000, 8
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the folder that driver and executors share, removed when the driver ends; a local one only where no cluster runs and none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidemark/{kind}-{uuid.uuid4().hex}"

    def remove() -> None:
        with suppress(Exception):  # the session may have ended first; the folder is then the cluster's to clean
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return path


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: what follows starts there, also after failures."""
    spark = df.sparkSession
    path, before = scratch(spark, kind), spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")  # shuffle files go when the table stands, not when the driver next collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def sums_before(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, str], rows_a_range: int = ROWS_A_RANGE, store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Adds, for each name and column of sums, the column's sum over the rows of the same by that stand before this row in order.

    rows: a stored table, as it is read more than once; order must tell rows of one by apart, and by must not be null.  Ranges of
    (by, order) are written; sums run inside each range and are moved by the sums of the ranges before, so no task holds a group.
    """
    ranges = max(LEAST_RANGES, -(-rows.count() // rows_a_range))
    cut = store(rows.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of_range = cut.groupBy("_range", *by).agg(*(F.sum(c).alias(f"_of_{n}") for n, c in sums.items()))
    of_range = of_range.select("_range", *by, *(F.coalesce(F.sum(f"_of_{n}").over(ahead), F.lit(0)).alias(f"_ahead_{n}") for n in sums))
    run = cut.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(of_range, ["_range", *by])
    return run.select(*rows.columns, *((F.col(n) + F.col(f"_ahead_{n}")).alias(n) for n in sums))
