"""Running sums over an order of all rows, and copies of counted rows, without a task that holds a group whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stored
from tidemark.operators import tables

#: Rows of a range, and copies that one array makes.
ROWS_A_RANGE, COPIES = 200_000, 4_096


def sums_before(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, str], rows_a_range: int | None = None) -> DataFrame:
    """As ``tables.sums_before``, by way of this package's tables."""
    return tables.sums_before(rows, by, order, sums, rows_a_range or ROWS_A_RANGE, stored)


def copies(rows: DataFrame, count: str, index: str) -> DataFrame:
    """Each row count times, index telling the copies from 0; the copies of one row are made in blocks, by many tasks."""
    upto = lambda first, n: F.explode(F.sequence(first, n - 1))
    few = rows.filter(F.col(count).between(1, COPIES)).withColumn(index, upto(F.lit(0).cast("long"), F.col(count)))
    many = rows.filter(F.col(count) > COPIES).withColumn("_block", upto(F.lit(0).cast("long"), F.ceil(F.col(count) / COPIES)))
    many = many.repartition("_block").withColumn(index, upto(F.col("_block") * COPIES, F.least(F.col(count), (F.col("_block") + 1) * COPIES)))
    return few.unionByName(many.drop("_block"))
