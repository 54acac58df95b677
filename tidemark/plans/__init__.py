"""Queries of the engine on the driver's tables, by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import audit, files, records, scorers, texts, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**audit.QUERIES, **texts.QUERIES, **vectors.QUERIES, **files.QUERIES, **scorers.QUERIES, **records.QUERIES}
ORACLES: dict[str, str] = {**audit.ORACLES, **texts.ORACLES, **vectors.ORACLES, **files.ORACLES, **scorers.ORACLES, **records.ORACLES}
