"""JSON lines that are written by increments and seen only once all of one are there.

A task writes a file of its own and tells its name and rows; the commit lists the files of all tasks in a manifest, which gets
its name by a move.  Readers go by manifests, so files of tasks that failed, ran twice or belong to a job that broke off are never
read.  A commit's id counts once: to write an increment again under its id changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.sources.ranges import opened


class Written(WriterCommitMessage):
    def __init__(self, name: str, rows: int) -> None:
        self.name, self.rows = name, rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self._path, self._id, self._sums = options["path"].rstrip("/"), options.get("commit") or uuid.uuid4().hex, json.loads(options.get("says", "{}"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = opened(f"{self._path}/data")
        files.create_dir(base, recursive=True)
        name, rows, out = f"{uuid.uuid4().hex}.jsonl", 0, None
        try:
            for batch in batches:
                out = out or files.open_output_stream(f"{base}/{name}")
                out.write("".join(json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False, default=str) + "\n" for r in batch.to_pylist()).encode("utf-8", "replace"))
                rows += batch.num_rows
        finally:
            if out:
                out.close()
        return Written(name if out else "", rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = opened(f"{self._path}/commits")
        files.create_dir(base, recursive=True)
        mine = [m for m in messages if m is not None and m.name]
        if files.get_file_info(f"{base}/{self._id}.json").type != fs.FileType.NotFound:
            return self.abort(messages)
        draft = f"{base}/_{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({**self._sums, "rows": sum(m.rows for m in mine), "files": [m.name for m in mine]}).encode())
        files.move(draft, f"{base}/{self._id}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = opened(f"{self._path}/data")
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{base}/{m.name}")


class CommittedLines(DataSource):
    """Options: path; commit, the increment's id; says, a JSON mapping that its manifest carries."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("increments are only appended")
        return _Writer(dict(self.options))


def append(rows: DataFrame, path: str, commit: str | None = None, **says: object) -> None:
    """Writes rows as the increment commit (a new one without it)."""
    rows.sparkSession.dataSource.register(CommittedLines)
    options = {"path": path, "says": json.dumps(says), **({"commit": commit} if commit else {})}
    rows.write.format(CommittedLines.name()).mode("append").options(**options).save()


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """commit, files, rows and what else was said, of each increment; empty before the first."""
    from tidemark.sources.readers import exists

    if not exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], "commit string, rows long, files array<string>")
    found = spark.read.option("pathGlobFilter", "[!_]*.json").json(f"{path}/commits")
    return found.withColumn("commit", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)) if found.columns else spark.createDataFrame([], "commit string, rows long, files array<string>")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all increments that are committed: of the files that manifests list, as they are now."""
    base = spark.read.schema("rows long, files array<string>").json(f"{path}/commits") if manifests(spark, path).limit(1).count() else None
    names = [r.f for r in base.select(F.explode("files").alias("f")).distinct().collect()] if base is not None else []  # a name a task
    return spark.read.schema(schema).json([f"{path}/data/{n}" for n in names]) if names else spark.createDataFrame([], schema)
