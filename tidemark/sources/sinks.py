"""Sinks: JSON lines, CSV, text, archives, reports, corpora, vectors."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rollups import collapse_ratio


def json_lines(df: DataFrame, path: str, append: bool = False, compression: str | None = None) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    (writer.option("compression", compression) if compression else writer).json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def text(df: DataFrame, path: str, column: str = "text") -> None:
    """Documents with an empty line after each."""
    df.select(F.concat(F.col(column), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def put(spark: SparkSession, path: str, content: str) -> None:
    """A small file from the driver, by the file system of its path."""
    _put_bytes(spark, path, content.encode())


def _put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def document(spark: SparkSession, path: str, value: Any) -> None:
    """JSON (indented by two, newline at the end), or YAML by the path's ending."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        put(spark, path, yaml.safe_dump(value, sort_keys=False))
    else:
        put(spark, path, json.dumps(value, indent=2) + "\n")


def archive(scores: Sequence[DataFrame], labels: Sequence[Mapping[str, str]], path: str) -> int:
    """All score tables in one gzip archive with their labels as columns; returns the rows."""
    out = None
    for df, named in zip(scores, labels, strict=True):
        part = df.withColumns({k: F.lit(v) for k, v in named.items()})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return 0
    json_lines(out, path, compression="gzip")
    return out.sparkSession.read.json(path).count()


def corpus(docs: DataFrame, path: str, manifest: Mapping[str, Any]) -> dict[str, Any]:
    """Documents (split, position, text) by split in order, and a manifest with counts and a digest of each split.

    The digest is that of the ordered digests of the documents: it needs no file of the whole corpus.
    """
    spark = docs.sparkSession
    docs.repartitionByRange("split", "position").sortWithinPartitions("split", "position").write.mode("overwrite").partitionBy("split").parquet(f"{path}/documents")
    sums = docs.groupBy("split").agg(F.count("*").alias("documents"), F.bit_xor(F.xxhash64("position", F.sha2("text", 256))).alias("digest"))
    told = {r.split: {"documents": r.documents, "digest": f"{r.digest & (1 << 64) - 1:016x}"} for r in sums.collect()}
    out = {**manifest, "splits": told}
    document(spark, f"{path}/manifest.json", out)
    return out


def vectors(df: DataFrame, path: str, dtype: str = "float") -> None:
    """Long rows of vectors as Parquet; half precision is stored as float."""
    kind = {"float16": "float", "float32": "float"}.get(dtype, dtype)
    df.withColumn("vector", F.col("vector").cast(f"array<{kind}>")).write.mode("overwrite").partitionBy("layer").parquet(path)


def array_files(df: DataFrame, path: str, key: str = "layer", order: str = "example", dtype: str = "float32") -> DataFrame:
    """Vectors (key, order, vector) as one .npy file a value of key, in the given order; returns key, path, rows.

    A task holds one key's vectors: keys are layers or such.  Files have names of their attempt, and those that this returns count.
    """
    from pyarrow import fs

    kind = df.schema[key].dataType.simpleString()

    def write(group: pd.DataFrame) -> pd.DataFrame:
        files, base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        files.create_dir(base)
        group = group.sort_values(order)
        out = io.BytesIO()
        np.save(out, np.array(group.vector.tolist(), dtype))
        name = f"{base}/{key}_{group[key].iloc[0]}-{uuid.uuid4().hex}.npy"
        with files.open_output_stream(name) as stream:
            stream.write(out.getvalue())
        return pd.DataFrame([(group[key].iloc[0], name, len(group))], columns=[key, "path", "rows"])

    return df.select(key, order, F.col("vector").cast("array<double>").alias("vector")).groupBy(key).applyInPandas(write, f"`{key}` {kind}, path string, rows long")


def bundle(spark: SparkSession, files: Mapping[str, str], path: str) -> list[str]:
    """A tar.gz of small named texts (reports, manifests), written by the driver; returns the names in order."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name in sorted(files):
            data = files[name].encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    _put_bytes(spark, path, out.getvalue())
    return sorted(files)


def stub(spark: SparkSession, path: str, reason: str) -> None:
    """A file that says that an artifact is not there, and why."""
    document(spark, path, {"status": "missing", "reason": reason})


def revision_table(rows: DataFrame, path: str, order: str = "row_order") -> None:
    """Report rows with their ratio to the untransformed ones, as JSON lines and CSV."""
    out = collapse_ratio(rows, order=order)
    json_lines(out, f"{path}/rows_jsonl")
    csv(out, f"{path}/rows_csv")


def markdown(title: str, tables: Mapping[str, DataFrame], notes: Sequence[str] = ()) -> str:
    """A report of small tables, numbers with four digits."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"# {title}", ""]
    for name, df in tables.items():
        lines += [f"## {name}", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(map(show, r)) + " |" for r in df.toLocalIterator()]
        lines.append("")
    return "\n".join([*lines, *(f"- {n}" for n in notes)]) + "\n"


def latex(df: DataFrame, caption: str) -> str:
    """A table of a small DataFrame: intervals (name_low, name_high) go into the cell of name."""
    bare = [c for c in df.columns if not c.endswith(("_low", "_high"))]
    escape = lambda s: str(s).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")

    def cell(r: Any, c: str) -> str:
        v = f"{r[c]:.4f}" if isinstance(r[c], float) else escape(r[c])
        return f"{v} [{r[c + '_low']:.4f}, {r[c + '_high']:.4f}]" if f"{c}_low" in df.columns else v

    body = [" & ".join(cell(r, c) for c in bare) + r" \\" for r in df.toLocalIterator()]
    return "\n".join([r"\begin{table}", rf"\caption{{{escape(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(bare)}}}", " & ".join(map(escape, bare)) + r" \\ \hline", *body, r"\end{tabular}", r"\end{table}", ""])
