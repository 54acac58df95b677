"""Token counts kept by signed deltas.

The state is a folder of batches.  A batch holds signed sums by (source, lang, tokenizer): an insert adds a document and
its tokens, a delete takes them away, a revised count does both.  The sums are additive, so totals are one grouped sum
over the batches.

A commit writes its sums to a folder of its own attempt, and then makes the batch count by renaming a file to the batch's id,
which names the attempt and the sums' fingerprint; a rename never replaces a file on the file systems that this is for.  So
of two drivers with one id one wins and nothing is overwritten; to commit the same deltas again, or to finish what broke off, has no further
effect; other deltas under a used id are an error.

``compact`` folds the batches that count into a numbered generation: the sums of all that it stands for, and a table of their
ids and fingerprints.  A generation counts by a rename to the number after its predecessor's, so of drivers that compact at once one
wins and the others drop their sums.  What counts is the last generation and the batches whose ids it does not hold, whether
their marks are still there or not; a reader lists marks before generations, so it misses none.  Marks of folded batches are
removed, so a driver reads those of batches since the last compaction; data of folded batches go one compaction later.

Defined cases: null source or language is a group of its own; null text or a null count has no tokens but is a document; repeated rows
count each; an empty batch commits; groups that reach zero documents and zero tokens leave the totals; other columns, also
such that are named like the keys or sums, are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import chunks
from tidemark.llm.word_ids import word_ids

KEYS = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def counted(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: the token count of each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = [len(x) // 4 for lo, hi in chunks(texts) for x in encoder.encode(texts[lo:hi])]
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(tokens, pa.int64())], names=["doc_id", "source", "lang", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, source string, lang string, tokens long").withColumn("tokenizer", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.coalesce(F.col("tokens"), F.lit(0))).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new: the documents concerned as counted before and now; a source, language or version may differ."""
    return deletes(old).unionByName(inserts(new))


class Conflict(ValueError):
    """Other deltas were committed under the id."""


class Rollup:
    """The totals kept under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def _file(self, path: str):  # noqa: ANN202  the JVM's file system and path
        p = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, kind: str) -> list[str]:
        fs, p = self._file(f"{self._path}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _marks(self) -> dict[str, dict]:
        """What the mark of each batch says that has one: batches since the last compaction, a small file each."""
        out = {}
        for name in self._names("done"):
            with suppress(Py4JJavaError):  # folded meanwhile
                out[name] = self._read(f"{self._path}/done/{name}")
        return out

    def _generation(self) -> tuple[int, dict]:
        """The last generation's number and what its file says; 0 and nothing before the first."""
        names = self._names("generations")
        return (int(names[-1]), self._read(f"{self._path}/generations/{names[-1]}")) if names else (0, {})

    def _used(self, generation: dict) -> DataFrame:
        """id, print of the batches that the generation stands for."""
        schema = "id string, print string"
        return self._spark.read.schema(schema).parquet(f"{self._path}/used/{generation['attempt']}") if generation else self._spark.createDataFrame([], schema)

    def _state(self) -> tuple[int, dict, dict[str, dict]]:
        """The last generation, and the marks of the batches that it does not stand for."""
        marks = self._marks()  # before the generation: what is folded in between is in it
        number, generation = self._generation()
        folded = {r.id for r in self._used(generation).filter(F.col("id").isin(*marks)).collect()} if marks and generation else set()
        return number, generation, {b: m for b, m in marks.items() if b not in folded}

    def _read(self, path: str) -> dict:
        fs, p = self._file(path)
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readNBytes(size)).decode() or "{}")
        finally:
            stream.close()

    def _create(self, batch_id: str, said: dict) -> bool:
        """Whether this call made the batch count. The mark is complete before it has its name."""
        return self._claim(f"done/{batch_id}", said)

    def _claim(self, name: str, said: dict) -> bool:
        fs, draft = self._file(f"{self._path}/drafts/{said['attempt']}")
        out = fs.create(draft, True)
        out.write(json.dumps(said).encode())
        out.close()
        _, mark = self._file(f"{self._path}/{name}")
        fs.mkdirs(mark.getParent())
        return not fs.exists(mark) and fs.rename(draft, mark)

    def _drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._file(f"{self._path}/{name}")
            fs.delete(p, True)

    def committed(self) -> list[str]:
        """All ids that were ever used, for inspection: as many as there were batches."""
        marks = self._marks()
        return sorted({*marks, *(r.id for r in self._used(self._generation()[1]).collect())})

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """False if the batch was there before with the same deltas; Conflict if it was with others."""
        if not batch_id or not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        attempt = uuid.uuid4().hex
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
        sums.write.parquet(f"{self._path}/batches/{attempt}")
        print_ = self._of([attempt]).agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*KEYS, "docs", "tokens").cast("decimal(38,0)")), F.lit(0))).first()
        said = {"attempt": attempt, "print": f"{print_[0]}:{print_[1]}"}
        made = self._create(batch_id, said)
        # a batch of this id may have been folded, and its mark removed, before this one got its name: then this one counts for nothing
        there = None if made else self._marks().get(batch_id, {}).get("print")
        there = self._folded_print(batch_id) or there
        if there is None:
            return made
        self._drop(f"batches/{attempt}", f"drafts/{attempt}", *([f"done/{batch_id}"] if made else []))
        if there != said["print"]:
            raise Conflict(f"batch {batch_id} was committed with other deltas")
        return False

    def _folded_print(self, batch_id: str) -> str | None:
        found = self._used(self._generation()[1]).filter(F.col("id") == batch_id).first()
        return found.print if found else None

    def _of(self, attempts: Iterable[str]) -> DataFrame:
        paths = [f"{self._path}/batches/{a}" for a in attempts]
        return self._spark.read.schema(_DELTA).parquet(*paths) if paths else self._spark.createDataFrame([], _DELTA)

    def _live(self) -> dict[str, dict]:
        """What counts, by name: the last generation and the batches since."""
        number, generation, marks = self._state()
        return ({f"generation-{number}": generation} if generation else {}) | marks

    def _sums(self, live: dict[str, dict]) -> DataFrame:
        sums = self._of(m["attempt"] for m in live.values()).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter((F.col("docs") != 0) | (F.col("tokens") != 0))

    def compact(self) -> str | None:
        """Folds the batches since the last generation into the next one, whose name this returns; None if there is nothing to fold or another driver was first."""
        number, generation, marks = self._state()
        if len(marks) + bool(generation) < 2:
            return None
        attempt = uuid.uuid4().hex
        self._sums(({"": generation} if generation else {}) | marks).write.parquet(f"{self._path}/batches/{attempt}")
        new = self._spark.createDataFrame([(b, m["print"]) for b, m in marks.items()], "id string, print string")
        self._used(generation).unionByName(new).coalesce(1).write.parquet(f"{self._path}/used/{attempt}")
        said = {"attempt": attempt, "folded": [m["attempt"] for m in marks.values()], "before": generation.get("attempt")}
        if not self._claim(f"generations/{number + 1:012d}", said):
            self._drop(f"batches/{attempt}", f"used/{attempt}", f"drafts/{attempt}")
            return None
        self._drop(*(f"done/{b}" for b in marks))
        # readers may still be at the predecessor, but not at what that one replaced
        if generation:
            self._drop(*(f"batches/{a}" for a in generation["folded"]))
            if generation["before"]:
                self._drop(f"batches/{generation['before']}", f"used/{generation['before']}")
        return f"generation-{number + 1}"

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens."""
        return self._sums(self._live())
