import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import committed, ranges, readers


@pytest.mark.parametrize(("size", "block"), [(7, 5), (64, 11), (1001, 1_000_000), (10**9, 64)])
def test_paragraphs_wherever_ranges_end(size, block, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", block)
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice(("a", "bé", " ", "\n", "\n\n", "\n \n", "\t\n\r\n", "word ")) for _ in range(rng.randint(0, 120))).encode()
        file = pa_file(text)
        got = sorted(p for at in range(0, len(text), size) for p in ranges.paragraphs(file, at, min(at + size, len(text))))
        assert [re.sub(rb"\s+", b" ", p).strip() for _, p in got if p.strip()] == [re.sub(rb"\s+", b" ", p).strip() for p in re.split(rb"\n\s*\n", text) if p.strip()]
        assert all(text[at : at + len(p)] == p for at, p in got)
        whole = [ranges.lines(file, at, min(at + size, len(text))) for at in range(0, len(text), size)]
        assert b"".join(t for _, t in whole) == text and all(not t or t.endswith(b"\n") or at + len(t) == len(text) for at, t in whole)


def pa_file(data):
    import pyarrow as pa

    return pa.BufferReader(data)


def test_one_file_in_many_partitions(spark, tmp_path):
    parts = [f"paragraph {i} é\nits second line" for i in range(5000)]
    path = f"file://{tmp_path}/big.txt"
    (tmp_path / "big.txt").write_text("\n\n".join(parts))
    df = ranges.read(spark, ranges.TextRanges, path, bytes=4096)
    assert df.rdd.getNumPartitions() > 30 and sorted(r.text for r in df.collect()) == sorted(parts)
    chunks = ranges.read(spark, ranges.TextRanges, path, unit="lines", bytes=4096).orderBy("start").collect()
    assert "".join(c.text for c in chunks) == "\n\n".join(parts) and len(chunks) > 30
    docs = readers.background(spark, path)
    assert docs.count() == 5000 == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("values", [np.arange(3000, dtype=np.float32).reshape(1000, 3), np.asfortranarray(np.arange(60.0).reshape(20, 3)), np.arange(7), np.zeros((0, 4)), np.arange(24, dtype=np.int16).reshape(2, 3, 4)])
def test_rows_of_arrays(spark, tmp_path, values):
    out = io.BytesIO()
    np.save(out, values)
    (tmp_path / "a.npy").write_bytes(out.getvalue())
    df = ranges.read(spark, ranges.ArrayRanges, f"file://{tmp_path}", bytes=600)
    want = np.atleast_2d(values) if values.ndim < 3 else values.reshape(len(values), -1)
    got = sorted((r.row, r.vector) for r in df.collect())
    assert got == [(i, [float(x) for x in v]) for i, v in enumerate(want)]
    if len(values) == 1000:
        assert df.rdd.getNumPartitions() == 20


def test_increments_are_seen_when_they_are_whole(spark, tmp_path):
    path, schema = f"file://{tmp_path}/out", "id long, said string"
    rows = spark.range(100).select("id", F.concat(F.lit("é\n"), "id").alias("said")).repartition(4)
    assert committed.read(spark, path, schema).collect() == []
    committed.append(rows.filter("id < 50"), path, "first", source="a")
    broken = rows.filter("id >= 50").withColumn("said", F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("said")))
    with pytest.raises(Exception, match="no"):
        committed.append(broken, path, "second")
    assert {r.id for r in committed.read(spark, path, schema).collect()} == set(range(50))
    committed.append(rows.filter("id < 50"), path, "first", source="a")  # delivered again
    left = rows.join(committed.read(spark, path, schema).select("id"), "id", "left_anti")
    committed.append(left, path, "second")
    got = committed.read(spark, path, schema).collect()
    assert sorted((r.id, r.said) for r in got) == [(i, f"é\n{i}") for i in range(100)]
    told = {r.commit: (r.rows, r.source) for r in committed.manifests(spark, path).collect()}
    assert told == {"first": (50, "a"), "second": (50, None)}
    committed.append(rows.limit(0), path, "none")
    assert committed.read(spark, path, schema).count() == 100
    with pytest.raises(Exception, match="append"):
        rows.write.format("committed_lines").mode("overwrite").options(path=path).save()
