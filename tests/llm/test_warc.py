import base64
import hashlib
from collections import defaultdict

import pytest
import zstandard

from tidemark.llm import warc
from tidemark.llm._common import scratch

SCHEMA = "page_id long, url string, html string, sha1 string, size int"


def brute(rows, least=0):
    same = defaultdict(list)
    for i, _, h in rows:
        same[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max((x for x in same[data] if x is not None), default=None)
        revisit = len(same[data]) > 1 and len(data) >= least and top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}\r\nX: y", f"<p>page {i}</p>" * (i % 40)) for i in range(300)] + [(1000 + i, None, "<b>hot</b>\r\n\r\nWARC/1.1\r\n") for i in range(150)] + [(None, None, None), (None, "u", "<b>hot</b>\r\n\r\nWARC/1.1\r\n"), (2000, "ü", "é" * 300_000), (5, "again", "<p>page 5</p>" * 5)]


@pytest.mark.parametrize("least", [0, 400])
def test_round_trip(spark, least, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA).repartition(3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    got = warc.archive_and_read(df, least).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS, least)


def test_format_of_an_archive(spark):
    df = spark.createDataFrame([(i, "http://h/", f"<p>some common text of page {i}</p>" * 400, "x", 1) for i in range(200)], SCHEMA).coalesce(1)
    folder = scratch(spark, "warc-test")
    (row,) = warc.write_archives(df, folder).collect()
    data = open(row.path, "rb").read()
    assert len(data) == row.bytes and row.records == 200
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_MAGIC
    n = int.from_bytes(data[4:8], "little")
    d = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    frames, at = 0, 8 + n
    while at < len(data):  # each record is a frame of its own
        o = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        assert o.decompress(data[at:]).startswith(b"WARC/1.1\r\n")
        at = len(data) - len(o.unused_data)
        frames += 1
    assert frames == 201


def test_a_record_is_read_at_its_offset(spark):
    """With zstandard alone: the dictionary from the first frame, and a record's frame by its place in the file."""
    df = spark.createDataFrame([(i, "http://h/", f"<p>some common text of page {i}</p>" * 400, "x", 1) for i in range(200)], SCHEMA).coalesce(1)
    (row,) = warc.write_archives(df, scratch(spark, "warc-test")).collect()
    with open(row.path, "rb") as f:
        magic, n = (int.from_bytes(f.read(4), "little") for _ in range(2))
        assert magic == warc.SKIPPABLE_MAGIC
        dictionary = zstandard.ZstdCompressionDict(f.read(n))
        data = f.read()
    places, at = [], 0
    while at < len(data):
        places.append(at)
        o = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        o.decompress(data[at:])
        at = len(data) - len(o.unused_data)
    with open(row.path, "rb") as f:
        f.seek(8 + n + places[151])
        found = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(f.read())
    assert b"<urn:page:150>" in found and found.count(b"WARC/1.1") == 1
    assert row.bytes < sum(400 * len(f"<p>some common text of page {i}</p>") for i in range(200)) / 20


def test_very_long_payloads_in_one_batch(spark):
    rows = [(i, "http://h/", f"{i} " * 300_000 if i % 7 == 0 else "short", "x", 1) for i in range(40)]
    got = warc.archive_and_read(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:3] for r in rows])


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("most", [warc.BROADCAST_REPEATS, 0])
def test_one_payload_in_a_third_of_the_pages(spark, tmp_path, monkeypatch, most):
    """By broadcast and by places dealt: one response, the largest id, and the others name it."""
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", most)
    rows = [(i, f"http://x/{i}", "the same page" if i % 3 == 0 else f"page {i // 2}") for i in range(600)] + [(None, None, "the same page"), (900, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in warc.archive_and_read(df).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    for i, _, html in rows:
        want = None if i == last[html or ""] else last[html or ""]
        assert (got[i].refers_to, got[i].record_type) == (want, "response" if want is None else "revisit")
