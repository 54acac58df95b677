import hashlib
import math
import zlib

from tidemark.llm import rendezvous
from tidemark.llm.rendezvous import rendezvous_shards

SCHEMA = "doc_id long, text string, shard string, slot int, size string"


def u(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def brute(key, weights):
    return max((-w / math.log((u(f"{key}:{s}") + 0.5) / 2**52), s) for s, w in weights.items())[1]


def test_placement_slots_and_growth(spark, monkeypatch):
    monkeypatch.setattr(rendezvous, "ROWS_A_BUCKET", 50)
    rows = [(i, "hot text" if i % 3 == 0 else f"tëxt {i}") for i in range(3000)] + [(None, "a"), (None, None), (5, "again"), (7, None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(6)
    for weights in (dict.fromkeys(range(8), 1.0), {0: 1.0, 1: 3.0, 2: 0.5}):
        grown = weights | {len(weights): 1.0}
        got = rendezvous.number(rendezvous.assign(df, weights, grown), rows_a_bucket=50).collect()
        assert len(got) == len(rows)
        slots = {}
        for r in got:
            key = "null" if r.doc_id is None else str(r.doc_id)
            assert r.shard == brute(key, weights) and r.grown_shard == brute(key, grown)
            assert r.grown_shard in (r.shard, len(weights))
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        share = {s: len(x) / len(rows) for s, x in slots.items()}
        assert all(abs(share[s] - w / sum(weights.values())) < 0.05 for s, w in weights.items())
    texts = sorted((t is not None, t or "") for _, t in rows)
    out = rendezvous_shards(df, dict.fromkeys(range(8), 1.0)).collect()
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in texts)
    assert {r.law for r in out} == {"key"} and {r.grown_shard for r in out} == {None}


def test_empty_table(spark):
    assert rendezvous_shards(spark.createDataFrame([], SCHEMA), {0: 1.0, 1: 1.0}).collect() == []


def test_rows_that_are_alike_have_slots_of_their_own(spark):
    rows = [(7, "same text")] * 500 + [(None, "no id")] * 400 + [(None, "other")] * 3 + [(i, f"t{i}") for i in range(100)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, slot string, _n int").repartition(5)
    got = rendezvous.rendezvous_shards(df, {s: 1.0 + s for s in range(3)}).collect()
    assert len(got) == len(rows)
    for shard in range(3):
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_one_id_with_a_third_of_the_rows(spark):
    """Its texts differ; they share a shard and are numbered in many ranges."""
    rows = [(7, f"text {i}") for i in range(1000)] + [(None, f"no id {i}") for i in range(500)] + [(i, "x") for i in range(100, 1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weights = dict.fromkeys(range(4), 1.0)
    got = rendezvous.number(rendezvous.assign(df, weights), rows_a_bucket=100).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.doc_id == 7}) == 1
    for s in range(4):
        mine = sorted((r.slot, r.doc_id, r.text_crc32) for r in got if r.shard == s)
        assert [m[0] for m in mine] == list(range(len(mine)))
    hot = sorted((r.slot, r.text_crc32) for r in got if r.doc_id == 7)
    assert [c for _, c in hot] == sorted(c for _, c in hot) and hot[-1][0] - hot[0][0] == 999
