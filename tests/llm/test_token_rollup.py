from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm._common import scratch
from tidemark.llm.token_rollup import Conflict, Rollup, counted, deletes, inserts, revisions

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, tokens string"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_deltas_and_replays(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(i, f"some words number {i} " * (i % 5), ["en", None, "de"][i % 3], ["a", "b", None][i % 2 or i % 3 and 2]) for i in range(60)] + [(99, None, "en", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    first = counted(df, PATH, "v1")
    rollup = Rollup(spark, scratch(spark, "rollup"))
    assert totals(rollup) == {}
    assert rollup.commit("b1", inserts(first)) and not rollup.commit("b1", inserts(first))

    def brute(rows, version):
        docs, tokens = Counter(), Counter()
        for _, text, lang, source in rows:
            docs[source, lang, version] += 1
            tokens[source, lang, version] += len(t.encode(text or "", add_special_tokens=False).ids)
        return {k: (docs[k], tokens[k]) for k in docs}

    assert totals(rollup) == brute(rows, "v1")
    gone = counted(df.filter("doc_id < 10"), PATH, "v1")
    assert rollup.commit("b2", deletes(gone))
    assert totals(rollup) == brute([r for r in rows if r[0] >= 10], "v1")
    left = counted(df.filter("doc_id >= 10"), PATH, "v1")
    assert rollup.commit("b3", revisions(left, counted(df.filter("doc_id >= 10"), PATH, "v2")))
    assert totals(rollup) == brute([r for r in rows if r[0] >= 10], "v2")
    assert rollup.commit("empty", inserts(first.limit(0)))
    assert rollup.committed() == ["b1", "b2", "b3", "empty"]
    with pytest.raises(ValueError):
        rollup.commit("../x", inserts(first))


def test_a_batch_that_broke_off_is_written_again(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", "x")], SCHEMA)
    path = scratch(spark, "rollup")
    rollup = Rollup(spark, path)
    inserts(counted(df, PATH, "v1")).write.parquet(f"{path}/batches/b1")  # no marker
    assert totals(rollup) == {}
    rollup.commit("b1", inserts(counted(df, PATH, "v1")))
    assert totals(rollup) == {("s", "en", "v1"): (1, 2)}


def test_other_deltas_under_a_used_id_fail(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", "x"), (2, "c", "de", "s", "x")], SCHEMA)
    path = scratch(spark, "rollup")
    rollup, other = Rollup(spark, path), Rollup(spark, path)
    all_of = inserts(counted(df, PATH, "v1"))
    assert rollup.commit("b1", all_of)
    with pytest.raises(Conflict):
        other.commit("b1", inserts(counted(df.filter("doc_id = 1"), PATH, "v1")))
    assert not other.commit("b1", all_of.orderBy("tokens"))
    assert totals(other) == {("s", "en", "v1"): (1, 2), ("s", "de", "v1"): (1, 1)}


def test_two_drivers_with_one_id(spark, monkeypatch):
    """Both see no batch and write; one mark is made, and the other's sums are gone."""
    df = spark.createDataFrame([(1, "a b", "en", "s", "x")], SCHEMA)
    rollup = Rollup(spark, scratch(spark, "rollup"))
    create, calls = Rollup._create, []

    def late(self, batch_id, said):
        if not calls:
            calls.append(1)
            assert Rollup(spark, rollup._path).commit(batch_id, inserts(counted(df, PATH, "v1")))
        return create(self, batch_id, said)

    monkeypatch.setattr(Rollup, "_create", late)
    assert not rollup.commit("b1", inserts(counted(df, PATH, "v1")))
    assert totals(rollup) == {("s", "en", "v1"): (1, 2)}


def test_compaction(spark):
    df = spark.createDataFrame([(k, "a b" * k, ["en", "de"][k % 2], "s", "x") for k in range(6)], SCHEMA)
    counts = counted(df, PATH, "v1")
    rollup = Rollup(spark, scratch(spark, "rollup"))
    assert rollup.compact() is None
    for k in range(6):
        rollup.commit(f"b{k}", inserts(counts.filter(F.col("doc_id") == k)))
    before = totals(rollup)
    name = rollup.compact()
    assert totals(rollup) == before and set(rollup._live()) == {name} and "b3" in rollup.committed()
    assert not rollup.commit("b3", inserts(counts.filter("doc_id = 3"))) and totals(rollup) == before
    rollup.commit("gone", deletes(counts.filter("lang = 'de'")))
    rollup.compact()
    assert totals(rollup) == {k: v for k, v in before.items() if k[1] == "en"}


def test_two_drivers_compact_at_once(spark, monkeypatch):
    """Both see the same batches; a third commits between; one generation is made, and nothing counts twice."""
    df = spark.createDataFrame([(k, "a b", "en", "s", "x") for k in range(4)], SCHEMA)
    counts = counted(df, PATH, "v1")
    rollup = Rollup(spark, scratch(spark, "rollup"))
    for k in range(2):
        rollup.commit(f"b{k}", inserts(counts.filter(F.col("doc_id") == k)))
    claim, made = Rollup._claim, []

    def late(self, name, said):
        if name.startswith("generations") and not made:
            made.append(None)
            other = Rollup(spark, rollup._path)
            assert other.commit("b2", inserts(counts.filter("doc_id = 2")))
            made[0] = other.compact()
            assert totals(other) == {("s", "en", "v1"): (3, 6)}
        return claim(self, name, said)

    monkeypatch.setattr(Rollup, "_claim", late)
    assert rollup.compact() is None and made == ["generation-1"]
    assert totals(rollup) == {("s", "en", "v1"): (3, 6)} and set(rollup._live()) == {"generation-1"}
    assert rollup.commit("b3", inserts(counts.filter("doc_id = 3"))) and not rollup.commit("b0", inserts(counts.filter("doc_id = 0")))
    assert rollup.compact() == "generation-2" and totals(rollup) == {("s", "en", "v1"): (4, 8)}
    assert rollup._names("done") == [] and rollup.committed() == ["b0", "b1", "b2", "b3"]


def test_a_batch_that_is_folded_while_it_is_delivered_again(spark, monkeypatch):
    df = spark.createDataFrame([(k, "a b", "en", "s", "x") for k in range(2)], SCHEMA)
    counts = counted(df, PATH, "v1")
    rollup = Rollup(spark, scratch(spark, "rollup"))
    create, made = Rollup._create, []

    def late(self, batch_id, said):
        if batch_id == "b0" and not made:
            made.append(1)
            other = Rollup(spark, rollup._path)
            assert other.commit("b0", inserts(counts.filter("doc_id = 0"))) and other.commit("b1", inserts(counts.filter("doc_id = 1")))
            assert other.compact() == "generation-1"
            out = create(self, batch_id, said)
            assert out and totals(other) == {("s", "en", "v1"): (2, 4)}  # its mark is there and counts for nothing
            return out
        return create(self, batch_id, said)

    monkeypatch.setattr(Rollup, "_create", late)
    assert not rollup.commit("b0", inserts(counts.filter("doc_id = 0")))
    assert totals(rollup) == {("s", "en", "v1"): (2, 4)}
    with pytest.raises(Conflict):
        rollup.commit("b0", inserts(counts))
    assert totals(rollup) == {("s", "en", "v1"): (2, 4)}


def test_old_data_go(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", "x")], SCHEMA)
    rollup = Rollup(spark, scratch(spark, "rollup"))
    counts = inserts(counted(df, PATH, "v1"))
    for k in range(6):
        rollup.commit(f"b{k}", counts)
        rollup.compact()
    assert totals(rollup) == {("s", "en", "v1"): (6, 12)}
    assert len(rollup._names("batches")) <= 3 and len(rollup._names("used")) <= 2 and rollup._names("done") == []


def test_null_tokens(spark):
    rollup = Rollup(spark, scratch(spark, "rollup"))
    rows = spark.createDataFrame([("s", "en", "v", None), ("s", "en", "v", 3)], "source string, lang string, tokenizer string, tokens long")
    assert rollup.commit("b", inserts(rows)) and totals(rollup) == {("s", "en", "v"): (2, 3)}
    assert rollup.commit("c", deletes(rows)) and totals(rollup) == {}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", "x", 7, 9)], SCHEMA + ", docs long, tokenizer long")
    rollup = Rollup(spark, scratch(spark, "rollup"))
    rollup.commit("b", inserts(counted(df, PATH, "v1")))
    assert totals(rollup) == {("s", "en", "v1"): (1, 2)}


def test_words_that_polynomials_confuse(spark):
    t = Tokenizer.from_file(PATH)
    one = "".join("ab"[k.bit_count() & 1] for k in range(4096))
    words = [w for size in (16, 2048, 4096) for w in (one[:size], one[:size].translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame([(k, w, "en", "s", "x") for k, w in enumerate(words)], SCHEMA).coalesce(1)
    assert {r.doc_id: r.tokens for r in counted(df, PATH, "v").collect()} == {k: len(t.encode(w, add_special_tokens=False).ids) for k, w in enumerate(words)}
