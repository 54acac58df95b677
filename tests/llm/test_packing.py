import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.packing import fill, pack_documents
from tidemark.llm.word_ids import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, offset string"


def test_ids_equal_the_tokenizer():
    t, own = Tokenizer.from_file(PATH), WordIds(PATH, slots=1 << 8, ids_kept=500)
    rng = random.Random(3)
    texts = ["don't 'save ''s it's \"'s x'll'd 12'3 it's5 a'b 'R", "é«x» İstanbul ΑΣ ﬁ", "<|endoftext|> hi <|", "", "  ", "A B", "a\x1cb\x85c", "ǅ ŉ 'ŉ ÿ’s", "x'", "'", "e\u0301", "中文 mixed ñ", "𝔘nicode"]
    texts += ["".join(rng.choice("abc'ST \n,.0129éÀß-*\"dlmrve") for _ in range(rng.randrange(80))) for _ in range(3000)]
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == t.encode(text, add_special_tokens=False).ids


def test_fill_uses_everything_and_never_too_much():
    rng = random.Random(1)
    for _ in range(30):
        counts = {n: rng.randrange(1, 5) for n in rng.sample(range(1, 65), rng.randrange(1, 20))}
        used = defaultdict(int)
        for chosen, times in fill(counts, 64):
            assert times > 0 and sum(n * c for n, c in chosen.items()) <= 64
            for n, c in chosen.items():
                used[n] += c * times
        assert used == counts
    # a perfect fill is found where one exists
    assert sum(times for _, times in fill({40: 3, 24: 3, 13: 2, 51: 2}, 64)) == 5


def check(rows, got, capacity):
    t = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    total = 0
    for of in by_sequence.values():
        at = 0
        for r in sorted(of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
    return total / (capacity * len(by_sequence))


def test_packing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "the", "x!", "Überall"]) for _ in range(rng.randrange(1, 400)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "long " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    assert check(rows, pack_documents(df, PATH).collect(), 4096) > 0.97
    monkeypatch.setattr(packing, "DOCS_A_GROUP", 100)
    assert check(rows, packing.pack(packing.cut(df, PATH, 2, 512), 512, docs_a_group=100).collect(), 512) > 0.95


def test_ids_that_repeat_or_lack(spark):
    df = spark.createDataFrame([(None, "a b", 1, "x"), (3, "c", 1, "x"), (3, "c", 1, "x")], SCHEMA)
    got = pack_documents(df, PATH).collect()
    assert sorted(r.doc_tokens for r in got) == [2, 2, 3] and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def opposite_words():
    """Two words of one length each, alike under any polynomial modulo a power of two."""
    for size in (16, 2048, 4096):
        one = "".join("ab"[k.bit_count() & 1] for k in range(size))
        yield one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(2 * k + j, w, "x") for k, pair in enumerate(opposite_words()) for j, w in enumerate(pair)]
    found = packing.cut(spark.createDataFrame(rows, "doc_id long, text string, start string").coalesce(1), PATH).collect()
    for i, w, _ in rows:
        ids = [*t.encode(w, add_special_tokens=False).ids, 2]
        own = sorted((p for p in found if p.doc_id == i), key=lambda p: p.start)
        assert [(p.length, p.ids_crc32, p.doc_tokens) for p in own] == [(len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x)), len(ids)) for x in (ids[k : k + 4096] for k in range(0, len(ids), 4096))]


def test_pieces_that_are_alike_lie_in_many_groups(spark):
    rows = [(None, "the same words", 1, "x")] * 400 + [(5, "the same words", 1, "x")] * 400
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = packing.pack(packing.cut(df, PATH, 2, 64), 64, docs_a_group=100).collect()
    assert len(got) == 800 and len({r.sequence_id >> 32 for r in got}) == 8
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 64
