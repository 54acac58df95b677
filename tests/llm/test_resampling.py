import hashlib
import math
import re
import zlib
from collections import Counter

from tidemark.llm import ordered, resampling

SCHEMA = "doc_id long, text string, score string, rank int, _key int, b1 int"


def grams(text, orders):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, orders, buckets, seed, percent, least):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for text in texts for f in grams(text, orders)[1]) for texts in ([r[1] for r in rows], target))
    up, down = sum(t.values()) + buckets, sum(s.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * down / ((s[b] + 1) * up)))
    out = []
    for i, text in rows:
        words, f = grams(text, orders)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = percent * len(able) // 100
    ranked = [(*r[:4], k if k <= drawn else None) for k, r in enumerate(able, 1)] + [(*r[:4], None) for r in out if not r[4]]
    return sorted(ranked, key=str)


def test_like_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(ordered, "COPIES", 7)
    base = ["The Quick brown fox's den, 42 naïve ÀÉ words; the quick", "", None, "   ", "one", "ÄB cd-ef " * 400, "pack my box with five dozen liquor jugs " * 3]
    rows = [(i, base[i % len(base)]) for i in range(60)] + [(None, base[0]), (None, None), (3, base[6])] + [(77, base[6])] * 20
    target = ["pack my box with jugs", None, "", "Five dozen liquor"]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    for orders, buckets in ((2, 50), (3, 10_000), (1, 7)):
        got = resampling.resample(docs, bench, percent=25, least_words=5, orders=orders, buckets=buckets, seed=9).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, target, orders, buckets, 9, 25, 5)


def test_no_documents_or_no_target(spark):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, bench).collect() == []
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert [r.n_features for r in resampling.resample(one, bench.limit(0), percent=100).collect()] == [79]


def test_copies_of_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "COPIES", 5)
    got = ordered.copies(spark.createDataFrame([("a", 0), ("b", 1), ("c", 5), ("d", 23)], "k string, n long"), "n", "i").collect()
    assert sorted((r.k, r.i) for r in got) == [(k, i) for k, n in (("b", 1), ("c", 5), ("d", 23)) for i in range(n)]


def test_sums_before_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", 10)
    rows = [(g, i, (i * 7919 + g) % 31) for g in (1, 2, 3) for i in range(300 if g == 2 else 9)]
    got = ordered.sums_before(spark.createDataFrame(rows, "g int, i int, v long"), ["g"], [resampling.F.col("i").desc()], {"s": "v"}).collect()
    assert len(got) == len(rows) and all(r.s == sum(v for g, i, v in rows if g == r.g and i > r.i) for r in got)
