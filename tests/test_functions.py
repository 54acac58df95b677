import math
import random
from difflib import SequenceMatcher
from math import comb

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats, text
from tidemark.functions.pii import candidates
from tidemark.operators import sampling
from tidemark.operators.cues import band, leakage


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("given", "want"), [("  A\t b\n\nC ", "a b c"), ("", ""), ("x", "x"), ("\x0b\f\r", "")])
def test_normalize(spark, given, want):
    assert one(spark, text.normalize_text(F.lit(given))) == want


def test_unicode_white_space(spark):
    assert one(spark, text.normalize_text(F.lit("A  B\x1cC"), unicode=True)) == "a b c"
    assert one(spark, text.normalize_text(F.lit("A B"))) == "a b"


def test_ngrams_and_jaccard(spark):
    assert one(spark, text.char_ngrams(F.lit("abcab"), 3)) == ["abc", "bca", "cab"]
    assert one(spark, text.char_ngrams(F.lit("ab"), 3)) == ["ab"]
    assert one(spark, text.char_ngrams(F.lit(" "), 3)) == []
    e = F.array().cast("array<string>")
    assert one(spark, text.jaccard(e, e)) == 0.0
    assert one(spark, text.jaccard(text.tokens(F.lit("a b b c")), text.tokens(F.lit("b c d")))) == 0.5


def test_longest_pieces(spark):
    values = F.array(F.lit("zzz"), F.lit("Hello World"), F.lit(""))
    assert one(spark, text.longest_shared_piece(F.lit("say HELLO  wor"), values)) == 9
    assert one(spark, text.longest_shared_piece(F.lit("qq"), F.array(F.lit("x")))) == 0
    rng = random.Random(1)
    pairs = [("".join(rng.choices("ab c", k=rng.randrange(30))), "".join(rng.choices("ab c", k=rng.randrange(1, 30)))) for _ in range(50)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.longest_common_substring("a", "b").alias("lcs"), text.block_ratio("a", "b").alias("ratio")).collect()
    for r in got:
        longest = max((k for k in range(len(r.b) + 1) for i in range(len(r.b) - k + 1) if r.b[i : i + k] in r.a), default=0)
        assert r.lcs == longest / len(r.b) and r.ratio == SequenceMatcher(None, r.a, r.b).ratio()


@pytest.mark.parametrize(("given", "want"), [("2026-1-5", "2026-01-05"), ("2026/01/05", "2026-01-05"), ("5.1.2026", "2026-01-05"), ("January 5, 2026", "2026-01-05"), ("2026-01-05T9:05", "2026-01-05T09:05"), ("2026-01-05 09:05", "2026-01-05T09:05"), (" No Date ", "no date"), ("2026-13-01", "2026-13-01")])
def test_dates(spark, given, want):
    assert one(spark, text.normalize_date(F.lit(given))) == want


def test_hash_slug_deidentify(spark):
    import hashlib

    assert one(spark, text.stable_hash(F.lit("abc"), 997)) == int(hashlib.sha256(b"abc").hexdigest(), 16) % 997
    assert one(spark, text.slug(F.lit("--Ab c/9_"))) == "ab_c_9"
    assert one(spark, text.deidentify(F.lit("Call ANN (x+y) ann-lee now"), F.array(F.lit("ann"), F.lit("Ann-Lee"), F.lit("(X+Y)"), F.lit("no")))) == "Call now"
    assert one(spark, text.repeat_to(F.lit("a b c"), 7)) == "a b c a b c a"


def test_extracted_kinds(spark):
    said = "Write A.B@x.org or +1-555-0100-2345, EMP-700001 on 2026-01-05, abc12345, 2026-02-03T10:30; 42 1234"
    got = one(spark, candidates(F.lit(said)))
    assert got["email"] == ["a.b@x.org"] and got["employee_id"] == ["emp-700001"] and got["booking_code"] == ["abc12345"] and got["travel_date"] == ["2026-01-05"] and got["meeting_time"] == ["2026-02-03T10:30"]
    assert "seat_number" not in got and "1234" in got["last_four_digits"]


def test_intervals(spark):
    def wilson(s, n, z=stats.Z95):
        p, d = s / n, 1 + z * z / n
        m, h = (p + z * z / 2 / n) / d, z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n) / d
        return max(0.0, m - h), min(1.0, m + h)

    for s, n in ((0, 10), (3, 10), (10, 10)):
        low, high = stats.wilson(F.lit(s), F.lit(n))
        assert (one(spark, low), one(spark, high)) == pytest.approx(wilson(s, n))
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)
    low, high = stats.agresti_caffo(F.lit(9), F.lit(10), F.lit(1), F.lit(10))
    a, b = 10 / 12, 2 / 12
    h = stats.Z95 * math.sqrt(a * (1 - a) / 12 + b * (1 - b) / 12)
    assert (one(spark, low), one(spark, high)) == pytest.approx((a - b - h, min(1, a - b + h)))
    low, high = stats.agresti_caffo(F.lit(0), F.lit(0), F.lit(1), F.lit(10))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)


@pytest.mark.parametrize(("t", "n", "k"), [(1, 10, 1), (2, 10, 3), (3, 3, 1), (1, 5, 10), (0, 5, 1), (4, 40, 10)])
def test_chance(spark, t, n, k):
    top = 0.0 if not t else 1.0 if t >= n or n - t < min(k, n) else 1 - comb(n - t, min(k, n)) / comb(n, min(k, n))
    mrr = sum(comb(n - r, t - 1) / comb(n, t) / r for r in range(1, n - t + 2)) if t else 0.0
    assert one(spark, stats.random_top_k(F.lit(t), F.lit(n), k)) == pytest.approx(top)
    assert one(spark, stats.random_reciprocal_rank(F.lit(t), F.lit(n))) == pytest.approx(mrr)


def test_auc_and_bootstrap(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(2), float(rng.randrange(6))) for g in "ab" for _ in range(60)] + [("c", 1, 0.5)]
    got = {r.g: r.auc for r in sampling.auc(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s", ["g"]).collect()}
    for g in "ab":
        p, q = ([s for h, y, s in rows if h == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in q) / len(p) / len(q))
    assert got["c"] == 0.5
    values = spark.createDataFrame([("a", float(i % 2)) for i in range(100)] + [("b", 2.0)] * 5, "g string, value double")
    r = {x.g: x for x in sampling.bootstrap(values, ["g"], rounds=500).collect()}
    assert r["a"].mean == 0.5 and 0.35 < r["a"].ci_low < 0.5 < r["a"].ci_high < 0.65 and (r["b"].ci_low, r["b"].ci_high) == (2.0, 2.0)


BANDS = [
    (dict(leak=True), "high"), (dict(token=0.4), "high"), (dict(lcs=0.4), "high"), (dict(direct=True, anchor=True), "high"), (dict(direct=True, entity=True), "high"),
    (dict(token=0.1), "medium"), (dict(lcs=0.15), "medium"), (dict(entity=True), "medium"), (dict(), "no_cue"), (dict(anchor=True), "low"), (dict(char5=0.1), "medium"), (dict(piece=6), "medium"), (dict(anchor=True, piece=6), "medium"), (dict(direct=True), "no_cue"),
]


@pytest.mark.parametrize(("given", "want"), BANDS)
def test_bands(spark, given, want):
    base = dict(token=0.0, char5=0.0, lcs=0.0, leak=False, entity=False, anchor=False, direct=False, piece=0)
    assert one(spark, band(**{k: F.lit(v) for k, v in (base | given).items()})) == want


def test_leakage_filter(spark):
    lits = lambda *v: [F.lit(x) for x in v]
    assert one(spark, leakage("permissive", *lits(False, 0.9, 0.9, True, True))) is None
    assert one(spark, leakage("default", *lits(True, 0.9, 0.9, True, True))) == "exact_normalized_sensitive_value"
    assert one(spark, leakage("default", *lits(False, 0.79, 0.49, True, True))) == "deterministic_recovery_risk"
    assert one(spark, leakage("strict", *lits(False, 0.5, 0.2, True, True))) == "structured_sensitive_prefix"
    with pytest.raises(ValueError):
        leakage("odd", *lits(False, 0.0, 0.0, False, False))


def test_common_pieces_like_difflib_and_in_bounded_time():
    import random
    import time
    from difflib import SequenceMatcher

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc é", k=rng.randint(0, 40))) for _ in range(2))
        assert text.Pieces(b).longest_in(a) == SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
    a, b = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)) for _ in range(2))
    start = time.process_time()
    assert text.Pieces(a[:9000] + b[5000:5400] + a[9000:]).longest_in(b) >= 400
    assert text.Pieces("a" * 20_000).longest_in("a" * 19_999 + "b" * 5000) == 19_999
    assert time.process_time() - start < 5


def test_ratios_are_spared_only_where_they_cannot_be_larger(spark):
    import random
    from difflib import SequenceMatcher

    from tidemark.operators.cues import ratio_to_any

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(0, 12)))
    rows = [(word() or None, [word() for _ in range(rng.randint(0, 5))]) for _ in range(300)]
    got = spark.createDataFrame(rows, "t string, v array<string>").select("t", "v", ratio_to_any("t", "v").alias("r")).collect()
    assert all(r.r == max((SequenceMatcher(None, r.t or "", v).ratio() for v in r.v), default=0.0) for r in got)
