import math
import random

from pyspark.sql import functions as F

from tidemark.llm import language_id

SYLLABLES = {"aa": ["lo", "re", "mip", "sum"], "bb": ["kra", "tso", "zvi", "pek"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_unknown_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, sample_rows=200)
    got = language_id.identify(language_id.document_evidence(docs.withColumn("lang", F.lit(None).cast("string"))), model)
    right = got.join(docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("label")), "key")
    assert right.filter("kept").count() == docs.count()
    assert right.filter("lang = label").count() >= 0.99 * docs.count()
    odd = spark.createDataFrame([(1, "αβγδ εζηθ ικλμ νξοπ ρστυ φχψω αβγδ εζηθ", None, None), (2, "12 34 !!", "en", "src0"), (3, None, None, None), (4, "", "fr", None)], "doc_id long, text string, lang string, source string")
    assert [r.kept for r in language_id.identify(language_id.document_evidence(odd), model).orderBy("key").collect()] == [False] * 4


def test_every_label_is_a_language(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, "aa", 40), "aa", "x") for i in range(600)]
    rows += [(1000 + 10 * k + i, text(rng, "bb", 40), f"l{k}", "x") for k in range(9) for i in range(1 + k % 2)]
    rows += [(7, "the very same words", "copies", "x")] * 50 + [(None, "nameless words", "nameless", "x")] * 50
    rows += [(2000, "12 34", "digits", "x"), (2001, None, "none", "x"), (2002, "56 " * 3000 + "words", "late", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    model = language_id.fit(docs, sample_rows=20)
    assert model.languages == ["aa", "copies", *sorted(f"l{k}" for k in range(9)), "late", "nameless", "und"]
    assert (model.weights.max(1) > 0).all() and (model.weights == language_id.fit(docs.repartition(3), sample_rows=20).weights).all()


def test_a_rare_language_is_told(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, "aa", 40), "aa", "x") for i in range(600)] + [(1000 + i, text(rng, "bb", 40), "bb", "x") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs, sample_rows=20)
    got = language_id.identify(language_id.document_evidence(docs), model).filter("key >= 1000").collect()
    assert [(r.lang, r.kept) for r in got] == [("bb", True)] * 3


def test_evidence_settles_what_text_leaves_open(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, text(rng, "aa" if i % 2 else "bb", 40), "aa" if i % 2 else "bb", "x") for i in range(200)], "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs)
    pages = [(i, f"http://{h}.{d}.{s}/p", f"<html lang='{lang}'><p>{text(rng, lang, 30)}</p>") for i, (h, d, s, lang) in enumerate([("a", "one", "aa", "aa"), ("b", "two", "bb", "bb")] * 40)]
    pages += [(900, "http://a.one.aa/q", "<p>xq</p>"), (901, "http://b.two.bb/q", "<p>xq</p>"), (902, "http://new.two.bb/q", "<p>xq</p>"), (903, None, None)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.key: r for r in language_id.identify(language_id.page_evidence(rows), model).collect()}
    assert [got[i].lang for i in (900, 901, 902)] == ["aa", "bb", "bb"]
    assert all(got[i].lang == ("bb" if i % 2 else "aa") and got[i].kept for i in range(80))
    assert not got[903].kept


def test_empty_tables_and_extra_columns(spark):
    schema = "doc_id long, text string, lang string, source string, key int, logs string, kept int"
    empty = spark.createDataFrame([], schema)
    model = language_id.fit(empty)
    assert model.languages == ["und"]
    assert language_id.identify(language_id.document_evidence(empty), model).collect() == []
    rows = spark.createDataFrame([(1, "some words", None, None, 5, "x", 1)] * 2 + [(None, "some words", "en", "s", None, None, None)], schema)
    got = language_id.identify(language_id.document_evidence(rows), model).collect()
    assert len(got) == 3 and all(r.lang == "und" and not r.kept for r in got)


def naive_trigrams(text):
    data = b"  " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()) + b"  "
    found = []
    for a, b, c in zip(data, data[1:], data[2:]):
        if a == b == 32:
            found.append(0)
        else:
            x = ((a * 0x9E3779B1) & 0xFFFFFFFF) ^ ((b * 0x85EBCA6B) & 0xFFFFFFFF) ^ ((c * 0xC2B2AE35) & 0xFFFFFFFF)
            found.append(((x * 0x27D4EB2F) & 0xFFFFFFFF) >> 16)
    return found, sum(b != 32 for b in data)


def brute(rows, model):
    """Answers of rows (key, text, declared, suffix, host, domain) by plain loops, from the formulas of the module's text."""
    n = len(model.languages)
    logs, guesses = [], []
    for _, text, *_ in rows:
        found, letters = naive_trigrams(text)
        sums = [language_id.TEMPER * sum(float(model.weights[k][t]) for t in found) if letters and k < n - 1 else 0.0 for k in range(n)]
        logs.append((sums, letters))
        guesses.append(max(range(n), key=lambda k: (sums[k], -k)) if letters else None)
    seen = [sum(g == k for g in guesses) for k in range(n)]
    prior = [(seen[k] + 1) / (sum(seen[:-1]) + n - 1) * (1 - language_id.UNKNOWN) for k in range(n - 1)] + [language_id.UNKNOWN]

    def counts(column, value):
        return [sum(g == k and r[column] == value for g, r in zip(guesses, rows)) for k in range(n)]

    def lean(column, value, on):
        if value is None:
            return on
        c = counts(column, value)
        return [(a + language_id.LEAN * p) / (sum(c) + language_id.LEAN) for a, p in zip(c, on)]

    out = []
    for (sums, letters), row in zip(logs, rows):
        chance = lean(4, row[4], lean(5, row[5], prior))
        total = [a + math.log(p) for a, p in zip(sums, chance)]
        for column in (2, 3):
            if row[column] is not None:
                total = [t + math.log((c + 0.1) / (s + 1.0)) for t, c, s in zip(total, counts(column, row[column]), seen)]
        best = max(range(n), key=lambda k: (total[k], -k))
        posterior = 1 / sum(math.exp(t - total[best]) for t in total)
        kept = letters > 0 and best < n - 1 and posterior >= language_id.LEAST
        out.append((row[0], model.languages[best], posterior, letters, kept))
    return sorted(out, key=lambda r: (r[0] is None, r[0]))


def check_against_brute(evidence, model):
    rows = [tuple(r) for r in evidence.select("key", "text", "declared", "suffix", "host", "domain").collect()]
    got = sorted((tuple(r) for r in language_id.identify(evidence, model).select("key", "lang", "posterior", "letters", "kept").collect()), key=lambda r: (r[0] is None, r[0]))
    expected = brute(rows, model)
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(r[0], r[1], r[3], r[4]) for r in expected]
    assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, expected))


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6, "xq", "fr", "src0", 1), (10**6 + 1, "12 !!", "en", "src1", 1), (10**6 + 2, None, None, None, None), (10**6 + 3, "Ünüs ñ", "de-AT", "elsewhere", 1), (10**6 + 4, "words " * 40_000, "en", "src0", 1)], docs.schema)
    rows = docs.unionByName(odd)
    check_against_brute(language_id.document_evidence(rows), language_id.fit(docs))


def test_pages_equal_brute_force(spark):
    """Markup, suffix, domain and host of real pages, and of some that have other or no addresses."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(10**6, "https://a.b.example.de/x", "<html lang='de'><p>xq"), (10**6 + 1, "http://b.example.de", "<p>"), (10**6 + 2, None, None), (10**6 + 3, "ftp://user@c.example.fr:21/y", "<html lang=fr-CA><script>no</script>ou")], pages.schema)
    check_against_brute(language_id.page_evidence(pages.unionByName(odd)), language_id.fit(docs))


def test_labels_count_by_their_first_subtag(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, "aa", 30), ("en", "EN-us", " en-GB")[i % 3], "x") for i in range(60)] + [(100 + i, text(rng, "bb", 30), "de", "y") for i in range(30)] + [(200, "words here", "", "x"), (201, "words here", "-", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs)
    assert model.languages == ["de", "en", "und"]
    got = {r.key: r for r in language_id.identify(language_id.document_evidence(docs), model).collect()}
    assert all(got[i].lang == "en" and got[i].kept for i in range(60)) and all(got[100 + i].lang == "de" for i in range(30))
    assert language_id.fit(docs, most_languages=1).languages == ["en", "und"]


def test_evidence_tables_of_any_size_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    pages = [(i, None if i % 5 == 0 else f"http://h{i % 9}.d{i % 4}.{('aa', 'bb')[i % 2]}/p", f"<html lang='{('aa', 'bb')[i % 2]}'><p>{text(rng, ('aa', 'bb')[i % 2], 5)}</p>" if i % 7 else None) for i in range(120)]
    docs = spark.createDataFrame([(i, text(rng, ("aa", "bb")[i % 2], 40), ("aa", "bb")[i % 2], "x") for i in range(100)], "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs)
    rows = language_id.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    once = sorted(map(str, language_id.identify(rows, model).collect()))
    monkeypatch.setattr(language_id, "BROADCAST_NUMBERS", 0)
    assert sorted(map(str, language_id.identify(rows, model).collect())) == once and len(once) == 120
