import random

import pytest

from tidemark.operators import containment


@pytest.mark.parametrize("most", [containment.MOST_BITS, containment.LEAST_BITS])
def test_like_plain_search(spark, monkeypatch, most):
    """Terms of all lengths and scripts; with a filter that passes nearly everything as well."""
    monkeypatch.setattr(containment, "MOST_BITS", most)
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab c\n", k=rng.randint(0, 80))) for _ in range(150)] + ["naïve 𝒳𝒴𝒵 text 𝒳𝒴𝒵𝒳𝒴𝒵 end", "x.*[a]$ (b) \\E", None, "", "ab" * 5000, "same same", "same same"]
    terms = ["".join(rng.choices("ab c\n", k=k)) for k in (1, 2, 3, 4, 5, 6, 7, 9, 12) for _ in range(8)] + ["𝒴𝒵𝒳", "𝒳𝒴𝒵𝒳𝒴𝒵 e", "ï", ".*[a]$ (", "\\E", "zzzzzz", "z", "", None, "ab" * 300, "same same", "same same"]
    hay = spark.createDataFrame([(t,) for t in texts], "hay string").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    real = {t for t in terms if t}
    got = {r.text_key: set(r.terms) for r in containment.contained(hay, wanted).collect()}
    import hashlib

    assert got == {hashlib.md5(t.encode()).hexdigest(): held for t in texts if t and (held := {x for x in real if x in t})}
    assert {r.term for r in containment.found_terms(hay, wanted).collect()} == {x for x in real if any(t and x in t for t in texts)}
    docs = spark.createDataFrame([(i, t, "old", "k") for i, t in enumerate(texts)], "i int, body string, hit string, __key string")
    flagged = containment.with_any(docs.drop("__key"), wanted, containment.F.col("body"), "hit").collect()
    assert {r.i: r.hit for r in flagged} == {i: bool(t) and any(x in t for x in real) for i, t in enumerate(texts)}


def test_nothing_to_look_for(spark):
    hay, none = spark.createDataFrame([("a",)], "hay string"), spark.createDataFrame([], "term string")
    assert containment.contained(hay, none).collect() == containment.found_terms(hay.limit(0), hay.select(containment.F.col("hay").alias("term"))).collect() == []


def test_texts_stay_where_they_are_read(spark, monkeypatch):
    """Terms are met by rare inner words, in parts; no text and no piece of one is dealt, only counts and keys."""
    monkeypatch.setattr(containment, "PART_BYTES", 200)
    made, stored = {}, containment.stored
    monkeypatch.setattr(containment, "stored", lambda df, kind: made.setdefault(kind, stored(df, kind)))
    texts = [f"the one of the many that x{i} has in the end" for i in range(300)]
    terms = [f"e many that x{i} has in" for i in range(0, 600, 50)] + ["of the many", "no such words here"]
    hay, wanted = spark.createDataFrame([(t,) for t in texts], "hay string").repartition(4), spark.createDataFrame([(t,) for t in terms], "term string")
    got = containment.contained(hay, wanted)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {t for r in got.collect() for t in r.terms} == {t for t in terms if any(t in x for x in texts)}
    assert dict(made["anchors"].collect())["e many that x50 has in"] == "x50" and made["anchors"].count() == 7
    assert plan.count("strategy=broadcast") > 1 and all("hay" not in x.split("[")[1].split("]")[0] for x in plan.split("\n") if "Aggregate [" in x)
