import random
import re

import pytest

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import contaminated

ITEM = "A train leaves the station at 60 km per hour and after 3 hours the driver calls Maria Lopez to say that 60 km remain before the river."
SCHEMA = "doc_id long, text string, kind string, item_id long"
BENCH = "item_id long, text string, doc_id long"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], SCHEMA)


def bench(spark, *texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], BENCH)


def found(df):
    return sorted((r.doc_id, r.item_id, r.kind) for r in df.collect())


def test_exact_and_new_parameters(spark):
    other = ITEM.replace("60 km", "85 miles").replace("3 hours", "7 hours").replace("Maria Lopez", "Ken")
    torn = ITEM.replace("60 km per", "85 km per")  # the other 60 stays: one value stands for two
    filler = "nothing of interest is said in these words which go on for a while. "
    got = found(contaminated(docs(spark, filler + ITEM + filler, filler * 2 + other, ITEM.upper().replace(",", " -"), filler * 5, torn, None, ""), bench(spark, ITEM)))
    assert got[:3] == [(0, 0, "exact"), (1, 0, "template"), (2, 0, "exact")]
    assert {d for d, *_ in got} <= {0, 1, 2, 4}


def test_names_that_open_sentences(spark):
    item = "Anna has 12 red apples. Tom has 7 green apples. Eve eats 3 of them. How many apples are left?"
    renamed = item.replace("Anna", "Maria").replace("Tom", "Bill").replace("Eve", "Ken")
    renumbered = renamed.replace("12", "40").replace("7", "9").replace("3", "5")
    longer = renamed.replace("Maria", "Maria Lopez")
    quoted = f"He was asked this by Joe: {renumbered} Nobody knew."
    others = "Maria sold 12 old books. Bill sold 7 new books. Ken kept 3 of them. Which books are gone?"
    rows = docs(spark, renamed, renumbered, longer, quoted, others)
    assert found(contaminated(rows, bench(spark, item))) == [(i, 0, "template") for i in range(4)]


def test_names_that_open_sentences_must_agree(spark):
    item = "Anna has 12 red apples. Anna buys 7 green apples. Anna eats 3 of them. Anna sells 2 of the green ones. Anna counts what is left."
    mixed = item
    for name in ("Tom", "Eve", "Ken", "Bill", "Maria"):
        mixed = mixed.replace("Anna", name, 1)
    assert found(contaminated(docs(spark, mixed, item.replace("Anna", "Tom")), bench(spark, item))) == [(1, 0, "template")]


def test_long_passages_of_long_items(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    parts = [" ".join(words[20 : 20 + n]) for n in (95, 30, 29)]
    torn = " ".join(" ".join(words[20 * k : 20 * k + 10]) + " zzz" for k in range(8))
    got = contaminated(docs(spark, *parts, torn), bench(spark, " ".join(words))).collect()
    assert sorted((r.doc_id, r.kind, r.coverage) for r in got) == [(0, "exact", 95 / 200), (1, "exact", 30 / 200)]


def test_slots_must_agree(spark):
    item = "first take 5 apples then add 5 apples then share 5 apples then eat 5 apples then sell 5 apples then buy 5 apples then lose 5 apples"
    values = iter(range(10, 99))
    mixed = re.sub("5", lambda m: str(next(values)), item)
    assert found(contaminated(docs(spark, mixed, item.replace("5", "12")), bench(spark, item))) == [(1, 0, "template")]


def test_defined_cases(spark):
    empty = bench(spark)
    assert found(contaminated(docs(spark, ITEM), empty)) == []
    assert found(contaminated(docs(spark), bench(spark, ITEM))) == []
    short = bench(spark, "two words", None, "", "these five words stand here", "these five words stand here")
    rows = docs(spark, "and these five words stand here again", "two words", "these five words", None)
    # an item of two words is found where it is the whole text
    assert found(contaminated(rows.union(rows.limit(1)), short)) == [(0, 3, "exact"), (0, 3, "exact"), (0, 4, "exact"), (0, 4, "exact"), (1, 0, "exact")]


def test_items_of_a_few_tokens(spark):
    items = bench(spark, "Why not?", "What is 2 + 2?", "Who? Me", "...", "7")
    rows = docs(spark, "He asked: so? Why not! She left.", "why not", "Why not now?", "Is that so.\nWhat is 2 + 2? Four", "what is 2 2 then", "Who\nme? you", "who me", "it was 7", "In all:\n7\n8")
    assert found(contaminated(rows, items)) == [(0, 0, "exact"), (1, 0, "exact"), (3, 1, "exact"), (4, 1, "exact"), (5, 2, "exact"), (6, 2, "exact"), (8, 4, "exact")]


def test_scripts_without_spaces(spark):
    item = "一列火车以每小时60公里的速度离开车站，三小时后司机打电话给玛丽亚。"
    changed = item.replace("60", "85")
    other = "昨天下午我们在公园里散步，天气很好，花都开了，孩子们在草地上玩耍。"
    part = f"据说{item[:20]}，后来就不知道了。"
    got = found(contaminated(docs(spark, f"开头有别的话。{item}结尾。", changed, other, part, "火车"), bench(spark, item, "什么？")))
    assert got == [(0, 0, "exact"), (1, 0, "template"), (3, 0, "exact")]
    assert found(contaminated(docs(spark, "他问了。什么？没人回答。", "什么都没有。"), bench(spark, "什么？"))) == [(0, 0, "exact")]


def test_tables_of_numbers_match_by_value(spark):
    rng = random.Random(8)
    numbers = [str(rng.randrange(10, 999)) for _ in range(100)]
    table = ", ".join(numbers)
    lines = "\n".join(" | ".join(numbers[k : k + 5]) for k in range(0, 100, 5))
    others = ", ".join(str(rng.randrange(10, 999)) for _ in range(100))
    assert found(contaminated(docs(spark, f"as given: {lines} so it was", others, " ".join(numbers[:10])), bench(spark, table))) == [(0, 0, "exact")]


def test_coverage_like_plain_loops(spark):
    """Texts of plain words, whose levels are alike: windows of eight lined up by distance, half of the item or thirty in a row."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    items = [rng.sample(words, rng.choice((4, 6, 8, 9, 20, 45, 90))) for _ in range(25)]
    texts = []
    for _ in range(120):
        it, parts = rng.choice(items), []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(it))
            parts += it[a : a + rng.randint(3, 40)] + rng.choices(words, k=rng.randint(0, 4))
        texts.append(parts)

    def cover(doc, item):
        n = min(8, len(item))
        covered = {q for p in range(len(item) - n + 1) for s in range(len(doc) - n + 1) if item[p : p + n] == doc[s : s + n] for q in range(p, p + n)}
        run = most = 0
        for q in range(len(item)):
            run = run + 1 if q in covered else 0
            most = max(most, run)
        return len(covered) / len(item), most

    want = sorted((d, i) for d, doc in enumerate(texts) for i, item in enumerate(items) if (c := cover(doc, item))[0] >= 0.5 or c[1] >= 30)
    got = contaminated(docs(spark, *map(" ".join, texts)), bench(spark, *map(" ".join, items))).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == want and len(want) > 30
    assert all(abs(r.coverage - cover(texts[r.doc_id], items[r.item_id])[0]) < 1e-9 for r in got)


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [" ".join(f"w{rng.randrange(300)}" for _ in range(30)) for _ in range(12)]
    items += [" ".join("".join(rng.choices("abcdefg", k=4)) for _ in range(30)) for _ in range(12)]
    texts = [" ".join(rng.choice(items).split()[: rng.randrange(5, 31)]) for _ in range(40)]
    whole = found(contaminated(docs(spark, *texts), bench(spark, *items)))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 100)
    assert found(contaminated(docs(spark, *texts), bench(spark, *items))) == whole and whole


@pytest.mark.parametrize("name", ["sf0.001"])
def test_planted_passages(spark, name):
    folder = f"/root/testdata/{name}"
    d, b = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")

    def plain(t):
        return " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "

    items = [(r.item_id, plain(r.text)) for r in b.collect()]
    expected = sorted((r.doc_id, i) for r in d.collect() for i, t in items if t in plain(r.text))
    assert sorted((r.doc_id, r.item_id) for r in contaminated(d, b).collect()) == expected


NAMES = ["Anna", "Tom", "Eve", "Maria Lopez", "Ken", "Bill", "Zoe", "Otto", "Ines", "Paul"]
UNITS = ["kg", "lb", "km", "miles", "hours", "minutes", "euros", "dollars"]


def questions(rng, count):
    """Word problems of random words, half of them full of numbers; each with other names, numbers and units of the same pattern."""
    words = ["".join(rng.choices("abcdefghilmnoprst", k=rng.randrange(3, 9))) for _ in range(400)]
    for k in range(count):
        names, numbers, units = rng.sample(NAMES, 3), rng.sample(range(2, 999), 4), rng.sample(UNITS, 2)
        pattern = []
        for _ in range(rng.randrange(2, 5)):
            sentence = [f"<n{rng.randrange(3)}>"]
            for _ in range(rng.randrange(4, 9)):
                sentence += [rng.choice(words)] if k % 2 else [f"<d{rng.randrange(4)}>", f"<u{rng.randrange(2)}>", rng.choice(words)]
            pattern.append(" ".join(sentence) + ".")
        pattern = " ".join(pattern)

        def filled(names, numbers, units, text=pattern):
            for mark, values in (("n", names), ("d", numbers), ("u", units)):
                for i, v in enumerate(values):
                    text = text.replace(f"<{mark}{i}>", str(v))
            return text

        others = rng.sample([n for n in NAMES if n not in names], 3)
        changed = others, rng.sample(range(1000, 9999), 4), rng.sample([u for u in UNITS if u not in units], 2)
        yield filled(names, numbers, units), filled(*changed)


def test_recall_of_new_parameters(spark):
    rng = random.Random(11)
    made = list(questions(rng, 120))
    filler = ["".join(rng.choices("uvwxyz", k=5)) for _ in range(300)]
    around = lambda: " ".join(rng.choices(filler, k=40))
    texts = [f"{around()}. {new} {around()}" for _, new in made] + [around() + f" {rng.randrange(99)} kg. " + around() for _ in range(60)]
    got = contaminated(docs(spark, *texts), bench(spark, *(old for old, _ in made))).collect()
    caught = {r.doc_id for r in got if r.doc_id == r.item_id}
    assert len([i for i in caught if i % 2]) >= 0.9 * 60 and len([i for i in caught if not i % 2]) >= 0.9 * 60
    assert not [r for r in got if r.doc_id != r.item_id]


def test_words_that_polynomials_confuse(spark):
    one = "".join("ab"[k.bit_count() & 1] for k in range(4096))
    words = [w for size in (16, 2048, 4096) for w in (one[:size], one[:size].translate(str.maketrans("ab", "ba")))]
    texts = [" ".join(words[k::2] * 4) for k in (0, 1)]
    assert found(contaminated(docs(spark, *texts), bench(spark, texts[0]))) == [(0, 0, "exact")]


def test_clashing_columns_and_nulls(spark):
    d = spark.createDataFrame([(None, ITEM, 1, "x", 2), (5, ITEM, None, None, None)], "doc_id long, text string, row long, level string, hash long")
    b = spark.createDataFrame([(None, ITEM, 1, 2), (3, None, None, None)], "item_id long, text string, item_no long, size long")
    got = contaminated(d, b).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.kind) for r in got) == [(0, None, "exact"), (5, None, "exact")]
