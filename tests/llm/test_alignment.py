"""Alignment against plain loops over whole texts."""

import hashlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
import regex

from tidemark.llm import alignment
from tidemark.llm.queries import BYTE_BPE, PIECE_BPE

A, B = partial(alignment.byte_level, BYTE_BPE), partial(alignment.piece_model, PIECE_BPE)
TEXTS = [
    "The quick brown fox, it's not here.\nNext line e.g. a.b,c ... ,. end",
    "  two  spaces   three \n\n blank \n lines\n\n\nx \t tab\r\nwindows\n",
    "naïve café — “quotes” 漢字かな交じり文。次の文。 Русский текст, ещё. 👩‍👩‍👧  nbsp  em　ideographic",
    "<|endoftext|> in text <s> </s> <unk> <0x0A> ok",
    "a▁b holds the sign of the model's spaces",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbbbbbbb 1234567890 12,345.67 --- ==== !!!! .,.,.,",
    "word",
    " ",
    "\n",
    ".",
    "don't can't we're I'll they'd 's 're.x 'S",
    "é combining. é, x́.y z​‌ zero ﻿ bom \x00 nul \x1f unit \x85 next",
    "",
    None,
    "word",
    "x" * 3000 + "." + "yz " * 500,
]


def plain(texts):
    """Per text: the contract's columns, from whole texts and all pairs."""
    a, b = A(), B()
    from tokenizers import Tokenizer
    import sentencepiece

    one = Tokenizer.from_file(BYTE_BPE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    docs, counts = [], Counter()
    for t in texts:
        links, groups, n = [], [], (0, 0)
        if t:
            ids = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
            if all(None not in (p := [e.pieces[i] for i in x]) and b"".join(p) == (" " + t).encode() for e, x in zip((a, b), ids, strict=True)):
                n = tuple(map(len, ids))
                spans = []
                for e, x in zip((a, b), ids, strict=True):
                    at, mine = 0, []
                    for i in x:
                        mine.append((at, at + len(e.pieces[i]), i))
                        at = mine[-1][1]
                    spans.append(mine)
                cuts = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
                first = 0
                for c in cuts:
                    inside = [[s for s in mine if first <= s[0] and s[1] <= c] for mine in spans]
                    groups.append("|".join(",".join(str(s[2]) for s in mine) for mine in inside))
                    links += [(x[2], y[2]) for x in inside[0] for y in inside[1] if x[0] < y[1] and y[0] < x[1]]
                    first = c
        docs.append((n, groups, links))
        counts.update(set(links))
    best = {}
    for (x, _), k in counts.items():
        best[x] = max(best.get(x, 0), k)
    return [
        (*n, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if links else "")
        for n, groups, links in docs
    ]


def rows_of(spark, docs):
    got = alignment.align(docs, A, B).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)


@pytest.mark.parametrize("hot", [alignment.HOT, 3])
def test_like_plain_loops(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    ids = [*range(len(TEXTS) - 1), None]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, n_a int, unit string").repartition(3)
    want = plain(TEXTS)
    assert want[4][0] == 0 and want[3][0] > 0
    assert rows_of(spark, docs) == sorted((i is None, i or 0, *w) for i, w in zip(ids, want, strict=True))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = docs.collect()
    assert rows_of(spark, docs) == sorted((False, r.doc_id, *w) for r, w in zip(given, plain([r.text for r in given]), strict=True))


def test_units_are_what_lies_between_cuts(spark):
    odd = [*filter(None, TEXTS), "漢字" * 50_000, " " * 50_000, "\n" * 5_000, ". , .a,b\n\nc \n d", "é.É,ɏ. ß"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    got = rows.select(alignment._units("text").alias("units")).collect()
    want = [[u for u in regex.split(rf"(?V1){alignment.CUT}", " " + t)] for t in odd]
    assert [r.units for r in got] == want


def test_parts_of_batches_are_cut_like_texts():
    odd = ["left out. ", None, "", "é.É,ɏ\u2003\n b\nc", "", "𝒜.a,𝒜 b\n a\n\nb", None, "\na", "left out"]
    got = alignment.cut(pa.array(odd, pa.string()).slice(1, 7)).to_pylist()
    assert got == [regex.split(rf"(?V1){alignment.CUT}", " " + t) if t else [] for t in odd[1:8]]


def test_units_are_counted_where_texts_are_read(spark):
    rows = spark.createDataFrame([("one two. one", 0), (None, 1), ("", 2), ("one", 3)], "_text string, _row long").coalesce(1)
    counted = alignment._counted(rows)
    assert {r.unit: r.n for r in counted.collect()} == {" one": 3, " two": 1, ".": 1}
    assert "explode" not in counted._jdf.queryExecution().toString().lower()


def test_tokens_that_give_their_text_back_have_ends():
    e = alignment.Encoder(lambda texts: [[0, 2], [1], [2, 2, 0], []], [b"a", None, b"bc"])
    ok, found = alignment._lists(e, [*"wxyz"], [b"abc", b"a", b"bcbca", b"a"])
    assert ok.tolist() == [True, False, True, False]
    assert found.to_pylist() == [[{"id": 0, "end": 1}, {"id": 2, "end": 3}], [], [{"id": 2, "end": 2}, {"id": 2, "end": 4}, {"id": 0, "end": 5}], []]


def test_numbers_are_met_once():
    assert sorted(alignment._once(np.array([3, 1, 3, 0, 1, 3]), np.empty(4, np.int64)).tolist()) == [0, 1, 3]
    assert alignment._once(np.array([], np.int64), np.empty(0, np.int64)).tolist() == []


def test_texts_that_are_not_utf_8_are_mended(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF2E62' AS STRING) AS text")
    assert rows_of(spark, docs) == [(False, 1, *plain(["a\ufffd.b"])[0])]


def test_documents_keep_numbers_of_frequent_units_and_the_rare_ones(spark):
    rows = spark.createDataFrame([(0, 7, "one two. rare one"), (1, None, None), (2, 9, "")], "_row long, _key long, _text string")
    hot = spark.sparkContext.broadcast(spark.createDataFrame([(" one", "3|4;", 1), (" two", "5|6;", 1)], "unit string, said string, n_a long").coalesce(1).toArrow())
    got = {r._row: (r._key, r.hot, r.rare) for r in alignment._dealt(rows, hot).collect()}
    assert got == {0: (7, [0, 1, None, None, 0], [".", " rare"]), 1: (None, [], []), 2: (9, [], [])}


def test_no_documents(spark):
    assert rows_of(spark, spark.createDataFrame([], "doc_id long, text string")) == []


def test_tokenizers_that_join_across_cuts_are_refused():
    with pytest.raises(ValueError):
        alignment.Encoder(lambda texts: [], [b"a", b"a b"])
