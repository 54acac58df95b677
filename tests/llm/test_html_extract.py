import html
import random
import re
from itertools import product

import pytest

from tests.llm.hand_pages import LATER, PAGES
from tests.llm.held_pages import HELD
from tidemark.llm import html_extract
from tidemark.llm.dom import blocks


def test_blocks():
    page = "<title>no</title><body><nav><a href='x'>Menu</a></nav><p>A &amp; b&nbsp; c<b>d</b><br>e<p>f<!-- <p>g --><script>'</p>'</script>h<div class='ad box'>i"
    got = blocks(page)
    assert [b.text for b in got] == ["Menu", "A & b cd e", "fh", "i"]
    assert got[0].linked == 4 and got[0].path == ("body", "nav", "a") or got[0].path == ("body", "nav")
    assert got[-1].path[-1] == "div.ad.box"


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<article><p>One.</p><svg class='i'/><p>Two.</p></article>", ["One.", "Two."]),
        ("<p>One <video-js>in</video-js> two <title-card>x</title-card><object-view>y</object-view><p>z", ["One in two xy", "z"]),
        ("<article><video src='x'><p>Two.</p></article><p>Three", ["Two.", "Three"]),
        ("<object><p>One<canvas><p>Two<audio>Three", ["One", "TwoThree"]),
        ("<p>One <video><source src='x'></video>two", ["One two"]),
        ("<p>One<svg><title/><svg>no</svg>no<p>Two", ["One", "Two"]),
        ("<p>One<svg><title>no</title><g>no</g></svg> two<math><mi>x</mi></math>", ["One two"]),
        ("<template><p>no<template>no</template>no</template>One<style>no</styles>", ["One"]),
    ],
)
def test_hidden_elements_end(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_text_after_open_media_is_main():
    said = "The river rose again on Monday. People walked home along the old road and waited."
    model = html_extract.default_model()
    for tag in ("video", "audio", "object", "canvas"):
        instead = f"<article><h1>Rain</h1><p>{said}</p><{tag} src='x'>Your browser shows no media.</{tag}><p>{said}</p></article>"
        assert html_extract.main_text(instead, model).split("\n") == ["Rain", said, said]
        page = f"<body><nav><a href='/'>Menu</a></nav><article><h1>Rain</h1><p>{said}</p><{tag} src='x'><p>{said}</p><p>{said}</p></article><footer>Copyright us</footer>"
        assert html_extract.main_text(page, model).split("\n") == ["Rain", said, said, said]


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "a < b", "<p>x</", "<!-- x", "<script>x", "<p class='x>y", "&amp", "<a><p>x</a></p>" * 50, "<" * 5000, "<p class='" * 3000])
def test_broken_pages_are_read(page):
    for b in blocks(page):
        assert b.text == " ".join(b.text.split())


def test_held_out_accuracy():
    model, wrong, total = html_extract.default_model(), 0, 0
    for page, labels in html_extract.labelled_pages(150, seed=99):
        wrong += sum(a != b for a, b in zip(html_extract.viterbi(html_extract._scores(model, page, {}), model), labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.01


def test_viterbi_equals_all_labellings():
    rng = random.Random(1)
    for _ in range(50):
        model = html_extract.Model({}, tuple(rng.gauss(0, 1) for _ in range(4)), rng.gauss(0, 1))
        scores = [rng.gauss(0, 1) for _ in range(rng.randrange(1, 8))]
        oo, om, mo, mm = model.steps

        def value(y):
            steps = {(0, 0): oo, (0, 1): om, (1, 0): mo, (1, 1): mm}
            return y[0] * model.first + sum(s * k for s, k in zip(scores, y)) + sum(steps[a, b] for a, b in zip(y, y[1:]))

        best = max(product((0, 1), repeat=len(scores)), key=value)
        assert tuple(map(int, html_extract.viterbi(scores, model))) == best


def article(page):
    a = page[page.index("<article>") + 9 :].partition("</article>")[0]
    a = re.sub("<[^>]*>?", "", re.sub("<br>", " ", re.sub("</?(?:p|h1)>", "\0", a)))
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in a.split("\0")) if t)


@pytest.mark.parametrize(("page", "text"), [*PAGES, *LATER])
def test_pages_written_by_hand(page, text):
    assert html_extract.main_text(page, html_extract.default_model()) == text


@pytest.mark.parametrize(("page", "text"), HELD)
def test_pages_that_nothing_was_tuned_on(page, text):
    assert html_extract.main_text(page, html_extract.default_model()) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>A.</p><div class='sponsored-box'><p>ad</p></div><p>B.</p></article>", "A.\nB."),
        ("<article><p>The first words.</p><form><input><button>Go</button></form><p>The last words.</p></article>", "The first words.\nThe last words."),
        ("<article><p>Short text here.</p></article>", "Short text here."),
        ("<div class='cookie'><p>We use cookies.</p></div><article><p>Cookies are baked at 180 degrees.</p></article>", "Cookies are baked at 180 degrees."),
        ("<p>Just one paragraph.</p>", "Just one paragraph."),
        ("Plain text of a page without tags.", "Plain text of a page without tags."),
    ],
)
def test_articles_without_a_heading(page, text):
    assert html_extract.main_text(page, html_extract.default_model()) == text


def test_very_long_texts_in_one_batch(spark):
    """Long pages among short ones, all in one batch of rows."""
    prose = "The river rose again on Monday and people walked home along the old road. " * 20
    long = "<nav><a href='/'>Menu</a></nav><article><h1>Rain</h1>" + f"<p>{prose}</p>" * 1000 + "</article>"
    rows = [(k, None, long if k % 5 == 0 else f"<article><p>{prose}</p></article>", None, None) for k in range(20)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").coalesce(1)).collect()
    assert {r.page_id: r.text for r in got} == {k: "\n".join(["Rain"] + [prose.strip()] * 1000) if k % 5 == 0 else prose.strip() for k in range(20)}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_articles_of_the_pages_table(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    expected = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_extract.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == expected
    assert all(r.n_chars == len(r.text) for r in got)


def test_defined_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html_extract.extract(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, None, "x", 1), (1, None, None, "x", 1), (None, "u", "", None, None), (2, "v", "<nav><a>x</a></nav>", None, None)]
    assert [(r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect()] == [("", 0)] * 4
