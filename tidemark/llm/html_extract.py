"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

Each block is main text or not.  Its features are the tags it lies in with the words of their class, id and role, and its
text: length, share of links, closing sign, some words.  Weights come from labelled pages by gradient steps on the
conditional likelihood (marginals by forward and backward sums); Viterbi decodes.  ``labelled_pages`` makes labelled pages
of many layouts; other lists of (blocks, labels) can be given to ``train``.

Text: character references decoded, white space in a block folded to one space, blocks joined by one newline.

Defined cases: null and empty html have the empty text, as have pages without main blocks; cut-off pages are read as far as
they go; repeated rows are each answered; an empty table gives no rows; other columns are ignored.  A page is read whole, in
memory that its own length bounds.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.dom import Block, blocks

PAGES, EPOCHS, RATE, DECAY = 900, 10, 0.3, 1e-4
_WORDS = {w: f"w:{w}" for w in "cookie cookies subscribe newsletter advertisement sponsored copyright comments comment reply share follow login privacy terms rights reserved menu search related posted".split()}


def path_features(path: tuple[str, ...]) -> list[str]:
    """Of the tags that a block lies in."""
    out = {"bias"}
    for k, element in enumerate(path):
        tag, *parts = element.split(".")
        out.add(f"t:{tag}")
        out.update(f"c:{p}" for p in parts)
        out.update(f"c:{a}-{b}" for a, b in zip(parts, parts[1:], strict=False))
        if k == len(path) - 1:
            out.add(f"own:{tag}")
        elif k == len(path) - 2:
            out.add(f"parent:{tag}")
    return sorted(out)


def text_features(block: Block) -> list[str]:
    n = len(block.text)
    out = [f"len:{min(n.bit_length(), 10)}", f"links:{min(4, 4 * block.linked // n)}"]
    last = block.text[-1]
    out.append("end:stop" if last in ".!?:;…\"')»”" else "end:letter" if last.isalpha() else "end:other")
    if "©" in block.text:
        out.append("sign")
    if n <= 200:
        out += sorted({_WORDS[w] for x in block.text.lower().split() if (w := x.strip(".,:;!?()")) in _WORDS})
    return out


class Model(NamedTuple):
    """Weights for "main" against "other", and of the steps between labels: from other, from main; to other, to main."""

    weights: dict[str, float]
    steps: tuple[float, float, float, float]
    first: float


def _scores(model: Model, page: Sequence[Block], known: dict[tuple[str, ...], float]) -> list[float]:
    get = model.weights.get
    out = []
    for b in page:
        base = known.get(b.path)
        if base is None:
            if len(known) > 100_000:
                known.clear()
            base = known[b.path] = sum(get(f, 0.0) for f in path_features(b.path))
        out.append(base + sum(get(f, 0.0) for f in text_features(b)))
    return out


def viterbi(scores: Sequence[float], model: Model) -> list[bool]:
    """The best labels, ties to other."""
    if not scores:
        return []
    oo, om, mo, mm = model.steps
    other, main = 0.0, model.first + scores[0]
    back = []
    for s in scores[1:]:
        a, b = other + oo, main + mo
        c, d = other + om, main + mm
        back.append((b > a, d > c))
        other, main = max(a, b), max(c, d) + s
    label = main > other
    out = [label]
    for to_other, to_main in reversed(back):
        label = to_main if label else to_other
        out.append(label)
    return out[::-1]


def _add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def train(pages: Sequence[tuple[Sequence[Block], Sequence[bool]]], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Conditional likelihood by steps on single pages, scaled by the gradients so far."""
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    step = dict.fromkeys(("oo", "om", "mo", "mm", "first"), 0.0)
    rng = random.Random(seed)
    data = [([[*path_features(b.path), *text_features(b)] for b in page], labels) for page, labels in pages if page]

    def move(of: dict[str, float], name: str, gradient: float) -> None:
        gradient -= DECAY * of.get(name, 0.0)
        squares[name] = squares.get(name, 1e-3) + gradient * gradient
        of[name] = of.get(name, 0.0) + RATE * gradient / math.sqrt(squares[name])

    for _ in range(epochs):
        rng.shuffle(data)
        for features, labels in data:
            s = [sum(weights.get(f, 0.0) for f in fs) for fs in features]
            n = len(s)
            fo, fm = [0.0] * n, [0.0] * n
            fm[0] = step["first"] + s[0]
            for i in range(1, n):
                fo[i] = _add(fo[i - 1] + step["oo"], fm[i - 1] + step["mo"])
                fm[i] = _add(fo[i - 1] + step["om"], fm[i - 1] + step["mm"]) + s[i]
            bo, bm = [0.0] * n, [0.0] * n
            for i in range(n - 2, -1, -1):
                bo[i] = _add(step["oo"] + bo[i + 1], step["om"] + s[i + 1] + bm[i + 1])
                bm[i] = _add(step["mo"] + bo[i + 1], step["mm"] + s[i + 1] + bm[i + 1])
            z = _add(fo[-1], fm[-1])
            gradient: dict[str, float] = {}
            for i, fs in enumerate(features):
                g = labels[i] - math.exp(fm[i] + bm[i] - z)
                for f in fs:
                    gradient[f] = gradient.get(f, 0.0) + g
            steps = dict.fromkeys(step, 0.0)
            steps["first"] = labels[0] - math.exp(fm[0] + bm[0] - z)
            for i in range(1, n):
                for name, a, b in (("oo", fo[i - 1], bo[i]), ("om", fo[i - 1], s[i] + bm[i]), ("mo", fm[i - 1], bo[i]), ("mm", fm[i - 1], s[i] + bm[i])):
                    real = ("m" if labels[i - 1] else "o") + ("m" if labels[i] else "o") == name
                    steps[name] += real - math.exp(a + step[name] + b - z)
            for f, g in gradient.items():
                move(weights, f, g)
            for f, g in steps.items():
                move(step, f, g)
    return Model(weights, (step["oo"], step["om"], step["mo"], step["mm"]), step["first"])


class _Maker:
    """Pages of random words and layouts, as lists of (html, is main)."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.m = random.Random(seed + 1_000_000)  # of media, so that they leave the other draws as they are
        self.v = random.Random(seed + 2_000_000)  # of rarer layouts, likewise
        self.o = random.Random(seed + 3_000_000)  # of how the main part opens, likewise
        self.vocabulary = ["".join(self.r.choices("aeioubcdfglmnprstvéüñ", k=self.r.randint(2, 10))) for _ in range(800)]

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choices(self.vocabulary, k=self.r.randint(lo, hi)))

    def sentence(self, lo: int = 4, hi: int = 18) -> str:
        return self.words(lo, hi).capitalize() + self.r.choice("....!?")

    def prose(self, lo: int = 1, hi: int = 6) -> str:
        kind = self.r.random()
        if kind < 0.08:
            return self.sentence(1, 3)
        if kind < 0.12:
            return " ".join(f"{w.upper()}!!" for w in self.words(2, 60).split())
        if kind < 0.16:
            return " ".join(f"{w}{self.r.choice(['***', '###', '$$$', '&amp;&amp;'])}" for w in self.words(2, 60).split())
        if kind < 0.2:
            return " | ".join(self.words(5, 40).split())
        return " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def open(self, tag: str, *names: str) -> str:
        kind = self.r.random()
        if not names or kind < 0.1:
            return f"<{tag}>"
        name = self.r.choice(names)
        return f'<{tag} {self.pick("class", "class", "id")}="{name}{self.pick("", "", " box", "-wrap", " c" + str(self.r.randint(1, 99)))}">'

    def links(self, lo: int = 3, hi: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(lo, hi))) + "</ul>"

    def other(self, kind: str | None = None) -> str:
        kind = kind or self.pick("nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "crumbs", "share", "related", "pages", "ad", "notice")
        if kind == "nav":
            tag = self.pick("nav", "nav", "div")
            return f"<nav>{self.links()}</nav>" if tag == "nav" else f'<div class="{self.pick("nav", "menu", "navigation", "navbar")}">{self.links()}</div>'
        if kind == "header":
            inner = self.pick(f"<a href='/'>{self.words(1, 3)}</a>", f"<p>{self.sentence()}</p>", f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 8)}</p>", f"{self.words(1, 5)}")
            return self.pick(f"<header>{inner}</header>", f'<div class="{self.pick("header", "site-header", "masthead", "topbar", "banner")}">{inner}</div>')
        if kind == "footer":
            inner = self.pick(f"&copy; {self.words(1, 2)} &middot; {self.prose(1, 3)}", f"<p>{self.sentence()}</p>{self.links(2, 5)}", f"<p>Copyright {self.words(1, 3)}. All rights reserved.</p>", self.prose(1, 2))
            return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="{self.pick("footer", "site-footer", "bottom", "copyright")}">{inner}</div>')
        if kind == "aside":
            inner = self.pick(f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<p>{self.prose(1, 3)}</p>", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(1, 2)}</p>")
            return self.pick(f"<aside>{inner}</aside>", f'<div class="{self.pick("sidebar", "side", "widget", "sidebar-right")}">{inner}</div>')
        if kind == "ad":
            inner = self.pick(self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"<a href='#'>{self.sentence()}</a>")
            return f'<{(t := self.pick("div", "div", "section", "aside"))} class="{self.pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot")}">{inner}</{t}>'
        if kind == "notice":
            inner = self.pick(f"<p>{self.pick('We use cookies.', '')} {self.prose(1, 2)}</p>", f"{self.prose(1, 2)} <button>{self.pick('OK', 'Accept', self.words(1, 1))}</button>")
            return f'<{(t := self.pick("div", "div", "section", "p"))} {self.pick("class", "id", "role")}="{self.pick("cookie", "cookie-notice", "notice", "alert", "consent", "gdpr", "banner", "popup", "warning")}">{inner}</{t}>'
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name='q'><select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>"
            return self.pick(f"<form>{inner}</form>", f'<div class="{self.pick("newsletter", "subscribe", "login", "search", "signup")}"><p>{self.sentence()}</p><form>{inner}</form></div>', f"<form><p>{self.prose(1, 2)}</p>{inner}</form>")
        if kind == "comments":
            tag = self.pick("div", "section", "ul", "ol")
            one = "li" if tag in ("ul", "ol") else self.pick("div", "article", "div")
            each = "".join(f'<{one} class="{self.pick("comment", "comment", "reply", "comment-body")}"><b>{self.words(1, 2)}</b><p>{self.prose(1, 3)}</p></{one}>' for _ in range(self.r.randint(1, 5)))
            return f'<{tag} {self.pick("class", "id")}="{self.pick("comments", "comments", "comment-list", "discussion", "responses", "disqus")}">{self.pick("", "<h3>Comments</h3>") if tag in ("div", "section") else ""}{each}</{tag}>'
        if kind == "crumbs":
            return f'<div class="{self.pick("breadcrumb", "breadcrumbs", "crumbs")}">' + " &raquo; ".join(f"<a href='#'>{self.words(1, 1)}</a>" for _ in range(3)) + "</div>"
        if kind == "share":
            return f'<div class="{self.pick("share", "social", "share-buttons")}">' + "".join(f"<a href='#'>{self.words(1, 2)}</a> " for _ in range(3)) + "</div>"
        if kind == "related":
            return f'<{(t := self.pick("div", "section", "aside"))} class="{self.pick("related", "recommended", "more", "related-posts")}"><h3>{self.words(1, 3)}</h3>{self.links()}</{t}>'
        return f'<div class="{self.pick("pagination", "pager", "tags", "meta")}">' + "".join(f"<a href='#'>{k}</a>" for k in range(1, 5)) + "</div>"

    def main(self) -> list[tuple[str, bool]]:
        parts = [(f"<h1>{self.words(1, 9)}{self.pick('', '.')}</h1>", True)] if self.r.random() < 0.85 else []
        for _ in range(self.r.randint(1, 10)):
            kind = self.r.random()
            if kind < 0.1:
                parts.append((f"<h{(h := self.r.randint(2, 4))}>{self.words(1, 6)}</h{h}>", True))
            elif kind < 0.16:
                parts.append(("<ul>" + "".join(f"<li>{self.words(2, 15)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>", True))
            elif kind < 0.2:
                parts.append((f"<blockquote>{self.prose()}</blockquote>", True))
            elif kind < 0.22:
                parts.append((f"<table><tr><th>{self.words(1, 2)}</th><td>{self.words(1, 3)}</td></tr><tr><th>{self.words(1, 2)}</th><td>{self.words(1, 3)}</td></tr></table>", True))
            elif kind < 0.32:
                parts.append((f"<p><b>{self.prose()}<br>", True))
            elif kind < 0.36:
                parts.append((f'<p>{self.prose()} <a href="#">{self.words(1, 4)}</a> {self.prose(1, 2)}</p>', True))
            elif kind < 0.45 and len(parts) > 1:
                parts.append((self.other(self.pick("ad", "ad", "notice", "share", "form", "aside", "related", "comments")), False))
            else:
                parts.append((f"<p>{self.prose()}</p>", True))
        if self.r.random() < 0.1:
            parts.append((self.other("comments"), False))
        return parts

    def said(self, lo: int, hi: int) -> str:
        return " ".join(self.v.choices(self.vocabulary, k=self.v.randint(lo, hi))).capitalize() + self.v.choice(("", ".", ".", "?"))

    def varied(self, main: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
        """main with a heading in a header of its own, lists of sentences, definitions, code, quotations or signs of the author's hand."""
        v = self.v
        if main and main[0][0].startswith("<h1") and v.random() < 0.3:
            top, end = v.choice((("<header>", "</header>"), ("<div class='post-header'>", "</div>"), ("<div class='entry-header'>", "</div>"), ("<header class='article-header'>", "</header>"), ("<div class='title'>", "</div>"), ("<hgroup>", "</hgroup>")))
            main = [(top, False), main[0], *([(f"<p>{self.said(4, 14)}</p>", True)] if v.random() < 0.4 else []), (end, False), *main[1:]]
        for _ in range(v.choice((0, 0, 1, 1, 2))):
            items = [self.said(3, 18) for _ in range(v.randint(2, 6))]
            kind = v.choice(("ol", "ul", "dl", "pre", "section", "quote", "steps"))
            part = {
                "ol": "<ol>" + "".join(f"<li>{x}</li>" for x in items) + "</ol>",
                "ul": "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>",
                "dl": "<dl>" + "".join(f"<dt>{self.said(1, 3)}</dt><dd>{x}</dd>" for x in items) + "</dl>",
                "pre": f"<pre>{items[0]}</pre>",
                "section": f"<section><h2>{self.said(1, 6)}</h2>" + "".join(f"<p>{x}</p>" for x in items) + "</section>",
                "quote": f"<blockquote><p>{items[0]}</p></blockquote>",
                "steps": f"<h2>{self.said(1, 4)}</h2><ol>" + "".join(f"<li><p>{x}</p></li>" for x in items) + "</ol>",
            }[kind]
            main.insert(v.randint(1, len(main)) if main else 0, (part, True))
        return main

    def opened(self, main: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
        """main without a heading on top: it opens with a paragraph, list, quotation or table, is that alone, or goes on after an advert or a form."""
        o, saved = self.o, (self.r, self.v)
        self.r = self.v = o  # what follows draws from o alone
        try:
            while main and not (main[0][1] and not re.match("<h[1-6]", main[0][0])):
                main = main[1:]
            item = lambda: self.said(1, 12)
            first = o.choice(
                (
                    f"<p>{self.said(1, 8)}</p>",
                    f"<p>{self.said(3, 20)}</p>",
                    f"<p>{self.prose()}</p>",
                    f"<p>{self.prose()}</p>",
                    f"<p>{o.choice(tuple(_WORDS)).capitalize()} {self.said(2, 9).lower()}</p>",
                    "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(o.randint(1, 5))) + "</ul>",
                    "<ol>" + "".join(f"<li>{item()}</li>" for _ in range(o.randint(1, 5))) + "</ol>",
                    f"<blockquote>{self.said(3, 20)}</blockquote>",
                    "<table>" + "".join(f"<tr><th>{self.said(1, 2)}</th><td>{item()}</td></tr>" for _ in range(o.randint(1, 4))) + "</table>",
                    f"{self.prose()}",
                )
            )
            if o.random() < 0.3:
                return [(first, True)]
            between = [(self.other(o.choice(("ad", "ad", "form", "form", "notice", "share", "aside"))), False)] if o.random() < 0.5 else []
            return [(first, True), *between, *(main or [(f"<p>{self.prose()}</p>", True)])]
        finally:
            self.r, self.v = saved

    def around(self) -> tuple[str, str]:
        """What opens and closes the main part in rarer layouts."""
        v = self.v
        name = v.choice(("content", "main", "post", "entry", "story", "article", "text", "body", "page-content", "post-body", "article-text", "hentry", "maincontent", "recipe", "col-left", "left-column", "primary", "center"))
        tag = v.choice(("div", "section", "section", "td", "article", "main"))
        start, end = f'<{tag} {v.choice(("class", "id", "id"))}="{name}">', f"</{tag}>"
        if tag == "td":
            start, end = f'<table><tr><td class="{v.choice(("menu", "nav", "navi"))}">{self.links()}</td>{start}', f"{end}</tr></table>"
        elif v.random() < 0.4:
            outer = v.choice(("post", "wrap", "container", "layout", "col-left", "row", "site", "columns"))
            start, end = f'<div class="{outer}">{start}', f"{end}</div>"
        return start, end

    def beside(self) -> str:
        """A part that is not main, by position or by a name that only hints at it."""
        v = self.v
        links = "".join(f'<a href="#">{self.said(1, 6)}</a> ' for _ in range(v.randint(2, 6)))
        listed = "<ol>" + "".join(f"<li><a href='#'>{self.said(2, 7)}</a>" for _ in range(v.randint(3, 6))) + "</ol>"
        name = v.choice(("right", "col-right", "right-column", "top", "bottom", "tagcloud", "promo", "most-read", "authorbox", "contentinfo", "sidebar", "hint"))
        return v.choice(
            (
                f'<div id="{name}"><h3>{self.said(1, 3)}</h3>{listed}</div>',
                f'<section id="{v.choice(("sidebar", "related", "tags", "topics"))}"><h3>{self.said(1, 2)}</h3>{links}</section>',
                f'<div role="contentinfo">{links}</div>',
                f'<aside class="sidebar"><h4>{self.said(1, 3)}</h4><p>{self.said(8, 25)}</p></aside>',
                f'<section class="{v.choice(("comments", "responses", "replies"))}"><h3>{self.said(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{self.said(6, 25)}</p></div>' for _ in range(v.randint(1, 4))) + "</section>",
                f'<div class="{v.choice(("bottom", "footer", "copyright"))}"><p>&copy; {v.randint(1995, 2030)} {self.said(1, 4)}</p>{links}</div>',
                f'<div class="ad-slot"><div class="ad-inner"><p>{self.said(5, 16)}</p><a href="#">{self.said(1, 3)}</a></div></div>',
                f"<center><font size=1>{self.said(3, 9)} <a href='#'>{self.said(1, 2)}</a></font></center>",
            )
        )

    def media(self) -> tuple[str, bool]:
        """A player or an object with text in its stead."""
        tag = self.m.choice(("video", "audio", "object", "canvas"))
        said = " ".join(self.m.choices(self.vocabulary, k=self.m.randint(2, 12))).capitalize() + "."
        return self.m.choice((f"<{tag}>{said}</{tag}>", f"<{tag} width='4'><p>{said}</p></{tag}>")), False

    def page(self) -> tuple[list[Block], list[bool]]:
        parts: list[tuple[str, bool]] = [("<html><body>", False)]
        parts += [(self.other(k), False) for k in ("notice", "header", "nav", "crumbs", "ad", "aside", "form") if self.r.random() < 0.45]
        kind = self.r.random()
        start, end = (
            ("<article>", "</article>")
            if kind < 0.6
            else (f"<main>{self.open('article', 'post')}", "</article></main>")
            if kind < 0.7
            else ("<main>", "</main>")
            if kind < 0.78
            else (f'<div class="{self.pick("content", "post", "entry", "article", "story", "main", "text", "article-body", "entry-content")}">', "</div>")
            if kind < 0.95
            else ("<div>", "</div>")
        )
        if self.r.random() < 0.1:
            start, end = f'<div class="{self.pick("wrap", "page", "container", "layout")}">{start}', f"{end}</div>"
        main = self.main()
        if self.m.random() < 0.15:
            main.insert(self.m.randrange(len(main) + 1), self.media())
        if self.v.random() < 0.35:
            start, end = self.around()
        if self.v.random() < 0.35:
            main = self.varied(main)
        if self.v.random() < 0.15:
            h = self.v.randint(2, 4)
            heading = self.v.choice((f"<h{h}>{self.v.randint(1, 40)} {self.said(1, 2)}</h{h}>", f"<h{h}>{self.said(1, 3)}</h{h}>", f"<p>{self.said(1, 4)}</p>"))
            one = self.v.choice(("article", "div", "li"))
            replies = "".join(f'<{one} class="{self.v.choice(("comment", "reply"))}"><p>{self.said(4, 25)}</p></{one}>' for _ in range(self.v.randint(1, 4)))
            main.append((f'<section {self.v.choice(("class", "id"))}="{self.v.choice(("comments", "comments", "replies", "responses"))}">{heading}{replies}</section>', False))
        if len(main) > 2 and self.v.random() < 0.15:
            main.insert(self.v.randrange(1, len(main)), (self.beside(), False))
        if self.o.random() < 0.3:
            main = self.opened(main)
            if self.o.random() < 0.15:  # nothing else on the page
                return self.labelled([*(parts[:1] if self.o.random() < 0.5 else []), *main])
        parts += [(self.beside(), False)] * (self.v.random() < 0.2)
        parts += [(start, False), *main, (end, False)]
        parts += [(self.beside(), False) for _ in range(self.v.choice((0, 0, 1, 2)))]
        parts += [(self.other(k), False) for k in ("share", "related", "comments", "form", "aside", "ad", "pages") if self.r.random() < 0.35]
        parts += [(self.other("footer"), False)] * (self.r.random() < 0.85)
        return self.labelled(parts)

    @staticmethod
    def labelled(parts: Sequence[tuple[str, bool]]) -> tuple[list[Block], list[bool]]:
        # a mark in each text tells where a block of the whole page comes from
        whole = "".join(f"{_marked(p)}" if keep else p for p, keep in parts)
        found = blocks(whole)
        return [b._replace(text=b.text.replace(_MARK, "").strip() or "-") for b in found], [_MARK in b.text for b in found]


_MARK = "\ue000"


def _marked(part: str) -> str:
    """Puts the mark where text begins: at the start, and after each tag that text follows."""
    return re.sub("(?<=>)(?=[^<])|^(?=[^<])", _MARK, part)


def labelled_pages(count: int = PAGES, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(count)]


@cache
def default_model() -> Model:
    return train(labelled_pages())


def main_text(page: str, model: Model, known: dict[tuple[str, ...], float] | None = None) -> str:
    found = blocks(page)
    labels = viterbi(_scores(model, found, {} if known is None else known), model)
    return "\n".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or default_model()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, ...], float] = {}
        for batch in batches:
            out = [main_text(h.as_py() or "", model, known) for h in batch.column("html")]  # one page at a time
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
