"""Leaf blocks of HTML pages: runs of text between block-level tags, with the tags they lie in."""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

#: Elements whose content is raw text and no text of the page, up to their end tag or the end of the page.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in ("script", "style", "title", "iframe", "noscript")}
#: Elements of which nothing is text of the page; svg and math end on "/>" too, and as browsers end them.
_HIDDEN = frozenset(("svg", "math", "template"))
#: Elements within svg and math that hold ordinary elements.
_POINTS = frozenset("template foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Tags that end svg and math.
_BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements whose text is shown only in their stead; without any they leave no mark, nor do those that are not closed.
_MEDIA = {t: re.compile(rf"(?:\s++|<(?:source|track|param|embed|img)(?=[\s/>])[^>]*+>)*+</{t}\s*>", re.I) for t in ("object", "video", "audio", "canvas")}
_NEXT = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in _MEDIA}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile("[a-z]+")
_BLOCK = frozenset(
    "address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul video".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of these, up to the boundary.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
_BOUNDARY = frozenset("ul ol dl table select menu article section div object body html".split())
_STAYS = frozenset("html body".split())
_NO_PARAGRAPH = frozenset("button label legend option optgroup caption td th tr thead tbody tfoot li dt dd summary select textarea object video audio canvas body html".split())


class Block(NamedTuple):
    """text: white space folded. path: the open elements, outermost first, each a tag with the parts of its class, id and role."""

    text: str
    path: tuple[str, ...]
    linked: int


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order. Open, unknown or cut-off tags are taken as browsers do, in outline."""
    out: list[Block] = []
    stack: list[str] = []
    tags: list[str] = []
    hidden: list[str] = []
    held: list[str] = []
    at = linked = anchors = 0
    body = page

    def text(lo: int, hi: int) -> None:
        nonlocal linked
        part = body[lo:hi]
        if "&" in part:
            part = _html.unescape(part)
        held.append(part)
        if anchors:
            linked += len(part)

    def flush() -> None:
        nonlocal linked
        if held:
            whole = " ".join("".join(held).split())
            held.clear()
            if whole:
                out.append(Block(whole, tuple(stack), linked))
        linked = 0

    def close(k: int) -> None:
        nonlocal anchors
        flush()
        anchors -= tags[k:].count("a")
        del stack[k:], tags[k:]

    found = _TOKEN.finditer(page)
    while m := next(found, None):
        if m.start() > at and not hidden:
            text(at, m.start())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        foreign = bool(hidden) and hidden[-1] not in _POINTS
        if not m["end"] and not foreign and (tag in _RAW or tag in _MEDIA):
            skipped = _RAW[tag].search(page, at) if tag in _RAW else _MEDIA[tag].match(page, at)
            if skipped or tag in _RAW:
                at = skipped.end() if skipped else len(page)
                found = _TOKEN.finditer(page, at)
                continue
            if not ((following := _NEXT[tag].search(page, at)) and following[1]):
                continue
        if hidden or (tag in _HIDDEN and not m["end"]):
            if not _leaves(hidden, tag, bool(m["end"]), m["attributes"], tags):
                continue
        if tag == "br":
            held.append(" ")
        elif m["end"]:
            if tag in _BLOCK:
                flush()
            if tag in tags and tag not in _STAYS:
                k = len(tags) - 1 - tags[::-1].index(tag)
                if tag in _BLOCK or not any(t in _BLOCK for t in tags[k:]):
                    if tag in _BLOCK:
                        close(k)
                    else:
                        anchors -= tag == "a"
                        del stack[k], tags[k]
                elif tag == "a":  # a link that blocks interrupt
                    anchors -= 1
                    del stack[k], tags[k]
        elif tag in _BLOCK:
            flush()
            if tag not in _NO_PARAGRAPH and "p" in tags:
                k = len(tags) - 1 - tags[::-1].index("p")
                if not any(t in _BOUNDARY for t in tags[k:]):
                    close(k)
            if tag in _CLOSES:
                for k in range(len(tags) - 1, -1, -1):
                    if tags[k] in _CLOSES[tag]:
                        close(k)
                        break
                    if tags[k] in _BOUNDARY and not (tag in ("td", "th") and tags[k] == "tr"):
                        break
            if tag not in _VOID and not (tag in _STAYS and tag in tags):
                stack.append(tag + _parts(m["attributes"]))
                tags.append(tag)
        elif tag == "a" and tag not in _VOID:
            anchors += 1
            stack.append("a")
            tags.append("a")
        # other inline elements neither part nor mark a block
    if at < len(page) and not hidden:
        text(at, len(page))
    flush()
    return out


def _leaves(hidden: list[str], tag: str, end: bool, attributes: str, tags: list[str]) -> bool:
    """Keeps account of the open elements within hidden ones; whether the tag ends all of these and counts itself."""
    foreign = bool(hidden) and hidden[-1] not in _POINTS
    if end:
        if tag in hidden:
            del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
        elif (tag in tags or tag in _BREAKOUT) and _POINTS.isdisjoint(hidden):
            hidden.clear()
            return True
    elif foreign and tag in _BREAKOUT:
        while hidden and hidden[-1] not in _POINTS:
            hidden.pop()
        return not hidden
    elif foreign or tag in _HIDDEN:
        closed = attributes.endswith("/") and not _UNQUOTED.search(attributes)
        if tag == "template" and not foreign or not closed:
            hidden.append(tag)
    return False


def _parts(attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return ""
    found = [p for m in _ATTRIBUTE.finditer(attributes) for p in _PART.findall((m[1] or m[2] or m[3] or "").lower())]
    return "".join(f".{p}" for p in found)
