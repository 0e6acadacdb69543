"""Operator 8: main text of web pages.

The standard library's streaming parser turns a page into lines: a line is the
text between two block-level tags, with the elements its pieces stand in, the tags
inside and how much of it is links. A line's text-to-tag ratio is its characters
outside links per tag; ratios are smoothed with a Gaussian along the page, and
lines at or above the threshold (one standard deviation, as long as some line
reaches it) cluster into content regions.

The regions select the text. If all content lines stand in an ``article`` or
``main``, the innermost that holds them all is the article (if several hold them
together, all of these are), and every line inside is returned, however short.
Else the innermost element that holds all content is taken, and of its lines those
from the first content line to the last, with the headings right above: menus and
notices that no markup names stay outside, and inside the span only runs of lines
that are nothing but links go.

Boilerplate elements (by element, by role, or by an id or class token that
consists of ``CLASS_WORDS`` and ``BOX_WORDS`` alone) are cut out, inside a line
too. A token with another word in it names no boilerplate ("with-sidebar",
"social-science"), a heading's own id names nothing, and a box named by a token that
holds most of the page's text and its every ``h1``, ``article`` and ``main`` is a
wrapper, not boilerplate. An ``article`` inside boilerplate (a comment, a teaser)
is boilerplate, unless that element is never closed, or nothing else is left.

Character references are decoded; white space inside a block becomes one space;
blocks are joined by one space in page order. Unclosed paragraphs, items and
inline tags are closed by the next block.

Defined cases: a null or empty page, or one without content, has the empty text;
text outside any element counts as the page's; a page of any length is parsed
whole; repeated rows are parsed row by row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.llm.base import bounded_batches, map_by_id

SIGMA, RADIUS = 1.0, 3

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table
tbody td tfoot th thead title tr ul""".split())
# Elements whose text is never part of an article.
UNSEEN = set("script style noscript template head title iframe object svg canvas audio video math".split())
BOILERPLATE = set("nav footer aside form button select textarea option dialog menu label".split())
PAGE_HEADER = "header"      # boilerplate unless it stands in an article
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLASS_WORDS = set("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent
notice notices alert popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond
disqus share sharing social related recommended newsletter subscribe signup login widget pagination pager""".split())
# ... and what may stand beside them in the name of a box.
BOX_WORDS = set("""box bar button buttons container wrapper wrap slot unit block posts post links link list item items area
section site page top bottom left right main global inner panel form strip rail""".split())
WRAPPER_SHARE = 0.5         # of the page's text in a box that is then a wrapper
LINK_LINES = 3              # so many lines of links alone in a row are a menu
NOTICE = re.compile(r"(©|\(c\)\s|copyright\b|all rights reserved)", re.I)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# A new one of these ends an open one of the same kind.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# ... but not across these.
HOLDS = set("article aside body div section main table ul ol dl td th blockquote form nav footer header".split())

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An open or closed element: what boilerplate it is ("" none, "box" by a name,
    "element" by itself) and whether its own end tag came."""

    __slots__ = ("tag", "number", "parent", "kind", "closed", "hidden")

    def __init__(self, tag, number, parent, kind):
        self.tag, self.number, self.parent, self.kind, self.closed, self.hidden = tag, number, parent, kind, False, False

    def path(self) -> list[Element]:
        """From the outermost element to this one."""
        out, e = [], self
        while e is not None:
            out.append(e)
            e = e.parent
        return out[::-1]


class Lines(HTMLParser):
    """Collects the lines of one page: pieces (text, element, in a link), the tags
    inside and the element the line stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.elements: list[Element] = []
        self.links = 0
        self.pieces: list[tuple[str, Element | None, bool]] = []
        self.tags = 0
        self.lines: list[tuple[list, int, Element | None]] = []

    def cut(self) -> None:
        if any(not text.isspace() for text, _, _ in self.pieces):
            self.lines.append((self.pieces, self.tags, self.stack[-1] if self.stack else None))
        self.pieces, self.tags = [], 0

    def boilerplate(self, tag: str, attrs) -> str:
        if tag in UNSEEN or tag in BOILERPLATE:
            return "element"
        if tag == PAGE_HEADER and not any(e.tag in ("article", "main") for e in self.stack):
            return "element"
        if tag in ("html", "body", "main"):
            return ""
        for name, value in attrs:
            if value and name == "role" and value.lower() in ROLES:
                return "box"
            if value and name in ("class", "id") and not (name == "id" and tag in HEADINGS):
                for token in value.split():
                    words = {w.lower() for w in _WORD.findall(token)}
                    if not CLASS_WORDS.isdisjoint(words) and words <= CLASS_WORDS | BOX_WORDS:
                        return "box"
        return ""

    def shut(self, i: int) -> None:
        self.links -= sum(e.tag == "a" for e in self.stack[i:])
        del self.stack[i:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        elif tag == "br":
            self.pieces.append((" ", self.stack[-1] if self.stack else None, False))
        if tag in VOID:
            return
        # any block ends an open paragraph
        ends = SELF_ENDING.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in ends:
                self.shut(i)
                break
            if self.stack[i].tag in HOLDS:
                break
        e = Element(tag, len(self.elements), self.stack[-1] if self.stack else None, self.boilerplate(tag, attrs))
        self.elements.append(e)
        self.stack.append(e)
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("article", "main"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.stack[i].closed = True
                self.shut(i)
                return
            if self.stack[i].tag in HOLDS and tag not in BLOCK:
                return      # a stray inline end tag closes no block

    def handle_data(self, data):
        self.pieces.append((data, self.stack[-1] if self.stack else None, self.links > 0))


def hide(page: Lines) -> None:
    """Mark the elements whose text is boilerplate."""
    size, marks = np.zeros(len(page.elements), np.int64), np.zeros(len(page.elements), np.int64)
    for pieces, _, _ in page.lines:
        for text, e, _ in pieces:
            if e is not None and e.tag not in UNSEEN:
                size[e.number] += len(text)
    for e in reversed(page.elements):       # children come after their parents
        marks[e.number] += e.tag in ("h1", "article", "main") and not e.kind
        if e.parent is not None:
            size[e.parent.number] += size[e.number]
            marks[e.parent.number] += marks[e.number]
    total = max(sum(len(t) for pieces, _, _ in page.lines for t, e, _ in pieces if e is None or e.tag not in UNSEEN), 1)
    every = sum(e.tag in ("h1", "article", "main") and not e.kind for e in page.elements)
    causes: dict[int, list[Element]] = {}
    for e in page.elements:
        above = causes.get(e.parent.number, []) if e.parent is not None else []
        if e.tag in ("article", "main") and not any(c.closed for c in above):
            above = []
        wrapper = e.kind == "box" and marks[e.number] == every > 0 and size[e.number] >= WRAPPER_SHARE * total
        causes[e.number] = above + [e] if e.kind and not wrapper else above
        e.hidden = bool(causes[e.number])


def visible(page: Lines) -> list[tuple[str, int, int, Element | None]]:
    """(text, characters outside links, tags, element) of each line, without what is
    hidden."""
    out = []
    for pieces, tags, e in page.lines:
        shown = [(t, link) for t, at, link in pieces if at is None or not at.hidden]
        text = " ".join("".join(t for t, _ in shown).split())
        if text:
            free = len(" ".join("".join(" " if link else t for t, link in shown).split()))
            out.append((text, free, tags, e))
    return out


def content(lines) -> np.ndarray:
    """Which lines form content regions."""
    ratio = np.array([free / max(tags, 1) for _, free, tags, _ in lines], float)
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-x**2 / (2 * SIGMA**2))
    smooth = np.convolve(ratio, kernel / kernel.sum())[RADIUS:RADIUS + len(ratio)]
    chosen = (smooth >= smooth.std()) & (ratio > 0)
    return chosen if chosen.any() else np.ones(len(ratio), bool)


def shared(paths: list) -> list:
    """The elements that stand in every path: an element's ancestors never change,
    so they are what the first and the last path in order begin with."""
    return [a for a, _ in itertools.takewhile(lambda e: e[0] is e[1], zip(min(paths, key=_numbers), max(paths, key=_numbers), strict=False))]


def _numbers(path: list) -> list[int]:
    return [e.number for e in path]


def span(lines, chosen: np.ndarray) -> list[int]:
    """The lines from the first content line to the last and the headings right
    above, less runs of lines that are links alone; notices at the ends go."""
    at = np.flatnonzero(chosen)
    lo, hi = int(at[0]), int(at[-1])
    while lo < hi and NOTICE.match(lines[lo][0]):
        lo += 1
    while hi > lo and NOTICE.match(lines[hi][0]):
        hi -= 1
    while lo > 0 and any(e.tag in HEADINGS for e in (lines[lo - 1][3].path() if lines[lo - 1][3] else [])):
        lo -= 1
    out, run = [], []
    for i in range(lo, hi + 2):
        if i <= hi and lines[i][1] == 0:
            run.append(i)
            continue
        out += run if len(run) < LINK_LINES else []
        run = []
        if i <= hi:
            out.append(i)
    return out


def main_text(html: str | None) -> str:
    """The article's text."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.cut()
    hide(page)
    lines = visible(page)
    if not lines:
        # nothing but boilerplate: an article inside it after all
        for e in page.elements:
            e.hidden = e.tag in UNSEEN or not any(x.tag in ("article", "main") for x in e.path())
        lines = [x for x in visible(page) if x[3] is not None and not x[3].hidden]
        if not lines:
            return ""
    chosen = content(lines)
    paths = [e.path() if e is not None else [] for _, _, _, e in lines]
    of_content = [path for path, is_content in zip(paths, chosen, strict=True) if is_content]
    named = [[e for e in path if e.tag in ("article", "main")] for path in of_content]
    if all(named):
        inside = {e.number for e in shared(named)[-1:]} or {path[0].number for path in named}
        return " ".join(x[0] for x, path in zip(lines, paths, strict=True) if not inside.isdisjoint(_numbers(path)))
    within = [e for e in shared(of_content) if e.tag in HOLDS][-1:]
    keep = [i for i, path in enumerate(paths) if not within or within[0] in path]
    lines, chosen = [lines[i] for i in keep], chosen[keep]
    return " ".join(lines[i][0] for i in span(lines, chosen))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].to_numpy(object), "url": b["url"].to_numpy(object), "text": text, "n_chars": [len(t) for t in text]})

    return map_by_id(pages.select("page_id", "url", "html"), run, "url string, text string, n_chars long", "page_id")
