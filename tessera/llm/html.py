"""Main text of web pages from flat text blocks and a decision tree (operator 5)."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_ids, slices

#: A quote opens a value only after "=", and only if the page has its other end; all other quotes are plain characters.
_ATTRS = r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+)"""
_TAG = re.compile(rf"<!--|<(/?)([a-z][a-z0-9:-]*){_ATTRS}>|<[!?/][^>]*>", re.I)
#: Elements without text of their own; each goes up to its end tag.
_SILENT = frozenset("script style template noscript iframe svg math object textarea select title canvas audio video".split())
#: Where such an element ends that has no end tag: at the next block.
_BLOCK = re.compile(r"<(?=/?(?:address|article|aside|blockquote|body|center|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b)", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OFF_TAGS = frozenset("nav footer aside dialog menu fieldset button".split())
_OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
#: Words of class and id values that mark what is beside the article.
_OFF = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer footnav gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall popup promo promos promoted promotion recommended recommendations related replies reply respond search share sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
_ON = frozenset("article main content post entry story".split())
#: A word after one of these says how a page looks, not what an element is ("has-sidebar", "no-comments").
_ABOUT = frozenset("has no not with without is show hide hides shows enable enabled disable".split())
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]\S*)))?|["']""")
#: What an element says of its inside: nothing; beside the article, by its name or by its kind; the article.
NONE, NAMED, MIXED, BESIDE, ARTICLE, MAIN = range(6)
#: Words outside links, at least, that an element whose name is not all about side matters must hold to be read as
#: the article of a page that has none.
ENOUGH = 40

NAMES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "place")
#: The labelled table: a row for each block of a few hand-made pages. words, link density, those of the block
#: before, those of the block after, place (0 none, 1 beside an article, 2 in an article), 1 for main text.
LABELLED = """
1 1.0 0 0 1 1.0 1 0
1 1.0 1 1.0 1 1.0 1 0
2 1.0 1 1.0 12 0 1 0
6 0 1 1.0 11 0 1 0
30 0 6 0 40 0 1 0
60 0.1 30 0 45 0 1 0
120 0 60 0 80 0 1 0
9 0 80 0 0 0 1 0
14 0.2 45 0 0 0 1 0
3 0 150 0 0 0 1 0
5 0.6 3 0 4 0.5 1 0
25 0.9 5 0.6 30 0.8 1 0
18 0 25 0 22 0 1 0
45 0.05 120 0 60 0.1 1 0
11 0 6 0 60 0 2 1
1 0 40 0 30 0 2 1
2 0 1 0 2 0 2 1
4 0 90 0 9 0 2 1
7 0.3 30 0 40 0 2 1
12 0 1 1.0 55 0 2 1
55 0 12 0 80 0 2 1
80 0.05 55 0 120 0 2 1
150 0 80 0.05 3 0 2 1
220 0.1 150 0 14 0.2 2 1
35 0.4 60 0 50 0 2 1
1 1.0 30 0 40 0 2 1
3 1.0 50 0 60 0 2 1
10 0.9 70 0 45 0 2 1
1 1.0 1 1.0 1 1.0 0 0
2 1.0 2 1.0 3 1.0 0 0
3 1.0 2 1.0 9 0 0 0
4 0.8 3 1.0 50 0 0 0
12 0.9 60 0 10 0.9 0 0
20 0.7 12 0.9 15 0.8 0 0
2 0 1 1.0 2 1.0 0 0
4 0 3 1.0 3 1.0 0 0
5 0 2 1.0 4 0.6 0 0
3 0 90 0 2 1.0 0 0
6 0 4 0 3 1.0 0 0
8 0 3 0 0 0 0 0
5 0 0 0 1 1.0 0 0
9 0 70 0 0 0 0 0
7 0 2 1.0 45 0 0 1
9 0 4 1.0 70 0 0 1
5 0 60 0 55 0 0 1
4 0 80 0 40 0 0 1
14 0 50 0 60 0 0 1
22 0 40 0 35 0 0 1
30 0.05 9 0 50 0 0 1
45 0 7 0 60 0.1 0 1
60 0.1 45 0 22 0 0 1
75 0.2 60 0.1 4 0 0 1
90 0 5 0 80 0 0 1
140 0 90 0 3 0 0 1
200 0.3 140 0 90 0 0 1
40 0 1 1.0 1 1.0 0 1
55 0 0 0 0 0 0 1
28 0.1 30 0 9 0 0 1
"""


def _place(tag: str, attrs: str, article: bool) -> int:
    """What an element says of its inside, from its tag, role and visibility, else from the words of its class and id."""
    if tag in _OFF_TAGS or (tag == "header" and not article):
        return BESIDE
    if tag == "form":
        return MIXED  # some pages stand in one form as a whole
    found = MAIN if tag == "main" else ARTICLE if tag == "article" else NONE
    if not attrs:
        return found
    off, other, on = False, False, False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "role":
            if value.lower() in _OFF_ROLES:
                return BESIDE
            if value.lower() in ("main", "article"):
                found = max(found, MAIN if value.lower() == "main" else ARTICLE)
        elif name in ("class", "id") and tag not in ("html", "body"):
            for part in value.split():
                words = [x.lower() for x in _SPLIT.split(part) if x]
                for before, word in zip(["", *words], words, strict=False):
                    beside = word in _OFF and before not in _ABOUT and not (word == "header" and (article or found))
                    off |= beside
                    on |= word in _ON
                    other |= not beside
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return BESIDE
    if off:
        return MIXED if other or found else NAMED
    return max(found, ARTICLE) if on else found


class _Open:
    """An open element that says something of its inside; a chain up to the outermost such element."""

    def __init__(self, kind: int, up) -> None:
        self.kind, self.up, self.words = kind, up, 0
        self.settle()

    def settle(self) -> None:
        """state: 0, 1 or 2 as in blocks(). What is beside the article stays so, but for a main element in it."""
        state, self.aside = (self.up.state, self.up.aside) if self.up else (0, False)
        if self.kind in (NAMED, MIXED, BESIDE):
            state, self.aside = 1, True
        elif self.kind == MAIN:
            state, self.aside = 2, False
        elif self.kind == ARTICLE:
            state = 1 if self.aside else 2
        self.state = state


def blocks(html: str) -> list[tuple[str, int, int, int]]:
    """Text blocks in page order: (text, words, words in links, place: 0 nothing known, 1 beside the article, 2 in it)."""
    out: list[tuple[str, int, int, _Open | None]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, _Open | None]] = []  # tag, what it says, innermost open element that says something
    opens: list[_Open] = []
    open_tags: dict[str, int] = {}
    unended: set[str] = set()
    links, at = 0, 0

    def flush() -> None:
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), len(unescape(" ".join(linked)).split()), stack[-1][2] if stack else None))
            parts.clear()
            linked.clear()

    def said(text: str) -> None:
        if text:
            parts.append(text)
            if links:
                linked.append(text)

    def close(k: int) -> None:
        for tag, _, _ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    while m := _TAG.search(html, at):
        said(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] == "<!--" and (at := html.find("-->", at) + 3) == 2:
                at = len(html)
            continue
        if tag in _SILENT:
            if not m[1] and not m[3].endswith("/"):
                end = None if tag in unended else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                else:
                    unended.add(tag)  # there is none further on: no need to look again
                    at = after.start() if (after := _BLOCK.search(html, at)) else len(html)
            if parts:
                parts.append(" ")
            continue
        inside = bool(stack and stack[-1][2] and stack[-1][2].state == 2)
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            elif tag == "br":
                parts.append(" ")
            if tag in _VOID:
                continue
            if m[1]:
                if not any(t == tag and p in (NAMED, MIXED, BESIDE) for t, p, _ in stack[-1:]):
                    continue
            elif not m[3].strip() or _place(tag, m[3], inside) not in (NAMED, MIXED, BESIDE):
                continue
        flush()
        if m[1]:
            if open_tags.get(tag):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
        elif tag not in _VOID and not m[3].endswith("/"):
            if stack and stack[-1][0] == tag and tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option", "button"):
                close(len(stack) - 1)  # its end tag may be left out
            elif stack and stack[-1][0] in ("p", "button") and _BLOCK.match(m[0]):
                close(len(stack) - 1)  # neither can hold a block
            up = stack[-1][2] if stack else None
            kind = _place(tag, m[3], bool(up and up.state == 2))
            if kind:
                opens.append(up := _Open(kind, up))
            stack.append((tag, kind, up))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag not in _INLINE:
            links = 0
    said(html[at:])
    flush()
    return _resolved(out, opens)


def _resolved(rows: list[tuple[str, int, int, _Open | None]], opens: list[_Open]) -> list[tuple[str, int, int, int]]:
    """Places of blocks. Names are weak: where they leave a page without an article, the elements with most text
    outside links whose names aren't all about side matters (and forms) are taken at their text, and so on."""
    while True:
        for x in opens:  # outer ones come first
            x.settle()
        out = [(text, n, k, inner.state if inner else 0) for text, n, k, inner in rows]
        if any((p == 2 and n > k) or (p == 0 and n >= 15 and k < 0.4 * n) for _, n, k, p in out):
            return out
        for x in opens:
            x.words = 0
        for _, n, k, inner in rows:
            if inner:
                inner.words += n - k
        for x in reversed(opens):
            if x.up:
                x.up.words += x.words
        best = max((x.words for x in opens if x.kind == MIXED), default=0)
        if best < ENOUGH:
            return out
        for x in opens:
            if x.kind == MIXED and x.words > 0.9 * best:
                x.kind = NONE


def features(rows: list[tuple[str, int, int, int]]) -> np.ndarray:
    """NAMES of each block of a page; beyond the page's ends there are no words."""
    own = np.array([(w, n / w, p) for _, w, n, p in rows], float).reshape(len(rows), 3)
    pad = np.zeros((1, 3))
    before, after = np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad])
    return np.column_stack([own[:, :2], before[:, :2], after[:, :2], own[:, 2]])


@functools.lru_cache(4)
def tree(table: str = LABELLED, depth: int = 6) -> tuple:
    """A decision tree by Gini impurity: nested (feature, threshold, low, high), or a leaf's share of main text."""
    rows = np.array([[float(x) for x in line.split()] for line in table.split("\n") if line.strip()])

    def grow(own: np.ndarray, left: int):
        y = own[:, -1]
        if left == 0 or y.min() == y.max():
            return float(y.mean())
        best = None
        for f in range(own.shape[1] - 1):
            values = np.unique(own[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = own[:, f] <= cut
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, cut, low)
        if best is None:
            return float(y.mean())
        return (best[1], float(best[2]), grow(own[best[3]], left - 1), grow(own[~best[3]], left - 1))

    return grow(rows, depth)


def _main(node, row: np.ndarray) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node >= 0.5


def main_text(html: str, grown: tuple | None = None) -> str:
    """The blocks that the tree takes for main text, joined by newlines."""
    rows = blocks(html)
    if not rows:
        return ""
    grown = tree() if grown is None else grown
    return "\n".join(r[0] for r, x in zip(rows, features(rows), strict=True) if _main(grown, x))


def extract(pages: DataFrame, table: str = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) of every row's whole html, a null one as an empty one; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = tree(table)
        for part in slices(batches, "html"):
            ids, known = column_ids(part, "page_id")
            texts = [main_text(x or "", grown) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), part.column("url").combine_chunks(), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
