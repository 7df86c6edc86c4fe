"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block of the page. A line weighs as much as its text, and only ``LITTLE`` of
that if it belongs to what surrounds an article (menus, headers, footers, sidebars, notices, adverts, forms,
comments) or is mostly links. The weights are summed over sliding windows of ``WINDOW`` lines: where a sum rises to
``LEVEL`` of the page's largest one a stretch begins (surge), where it falls below that again the stretch ends
(dive). The stretch with the most text shows where the article is: the innermost element that holds most of it is the
article's container. Kept are the lines of the container and those of the stretch around it, but for lines that surround, other
articles' teasers, and link lists that no heading or article introduces.

A tag or class name alone decides nothing: the mark of a form, header, sidebar or class is dropped if hardly any running text
is dense outside of all marks compared with that inside (a page within one form; a layout named after its sidebar).

Defined cases: null and empty pages, and pages without text, have the empty text; markup left open runs
to the end of the page; of stretches with equally much text the first is taken; very long pages are read whole; repeated rows are
read each on its own; a column that has the name of the result is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
#: Share of the page's largest window at which a stretch begins and ends.
LEVEL = 0.05
#: Weight of a character in lines that surround an article or are mostly links.
LITTLE = 0.02
#: Share of a stretch that its container holds at least.
SHARE = 0.7
#: A mark is dropped if no window outside of marks has this share of the largest window inside.
OUTSIDE = 0.25
_MOSTLY_LINKS = 0.6
_UNSEEN = "script|style|noscript|template|svg|textarea|select|iframe|object|canvas|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_UNSEEN})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*+)>|<[!?][^>]*(?:>|\Z)|[^<]+|<""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND = frozenset("nav header footer aside form menu button dialog label input".split())
#: Marks that stand whatever the page's text: none of these ever holds an article.
_ALWAYS = frozenset("nav footer menu button dialog label input".split())
# Words that name what surrounds an article, and words that go with them in a name.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side foot footer head header masthead topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter "
    "subscribe subscription signup login search share sharing social related recommended widget widgets toolbar pagination "
    "pager copyright legal disclaimer complementary contentinfo".split()
)
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
_WITH_NAMES = frozenset(
    "wrapper wrap container box area list section block inner outer item items link links button buttons bar slot unit top bottom left right "
    "main site page global primary secondary body content post posts stories articles form text thread reader user the id".split()
)
_SPLIT = re.compile(r"[-_]+|\d+|(?<=[a-z])(?=[A-Z])")
_WITHIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a text; all others contain texts.
_PARTS = frozenset("address blockquote caption center dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr legend li ol p pre section summary ul".split())


def named_around(names: str) -> str:
    """"comments", "around" or "" by the class names, id or role of an element.

    Each word of a name must be known: "page-header" is one, "has-header" and "no-sidebar" are not.
    """
    for name in names.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if words and all(w in _NAMES or w in _COMMENTS or w in _WITH_NAMES for w in words):
            if any(w in _COMMENTS for w in words):
                return "comments"
            if any(w in _NAMES for w in words):
                return "around"
    return ""


class Element(NamedTuple):
    tag: str
    outside: int  # number of the element around it, -1 for the page
    mark: int  # 0 none, 1 may surround an article, 2 surrounds it
    container: int  # itself, or the innermost container around it
    article: int  # innermost article or main part, -1 for none


class Line(NamedTuple):
    text: str
    element: int
    linked: int  # length of its links


def lines_of(html: str) -> tuple[list[Line], list[Element]]:
    """Lines of a page, and its elements; the first element is the page."""
    lines: list[Line] = []
    elements = [Element("html", -1, 0, 0, -1)]
    open_ones = [0]
    pieces: list[str] = []
    links = linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            lines.append(Line(text, open_ones[-1], linked))
        pieces.clear()
        linked = 0

    for token in _TOKEN.finditer(html):
        said = token.group(0)
        name = token.group(3)
        if name is None:
            if said[0] != "<" or said == "<":
                pieces.append(said)
                if links:
                    linked += len(said.strip())
            continue
        name = name.lower()
        if name == "a":
            links = 0 if token.group(2) else 1
            continue
        if name not in BLOCKS and name not in AROUND:
            if name == "br" or name == "img":
                pieces.append(" ")
            continue
        close()
        links = 0
        if name in _VOID:
            continue
        if token.group(2):
            for k in range(len(open_ones) - 1, 0, -1):
                if elements[open_ones[k]].tag == name:
                    del open_ones[k:]
                    break
            continue
        last = elements[open_ones[-1]].tag
        if last == "p" and name in BLOCKS or last == name == "li":
            open_ones.pop()
        outside = elements[open_ones[-1]]
        marks = token.group(4)
        named = named_around(" ".join("".join(x) for x in _NAMED.findall(marks))) if marks and name not in ("body", "html") and name not in _WITHIN else ""
        # A heading inside an article belongs to it.
        mark = 2 if name in _ALWAYS or named == "comments" else 1 if named or (name in AROUND and not (name == "header" and outside.article >= 0)) else 0
        me = len(elements)
        elements.append(Element(
            name, open_ones[-1], mark, outside.container if name in _PARTS else me,
            me if name in _WITHIN else outside.article,
        ))
        open_ones.append(me)
    close()
    return lines, elements


def windows(weights: np.ndarray) -> np.ndarray:
    """Sum over the window that begins at each line."""
    return np.convolve(weights, np.ones(WINDOW))[WINDOW - 1 :]


def surrounding(lines: list[Line], elements: list[Element], prose: np.ndarray) -> np.ndarray:
    """Which lines surround an article: marks that hold the page's dense text against all else are dropped one by one."""
    dropped: set[int] = set()
    at = np.array([x.element for x in lines])
    spans: list[tuple[int, int] | None] = [None] * len(elements)  # first and last line
    for k, e in enumerate(at):
        spans[e] = (spans[e][0] if spans[e] else k, k)
    for e in range(len(elements) - 1, 0, -1):
        up = elements[e].outside
        if spans[e]:
            spans[up] = (min(spans[e][0], spans[up][0]), max(spans[e][1], spans[up][1])) if spans[up] else spans[e]
    while True:
        outermost = [-1] * len(elements)  # marked elements
        for e in range(1, len(elements)):
            up = outermost[elements[e].outside]
            outermost[e] = e if up < 0 and elements[e].mark and e not in dropped else up
        by = np.array(outermost)[at]
        free = windows(np.where(by < 0, prose, 0.0)).max()
        # The lines of an element follow each other.
        starts = np.flatnonzero(np.diff(by, prepend=-2))
        peaks = [
            (windows(prose[i:j]).max(), -by[i]) for i, j in zip(starts, [*starts[1:], len(by)], strict=True) if by[i] >= 0 and elements[by[i]].mark == 1
        ]
        most, e = max(peaks, default=(0.0, 0))
        if not most or free >= OUTSIDE * most:
            return by >= 0
        # With it those inside it that hold the same lines.
        dropped.update(x for x in range(-e, len(elements)) if elements[x].mark == 1 and spans[x] == spans[-e])


def main_text(html: str | None) -> str:
    lines, elements = lines_of(html or "")
    if not lines:
        return ""
    length = np.array([len(x.text) for x in lines], float)
    in_links = np.array([x.linked for x in lines]) > _MOSTLY_LINKS * length
    prose = np.where(in_links, 0.0, length)
    around = surrounding(lines, elements, prose)
    if around.all():
        return ""
    weights = np.where(around | in_links, LITTLE * length, length)
    sums = windows(weights)
    dense = sums >= LEVEL * sums.max()
    surges = np.flatnonzero(dense & ~np.concatenate([[False], dense[:-1]]))
    dives = np.minimum(np.flatnonzero(dense & ~np.concatenate([dense[1:], [False]])) + WINDOW, len(lines))
    totals = np.concatenate([[0.0], np.cumsum(np.where(around, 0.0, weights))])
    best = int((totals[dives] - totals[surges]).argmax())
    begin, end = int(surges[best]), int(dives[best])

    # The innermost container with most of the stretch.
    held: dict[int, float] = {}
    for k in range(begin, end):
        if not around[k]:
            at = elements[lines[k].element].container
            held[at] = held.get(at, 0.0) + weights[k]
    for at in sorted(held, reverse=True):  # from the inside out, as elements are numbered from the outside in
        at = elements[at].outside
        while at >= 0 and at not in held:
            held[at] = 0.0
            at = elements[at].outside
    for at in sorted(held, reverse=True):
        if elements[at].outside >= 0:
            held[elements[at].outside] += held[at]
    main = max(at for at, weight in held.items() if weight >= SHARE * held[0] and elements[at].container == at)
    article = elements[main].article
    scope = article if article >= 0 else main
    whole = elements[scope].tag in ("html", "body")

    inside = {scope: True, 0: scope == 0}
    within_main = {main: True, 0: main == 0}

    def lies_in(e: int, known: dict[int, bool]) -> bool:
        path = []
        while e not in known:
            path.append(e)
            e = elements[e].outside
        known.update((x, known[e]) for x in path)
        return known[e]

    near = np.zeros(len(lines), bool)  # lines of dense windows
    for i, j in zip(surges, dives, strict=True):
        near[i:j] = True
    keep = np.zeros(len(lines), bool)
    listed = []
    headed = False
    for k, line in enumerate(lines):
        e = elements[line.element]
        if around[k]:
            headed = False
            continue
        in_scope = lies_in(line.element, inside)
        teaser = e.article != article and not lies_in(line.element, within_main) and e.article >= 0
        if teaser or not (in_scope or (article < 0 and begin <= k < end)):
            headed = False
        elif not in_links[k]:
            headed = e.tag in _HEADINGS
            keep[k] = not whole or near[k] or elements[e.container].tag in ("html", "body")
        elif article >= 0 and in_scope:
            keep[k] = True
        elif in_scope:
            in_list = e.tag == "li" or elements[e.outside].tag == "li"
            headed = headed and in_list
            keep[k] = headed
            if not in_list:
                listed.append(k)
    if keep.any():  # paragraphs of links between the article's lines
        first, last = np.flatnonzero(keep)[[0, -1]]
        keep[[k for k in listed if first < k < last]] = True
    return "\n\n".join(x.text for x, wanted in zip(lines, keep, strict=True) if wanted)


def extracted(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text of each in the new column ``to``."""
    if to.lower() in (c.lower() for c in pages.columns):
        raise ValueError(f"pages have a column {to!r}; name another for the result")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.withColumn(to, run(F.col(html).cast("string")))
