"""Main text of a web page from flat text blocks.

A page is cut at block-level tags into blocks of text in page order. A block is described by six numbers: its words
and the share of them in links, and the same of the block before and after. A decision tree (CART on Gini impurity),
trained on the small labelled table below, gives the share of kept rows among those like it (smoothed, so that few
rows say less). The block is kept if that share reaches `NEEDED`, which is lower inside an article or main container
and higher inside one whose class only mentions boilerplate.

What the markup itself sets apart is no candidate: blocks in nav, header, footer, aside, form and the like, in hidden
elements, and in elements whose class, id or role is or ends in a word such as sidebar, comments or ad. Adverts and
comments are prose like any other, so no text feature could tell them. An article container clears what containers
around it say, unless they are hidden.

Markup, scripts, styles, comments and the head are never text. Character references are decoded after the tags are
cut out, white space in a block becomes one space, kept blocks are joined by an empty line. Time grows with the page
alone, whatever tags are left open.

Nulls and edges: null html is an empty page with empty text; malformed tags that do not close are text; an open
script, style, textarea or title reaches to the end of the page, other open elements do not; each page row gives one
row, equal ids included; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: Elements of raw text, to the end of the page if they are left open.
_RAW = {"script", "style", "textarea", "title"}
#: Elements without text of the page, cut out if they are closed before another one opens.
_CUT = {"noscript", "template", "iframe", "svg", "select", "button", "object", "canvas"}
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp"
    " small source span strike strong sub sup time tt u var wbr".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "head", "dialog"}
_ARTICLE_TAGS = {"article", "main"}
_BOILER = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies copyright disclaimer discussion footer form gdpr header login masthead menu modal nav navbar navigation"
    " newsletter notice notices pager pagination popup promo promoted related recommended replies reply search share"
    " sharing sidebar signup skip social sponsor sponsored subscribe tags toc toolbar widget widgets responses"
    " alert".split()
)
_ARTICLE = set("article articlebody content entry post story main".split())

#: words, link share, words before, link share before, words after, link share after: keep
TABLE = """
1 1.0 0 0.0 1 1.0 0
1 1.0 1 1.0 1 1.0 0
2 1.0 1 1.0 2 1.0 0
2 1.0 2 1.0 3 1.0 0
3 1.0 1 1.0 1 1.0 0
1 1.0 0 0.0 60 0.0 0
1 1.0 1 1.0 12 0.0 0
2 1.0 1 1.0 30 0.0 0
2 1.0 3 1.0 90 0.0 0
1 1.0 2 1.0 200 0.0 0
3 1.0 2 1.0 7 0.0 0
8 1.0 0 0.0 150 0.0 0
6 1.0 5 1.0 60 0.0 0
10 1.0 4 1.0 90 0.0 0
12 1.0 0 0.0 70 0.0 0
5 1.0 6 1.0 100 0.0 0
5 1.0 4 1.0 6 1.0 0
8 1.0 7 1.0 9 1.0 0
7 1.0 60 0.0 8 1.0 0
6 1.0 90 0.0 0 0.0 0
3 1.0 40 0.0 2 1.0 0
2 1.0 25 0.0 3 1.0 0
9 1.0 8 1.0 0 0.0 0
12 0.9 10 1.0 11 0.9 0
4 1.0 3 0.0 5 1.0 0
3 0.7 80 0.0 2 1.0 0
6 0.8 5 0.9 4 0.9 0
4 0.5 3 1.0 5 0.7 0
40 0.8 6 1.0 30 0.9 0
35 0.6 3 1.0 4 1.0 0
50 0.7 60 0.0 4 1.0 0
25 0.9 2 0.0 3 0.5 0
5 0.6 4 0.0 6 0.0 0
4 0.4 3 0.5 2 0.5 0
7 0.4 9 1.0 2 1.0 0
3 1.0 60 0.0 50 0.0 0
5 1.0 40 0.0 70 0.0 0
4 1.0 60 0.0 50 0.0 1
12 0.9 40 0.0 45 0.0 1
9 0.4 50 0.0 60 0.0 1
5 0.0 2 1.0 2 1.0 0
3 0.0 1 1.0 1 1.0 0
2 0.0 3 1.0 2 1.0 0
3 0.0 1 1.0 0 0.0 0
7 0.0 3 1.0 4 0.8 0
8 0.0 2 1.0 3 0.0 0
4 0.0 1 1.0 5 0.0 0
10 0.0 4 1.0 0 0.0 0
6 0.0 5 0.0 0 0.0 0
4 0.0 6 0.0 5 0.0 0
3 0.0 2 0.0 4 0.0 0
2 0.0 5 0.0 1 0.0 0
8 0.0 4 0.0 3 0.0 0
5 0.0 0 0.0 6 0.0 0
4 0.0 0 0.0 0 0.0 0
3 0.0 9 0.0 2 1.0 0
9 0.0 8 0.0 9 0.0 1
4 0.0 3 0.0 5 0.0 1
2 0.0 1 1.0 3 0.0 1
6 0.0 2 1.0 4 0.0 1
4 0.0 6 0.0 0 0.0 1
3 0.0 7 0.0 2 0.0 1
2 0.0 4 0.0 1 0.0 1
6 0.0 1 1.0 0 0.0 1
1 0.0 1 0.0 1 0.0 1
12 0.0 9 0.0 0 0.0 1
6 0.0 2 1.0 3 0.6 1
8 0.0 1 1.0 2 1.0 1
1 0.0 2 0.0 1 0.0 0
2 0.0 3 0.0 2 0.0 0
1 0.0 0 0.0 3 0.0 0
2 0.0 2 0.0 5 0.0 0
20 0.0 0 0.0 0 0.0 1
14 0.0 3 1.0 15 0.0 1
8 0.0 1 1.0 60 0.0 1
6 0.0 3 1.0 70 0.0 1
11 0.0 2 1.0 40 0.0 1
3 0.0 2 1.0 150 0.0 1
14 0.0 1 1.0 30 0.1 1
5 0.0 4 0.0 80 0.0 1
3 0.0 8 0.0 90 0.0 1
9 0.0 0 0.0 60 0.0 1
7 0.0 12 0.0 45 0.0 1
2 0.0 10 0.0 35 0.2 1
1 0.0 100 0.0 90 0.0 1
3 0.0 45 0.0 40 0.0 1
5 0.0 50 0.0 60 0.0 1
8 0.1 60 0.0 20 0.0 1
2 0.0 30 0.0 25 0.0 1
4 0.0 70 0.0 6 0.0 1
6 0.0 60 0.0 3 0.0 1
10 0.0 35 0.0 5 0.0 1
3 0.0 60 0.0 0 0.0 1
6 0.0 20 0.0 12 1.0 1
2 0.0 80 0.0 2 1.0 1
9 0.0 50 0.0 8 1.0 1
4 0.0 40 0.0 1 1.0 0
5 0.0 90 0.0 3 1.0 0
25 0.0 30 0.0 40 0.0 1
18 0.1 40 0.0 25 0.0 1
60 0.0 3 1.0 55 0.0 1
80 0.1 6 0.0 2 1.0 1
200 0.0 0 0.0 0 0.0 1
300 0.0 2 0.0 10 0.0 1
150 0.05 60 0.0 20 0.0 1
30 0.3 60 0.1 20 0.0 1
40 0.0 9 0.0 80 0.0 1
90 0.0 100 0.0 90 0.0 1
45 0.0 6 0.0 0 0.0 1
33 0.0 5 0.0 4 0.0 1
50 0.0 20 0.0 3 1.0 1
40 0.0 30 0.0 0 0.0 1
28 0.2 2 1.0 2 1.0 1
60 0.0 1 1.0 1 1.0 1
70 0.25 50 0.2 40 0.3 1
"""
LEAST = 3  # rows of a leaf
DEPTH = 6
#: The share of kept rows that a block needs: inside an article, elsewhere, where a class only mentions boilerplate.
NEEDED = {"article": 0.15, "none": 0.5, "weak": 0.75}
WEAK, SURE, HIDDEN = 0.5, 1.0, 2.0


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A tree of (feature, cut, low, high), or the smoothed share of kept rows at a leaf."""
    leaf = float((y.sum() + 1) / (len(y) + 2))
    best = None
    if depth and len(set(y)) > 1:
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[:, k] <= cut
                if min(low.sum(), (~low).sum()) < LEAST:
                    continue
                cost = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
                if best is None or cost < best[0] - 1e-12:
                    best = cost, k, float(cut), low
    if best is None:
        return leaf
    _, k, cut, low = best
    return k, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def trained():
    rows = np.array([row.split() for row in TABLE.strip().splitlines()], dtype=float)
    return grow(rows[:, :-1], rows[:, -1])


def share_kept(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


_MODIFIERS = {"has", "no", "not", "with", "without", "is", "hide", "hides", "show", "shows"}


def _boiler(token: str) -> float:
    """How surely one class, id or role says boilerplate: by its last word, or weakly by another."""
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token.split("--")[0]).lower())
    if not parts or not _MODIFIERS.isdisjoint(parts[:-1]):
        return 0.0
    return SURE if parts[-1] in _BOILER else WEAK if not _BOILER.isdisjoint(parts) else 0.0


def _hints(tag: str, attrs: str) -> tuple[float, bool]:
    boiler, article = SURE * (tag in _BOILER_TAGS), tag in _ARTICLE_TAGS
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            if name.lower() in ("class", "id", "role"):
                parts = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
                boiler = max([boiler, *map(_boiler, value.strip("\"'").split())])
                article |= not parts.isdisjoint(_ARTICLE)
            elif name.lower() == "style" and re.search(r"display\s*:\s*none", value):
                boiler = HIDDEN
        bare = re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)
        boiler = max(boiler, HIDDEN * bool(re.search(r"(?<![\w-])hidden(?![\w=-])", bare)))
    return boiler, article


def _within(up: tuple[float, bool], tag: str, boiler: float, article: bool) -> tuple[float, bool]:
    """The hints in a container: an article's own outranks what is said farther out, by a class only if that is weak."""
    farther = up[0]
    if article and not boiler and farther <= (SURE if tag in _ARTICLE_TAGS else WEAK):
        farther = 0.0
    return max(boiler, farther), article or up[1]


class _Open:
    """The open containers with the hints in each; a count a tag tells whether one is open at all."""

    def __init__(self):
        self.tags, self.hints, self.count = [], [(0.0, False)], Counter()

    def push(self, tag: str, boiler: float, article: bool):
        self.tags.append(tag)
        self.hints.append(_within(self.hints[-1], tag, boiler, article))
        self.count[tag] += 1

    def pop(self, tag: str) -> bool:
        """Close the nearest of this tag and all inside it."""
        if not self.count[tag]:
            return False
        while True:
            last = self.tags.pop()
            self.hints.pop()
            self.count[last] -= 1
            if last == tag:
                return True


def _after(page: str, tag: str, at: int) -> int | None:
    """Where an element without text ends; None if it stays open or another one opens first."""
    if tag in _RAW:
        past = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
        return past.end() if past else len(page)
    past = re.compile(rf"<(/?){tag}\b[^<>]*>", re.I).search(page, at)
    return past.end() if past and past[1] else None


def blocks(page: str) -> list[tuple[str, int, int, float, bool]]:
    """In page order: text, words, words in links, boilerplate hint, article hint."""
    out, around, link = [], _Open(), False
    plain, linked = [], []

    def close():
        text = " ".join("".join(plain).split())
        if text:
            n = len(text.split())
            boiler, article = around.hints[-1]
            out.append((text, n, min(n, len("".join(linked).split())), min(SURE, boiler), article))
        plain.clear()
        linked.clear()

    def put(raw: str):
        text = entities.unescape(raw)
        plain.append(text)
        linked.append(text if link else " ")

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in _RAW or tag in _CUT:
            if not closing and not attrs.endswith("/"):
                at = _after(page, tag, at) or at
            plain.append(" ")
        elif tag == "a":
            link = not closing
        elif tag == "br":
            plain.append(" ")
            linked.append(" ")
        elif tag in _INLINE:
            if closing:
                if around.tags and around.tags[-1] == tag:
                    close()
                    around.pop(tag)
            elif tag not in _VOID and (boiler := _hints(tag, attrs)[0]) >= SURE:
                close()  # an inline advert or notice stands apart
                around.push(tag, boiler, False)
        else:
            close()
            if closing:
                if around.pop(tag):
                    link = False
            elif tag in ("p", "li", "td", "dd") and attrs and (boiler := _hints(tag, attrs)[0]):
                around.push(tag, boiler, False)
            elif tag in ("p", "li", "td", "dd"):
                if around.tags and around.tags[-1] == tag:
                    around.pop(tag)  # a new one ends the open one
            elif tag not in _VOID and tag not in ("th", "tr", "dt", "html"):
                boiler, article = _hints(tag, attrs)
                around.push(tag, 0.0 if tag == "body" else boiler, article)
    close()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    rows = [(0, 0.0), *((n, k / n) for _, n, k, _, _ in found), (0, 0.0)]
    kept = []
    for i, (text, _, _, boiler, article) in enumerate(found):
        needed = NEEDED["weak" if boiler else "article" if article else "none"]
        if boiler < SURE and share_kept(tree, (*rows[i + 1], *rows[i], *rows[i + 2])) >= needed:
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each page row."""
    tree = trained()
    names = ["page_id", "url", "text", "n_chars"]
    schema = pages.select("page_id", "url").schema.add("text", "string", False).add("n_chars", "long", False)

    def run(batches):
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, schema)


def op6_block_tree_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
