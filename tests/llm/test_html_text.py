"""Main text where only the text features can tell, against a plain parser and a plain walk of the tree."""

import random
import re
import time
from html.parser import HTMLParser

from tidemark.llm import html_text

from .test_operators import sentence

BLOCKS = {"p", "div", "h1", "h2", "li", "ul", "nav", "article", "footer", "body", "section"}
OUT = {"nav", "footer"}


class Plain(HTMLParser):
    """Blocks of a well-formed page: text, words, words in links, whether inside nav or footer, inside article."""

    def __init__(self):
        super().__init__()
        self.found, self.open, self.text, self.link, self.inside = [], [], "", "", False

    def cut(self):
        n = len(self.text.split())
        if n:
            out, article = not OUT.isdisjoint(self.open), "article" in self.open
            self.found.append((" ".join(self.text.split()), n, len(self.link.split()), out, article))
        self.text = self.link = ""

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
            self.open.append(tag)
        elif tag == "a":
            self.inside = True

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
            self.open.remove(tag)
        elif tag == "a":
            self.inside = False

    def handle_data(self, data):
        self.text += data
        self.link += data if self.inside else " "


def by_hand(page, tree):
    parser = Plain()
    parser.feed(page)
    kept = []
    for i, (text, n, k, out, article) in enumerate(parser.found):
        row = [n, k / n]
        for j in (i - 1, i + 1):
            row += [parser.found[j][1], parser.found[j][2] / parser.found[j][1]] if 0 <= j < len(parser.found) else [0, 0]
        at = tree
        while isinstance(at, tuple):
            at = at[2] if row[at[0]] <= at[1] else at[3]
        if not out and at >= (0.15 if article else 0.5):
            kept.append(text)
    return "\n\n".join(kept)


def random_page(r):
    def block():
        n = r.choice([1, 3, 8, 20, 60])
        text = sentence(r, n)
        if r.random() < 0.3:
            return r.choice([f"<p><a href='x'>{text}</a></p>", f"<p>{text} <a href='x'>{sentence(r, 3)}</a> &amp; so</p>"])
        return r.choice([f"<p>{text}</p>", f"<div><b>{text}</b></div>", f"<h2>{text}</h2>"])

    parts = []
    for _ in range(r.randrange(1, 7)):
        inner = "".join(block() for _ in range(r.randrange(1, 5)))
        parts.append(r.choice(["<nav>{}</nav>", "<article>{}</article>", "<footer>{}</footer>", "<div>{}</div>", "{}"]).format(inner))
    return f"<body>{''.join(parts)}</body>"


def test_main_text_is_that_of_a_plain_walk(spark):
    r, tree = random.Random(12), html_text.trained()
    pages = [random_page(r) for _ in range(400)]
    want = [by_hand(x, tree) for x in pages]
    assert 100 < sum(bool(w) for w in want) and {by_hand(x, 0.9) == w for x, w in zip(pages, want, strict=True)} == {True, False}
    df = spark.createDataFrame([(i, "u", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    assert [x.text for x in html_text.extract(df.repartition(3)).orderBy("page_id").collect()] == want


def test_text_features_alone_find_the_text():
    """Pages without a class, id, role or telling tag."""
    r, tree = random.Random(3), html_text.trained()
    for _ in range(50):
        article = [sentence(r, 8), *(sentence(r, r.choice([25, 60, 120])) for _ in range(3)), sentence(r, 4), sentence(r, 40)]
        menu = "".join(f"<li><a href='x'>{sentence(r, r.choice([1, 2]))}</a></li>" for _ in range(6))
        links = "".join(f"<div><a href='x'>{sentence(r, r.choice([2, 5, 9]))}</a></div>" for _ in range(6))
        page = f"<div><ul>{menu}</ul></div><div>{''.join(f'<p>{x}</p>' for x in article)}</div><div>{links}</div>"
        assert html_text.main_text(page, tree) == "\n\n".join(article)


def test_a_menu_before_a_long_paragraph_is_no_text():
    r, tree = random.Random(8), html_text.trained()
    long = sentence(r, 150)
    for words in (1, 3, 8):
        menu = f"<div><a href='x'>{sentence(r, words)}</a></div>"
        assert html_text.main_text(f"{menu}<p>{long}</p>", tree) == long
        assert html_text.main_text(f"{menu * 4}<p>{long}</p>{menu * 3}", tree) == long


def test_short_articles_are_whole():
    tree = html_text.trained()
    for parts in (["One"], ["A title", "Few words."], ["A", "b", "c d", "e"], ["x " * 30 + "y", "z", "a " * 9 + "b"]):
        page = f"<nav><a href='x'>Home</a></nav><article>{''.join(f'<p>{x}</p>' for x in parts)}</article><footer>me</footer>"
        assert html_text.main_text(page, tree) == "\n\n".join(parts)


def test_open_elements_neither_swallow_the_page_nor_take_long():
    tree = html_text.trained()
    text = "some words that go on for a good while in one block of text as articles do"
    for tag in ("button", "select", "svg", "object", "div", "span", "iframe"):
        assert html_text.main_text(f"<{tag}><p>{text}</p>", tree) == text, tag
    assert html_text.main_text(f"<p>{text} <button>Share</button> on</p>", tree) == f"{text} on"
    assert html_text.main_text(f"<p>{text}</p><script>var a = 1; <p>{text}</p>", tree) == text
    for page in ("<div>x</p>" * 16_000, "<button>x" * 16_000, "<a><li>" * 16_000, "<svg " * 16_000, "<p class='ad'>x" * 16_000):
        start = time.monotonic()
        html_text.main_text(page, tree)
        assert time.monotonic() - start < 4, page[:20]


def test_long_pages_are_read_whole():
    r, tree = random.Random(1), html_text.trained()
    parts = [sentence(r, 40) for _ in range(8000)]
    text = html_text.main_text("".join(f"<p>{x}</p>" for x in parts), tree)
    assert len(text) > 1 << 20 and text == "\n\n".join(parts)
    assert not re.search("<|>", text)
