import itertools
import random
import time
from html.parser import HTMLParser

import pytest

from plantwatch.llm import html_main as h
from plantwatch.llm.queries import QUERIES
from tests.conftest import SF_DIR

PROSE = "This is a sentence of the article, which has some words in it. And another one follows it."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body class="page with-sidebar">
<header class="site-header"><a href="/">Home</a><p>Site name</p></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, and you must accept them now.</div>
<article><header><h1>Title &amp; more</h1></header><p>{PROSE}<p><b>{PROSE}</b> a&nbsp;&#8211;&nbsp;b<br>line <a href="/x">link</a>.</p><ul><li>{PROSE}</li></ul>
<div class="ad">Buy now, buy here, buy all of it today.</div><!-- <p>hidden</p> --><blockquote>{PROSE}</blockquote><p>Short.</p></article>
<aside class="sidebar"><p>{PROSE}</p></aside><div id="comments"><p>{PROSE}</p></div><form><label>Mail</label><input name="q"><button>Send</button></form>
<footer>&copy; 2024 <a href="/i">Imprint</a></footer></body></html>"""


def test_a_page():
    assert h.main_text(PAGE).split("\n") == ["Title & more", PROSE, f"{PROSE} a – b line link.", PROSE, PROSE, "Short."]


@pytest.mark.parametrize("body", [f'<div class="content">{{}}</div>', "<main>{}</main>", "{}", '<div class="post-body"><div>{}</div></div>'])
def test_other_layouts(body):
    inside = f"<h1>A headline here</h1><p>{PROSE}</p><p>{PROSE}</p>"
    page = f'<body><div id="nav"><a href="/">Home</a> <a href="/a">About us</a></div>{body.format(inside)}<div class="footer">Copyright, all rights reserved.</div></body>'
    assert h.main_text(page).split("\n") == ["A headline here", PROSE, PROSE]


@pytest.mark.parametrize("opening,closing", [
    ('<div class="layout with-sidebar"><article>', "</article></div>"), ('<div class="sidebar-layout"><article>', "</article></div>"), ('<div class="post tag-social">', "</div>"),
    ('<div class="no-comments">', "</div>"), ('<div class="menu"><main>', "</main></div>"),
])
def test_words_of_wrappers_do_not_outweigh_the_text(opening, closing):
    page = f'<body>{opening}<h1>A headline here</h1>{6 * f'<p>{PROSE}</p>'}<div class="ad">Buy now, buy here.</div>{closing}<div class="comments"><p>{PROSE}</p></div></body>'
    assert h.main_text(page).split("\n") == ["A headline here", *6 * [PROSE]]


def test_much_text_outweighs_the_words_of_its_wrapper():
    page = f'<body><div id="header-layout">{6 * f"<p>{PROSE}</p>"}</div><div class="comments"><p>{PROSE}</p></div></body>'
    assert h.main_text(page).split("\n") == 6 * [PROSE]


@pytest.mark.parametrize("tag", ["svg", "object", "select", "template", "noscript"])
def test_elements_without_an_end_tag_end_with_their_parent(tag):
    assert h.main_text(f"<article><p>{PROSE}</p><div><{tag}>lost</div><p>{PROSE}</p></article>").split("\n") == [PROSE, PROSE]
    assert h.main_text(f"<article><p>{PROSE}</p><div><{tag}>lost</div><p>{PROSE}</p><{tag}>x</{tag}></article>").split("\n") == [PROSE, PROSE]
    assert h.main_text(f"<article><p>{PROSE}</p><{tag}><p>inside</p></{tag}><p>{PROSE}</p></article>").split("\n") == [PROSE, PROSE]
    assert h.main_text(f"<{tag}>" * 20_000 + PROSE).endswith(PROSE)


def test_text_of_inline_math_stays():
    page = f"<article><p>{PROSE} So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>x=2</annotation></math> holds.</p></article>"
    assert h.main_text(page) == f"{PROSE} So x=2 holds."


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>x", "<a href='", "</p></p>", "<p title='>x", "<<<>>>", "&amp", "<td><td><tr>", "\0<p>\0", "<style><p>x</p>"])
def test_broken_pages(page):
    assert isinstance(h.main_text(page), str)


def test_long_pages_take_linear_time():
    body = "".join(f"<p>{PROSE} {k}</p><div class='ad'>ad {k}</div><div>x</div>" for k in range(5000))
    text = h.main_text(f"<article>{body}</article>")
    assert sum(line.startswith("This is") for line in text.split("\n")) == 5000 and "ad 7" not in text.split("\n")
    assert h.main_text("<div>" * 20_000 + PROSE) == PROSE
    assert h.main_text("<p>" + "<b x='" * 20_000) is not None
    assert h.main_text('<a "' * 30_000) is not None


def energy(labels, scores, edges):
    return sum(max(s, 0) if not x else max(-s, 0) for x, s in zip(labels, scores)) + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_minimum_cut_equals_enumeration():
    for seed in range(300):
        draw = random.Random(seed)
        n = draw.randrange(1, 10)
        scores = [draw.choice([-3.0, -1.0, -0.5, 0.0, 0.25, 1.0, 2.0]) for _ in range(n)]
        edges = [(i, j, draw.choice([0.2, 0.5, 1.0, 2.0])) for i in range(n) for j in range(i) if draw.random() < 0.5]
        least = min(energy(x, scores, edges) for x in itertools.product([False, True], repeat=n))
        assert abs(energy(h.minimum_cut(scores, edges), scores, edges) - least) < 1e-9


class Articles(HTMLParser):
    """The blocks inside article elements, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.lines, self.parts, self.depth = [], [], 0
        self.feed(page)
        self.close()

    def flush(self):
        if self.depth and (line := " ".join("".join(self.parts).split())):
            self.lines.append(line)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "h2", "p", "ul", "li", "div"):
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "h2", "p", "ul", "li", "div"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.parts.append(data)


def test_query_on_the_whole_table(spark):
    rows = QUERIES["op8_html_main"](spark, SF_DIR).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert len(rows) == len(pages) and {r.page_id for r in rows} == set(pages)
    for r in rows:
        assert r.text == "\n".join(Articles(pages[r.page_id].html).lines) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_the_cut_decides_labels_and_without_semantic_tags(spark):
    """Pages whose articles, menus and footers are plain div elements with other class words give the same text."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    table = h.trained(pages)
    changed = 0
    for r in pages.collect():
        blocks = h.blocks_of(r.html)
        scores, edges = h.graph_of(blocks, table)
        changed += sum((s > 0) != x for s, x in zip(scores, h.minimum_cut(scores, edges)[:len(blocks)]))
        plain = r.html.replace("<nav>", '<div id="menu">').replace("</nav>", "</div>").replace("<footer>", '<div class="foot">').replace("</footer>", "</div>")
        plain = plain.replace("<article>", '<div class="post-body">').replace("</article>", "</div>")
        assert h.main_text(plain, table) == h.main_text(r.html, table)
    assert changed > 0


def test_classifier_counts_blocks_of_known_elements(spark):
    page = f"<main><p>{PROSE}</p><p>{PROSE}</p></main><nav><a href='/'>Home</a></nav><div><p>Nothing is known of this.</p></div><div class='comments'><article><p>{PROSE}</p></article></div>"
    found = list(h.told(h.blocks_of(page)))
    assert [x for _, x in found] == [True, True, False, False] and found[0][0] == (6, 2, 0) and found[2][0][2] == 3
    table = h.trained(spark.createDataFrame([(page,), (None,), (page,)], "html string").repartition(3))
    counts = {k: 2 * [x for x in found].count(k) for k in found}
    assert table == h.log_odds(counts) and table[found[2][0]] == h.LEAST
    assert h.trained(spark.createDataFrame([], "html string")) == {}


def test_comments_that_are_articles_go():
    page = f"<body><article>{6 * f'<p>{PROSE}</p>'}</article><section id='comments'>{3 * f'<article><p>{PROSE}</p><div><p>{PROSE}</p><p>{PROSE}</p></div></article>'}</section></body>"
    assert h.main_text(page).split("\n") == 6 * [PROSE]


def test_short_blocks_follow_what_is_around_them():
    inside = f"<p>{PROSE}</p><p>So</p><p>{PROSE}</p><p>It is</p><p>{PROSE}</p>"
    assert h.score(h.blocks_of("<p>So</p>")[0]) < 0
    assert h.main_text(f"<body><div><div><a href='/'>Home</a></div><div><a href='/b'>About</a></div></div><div>{inside}</div></body>").split("\n") == [PROSE, "So", PROSE, "It is", PROSE]


def test_deep_pages_take_linear_time():
    start = time.perf_counter()
    for part in ("<div><p>Hello, this is a text.</p>", f"<div><p>{PROSE}</p><a href=x>link</a>", "<section><ul><li>x"):
        h.main_text(part * 20_000)
        h.main_text(part * 20_000 + "</p></li></ul>" * 20_000)
    assert h.main_text("<div>" * 20_000 + "</p>" * 20_000 + PROSE) == PROSE
    assert time.perf_counter() - start < 60


def test_hard_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "x", "y"), (2, None, "", "x", "y"), (2, None, "", "x", "y"), (None, "u", PAGE, "x", "y"), (4, "u", "語👍" * 50_000, "x", "y")]
    frame = spark.createDataFrame(rows, schema)
    got = h.extracted(frame).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([("1", 0), ("2", 0), ("2", 0), ("None", len(h.main_text(PAGE, h.trained(frame)))), ("4", 100_000)])
    assert h.extracted(spark.createDataFrame(rows, schema).limit(0)).count() == 0
