"""Main text of pages."""

import html
import itertools
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from ringside.llm import html_text

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Title &amp; site</title><style>p{margin:0}</style>
<script>var t="</p><p>no</p>";track(0);</script></head><body><header><div>The Site</div></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>0</p> -->
<div class="ad">Buy this very fine thing now, it is cheap and good and you want it.</div>
<div class="cookie-notice">We use cookies for everything that we do here, please agree.</div>
<article><header><h1>A  head &lt;line&gt;</h1></header><p><b>First&nbsp;words<br>of it.<p>Short.</p><p>A</p><p>One &copy; 2024 &#x41;&#66; with <a href="x">a link</a> in
 it.</p><ul><li>point</li><li><a href="/c">linked point</a></li></ul>
<div class="share-buttons"><a href="#">Share</a></div><form><p>Sign up for our letters</p><input name="q"></form>
<table><tr><td>cell one</td><td>cell two</td></tr></table><section id="comments"><p>What a nice text this is, I liked it very much.</p></section></article>
<aside>Some more things that you could read about in other places.</aside><footer>&copy; The Site &middot; all words</footer></body></html>"""

WANT = "A head <line>\n\nFirst words of it.\n\nShort.\n\nA\n\nOne © 2024 AB with a link in it.\n\npoint\n\nlinked point\n\ncell one\n\ncell two"


@pytest.fixture(scope="module")
def paths(spark):
    return html_text.fit(spark)


def test_a_page(spark, paths):
    rows = [(0, PAGE), (1, None), (2, ""), (3, "<p>"), (4, PAGE[: PAGE.index("Short.")]), (5, "<article>1 < 2 &amp &quot;a</article>"), (6, PAGE.upper()), (0, PAGE)]
    df = spark.createDataFrame([(i, h, "u", "old", "own") for i, h in rows], "page_id long, html string, url string, text string, __page string")
    got = html_text.extract(df, paths)
    assert got.columns == ["page_id", "html", "url", "__page", "text", "n_chars"] and got.filter("__page = 'own'").count() == len(rows)
    found = {(r["page_id"], r["text"], r["n_chars"]) for r in got.drop("html").collect()}
    texts = {i: t for i, t, _ in found}
    assert texts[0] == WANT and texts[1] == texts[2] == texts[3] == ""
    assert texts[4] == "A head <line>\n\nFirst words of it."
    assert texts[5] == '1 < 2 & "a'
    assert texts[6].startswith("A  HEAD".replace("  ", " "))
    assert all(n == len(t) for _, t, n in found) and got.count() == len(rows)
    assert html_text.extract(df.limit(0), paths).count() == 0


def test_pages_without_an_article(spark, paths):
    long = "Word " * 60
    page = f"<html><body><div><a href='/'>Home</a></div><div><a href='/x'>About us</a> <a href='/y'>More</a></div><div><p>{long}</p><p>{long}</p><p>{long}</p></div><div><a href='/z'>Next page</a></div></body></html>"
    got = html_text.extract(spark.createDataFrame([(page,)], "html string"), paths).first()["text"]
    assert got == "\n\n".join([long.strip()] * 3)


ARTICLE = "<article><h1>A head</h1><p>Some words of the text.</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body class='no-sidebar'>{ARTICLE}<div class='sidebar'>Other things</div></body></html>",
        f"<html class='menu'><body class='post has-comments menu'>{ARTICLE}<div>Other things</div></body></html>",
        f"<body><div class='layout with-sidebar'>{ARTICLE}<div class='sidebar'><p>Other things</p></div></div></body>",
        f"<body><div class='sidebar layout'>{ARTICLE}<p>Other things</p></div></body>",
        f"<body><div id='menu'><main>{ARTICLE}</main><p>Other things</p></div></body>",
        f"<body>{ARTICLE}<div class='sidebar'><article><p>Other things</p></article></div></body>",
        f"<body>{ARTICLE}<div id='comments'><article><p>Other things</p></article></div></body>",
        f"<body><div class='post-body'>{ARTICLE}<div class='comments'><article><p>Other things</p></article></div></div></body>",
        f"<body>{ARTICLE}<aside><article><p>Other things</p></article></aside></body>",
        f"<body>{ARTICLE}<div class='post-meta'>Other things</div></body>",
    ],
)
def test_holders_of_the_text_are_not_beside_it(spark, paths, page):
    got = html_text.extract(spark.createDataFrame([(page,)], "html string"), paths).first()["text"]
    assert got == "A head\n\nSome words of the text."


def test_names_of_a_box_below_a_headline_leave_pages_without_an_article_alone(spark, paths):
    long = ("Word " * 60).strip()
    page = f"<body><div class='post-meta'>by someone</div><div><p>{long}</p><p>{long}</p><p>{long}</p></div></body>"
    got = html_text.extract(spark.createDataFrame([(page,)], "html string"), paths).first()["text"]
    assert got.endswith("\n\n".join([long] * 3))


LONG, SHORT = ("Word " * 60).strip(), "A few words here."


@pytest.mark.parametrize(
    "page,want",
    [
        # Links: a list of them goes, a paragraph with some stays.
        (f"<article><p>{LONG}</p><ul><li><a href='1'>One two</a></li><li><a href='2'>Three four</a></li><li><a href='3'>Five</a></li></ul><p>{LONG}</p></article>", [LONG, LONG]),
        (f"<article><p>{LONG}</p><p>Read <a href='1'>this one</a> and then <a href='2'>that</a> as well.</p></article>", [LONG, "Read this one and then that as well."]),
        (f"<article><p>{LONG}</p><p><a href='1'>A whole paragraph of link</a></p><p>{LONG}</p></article>", [LONG, "A whole paragraph of link", LONG]),
        # Words: an element that may stand beside the text is text if it reads like it.
        (f"<article><p>{LONG}</p><section class='social-history'><p>{LONG}</p><p>{LONG}</p></section></article>", [LONG] * 3),
        (f"<article><p>{LONG}</p></article><div class='social-history'><p>{SHORT}</p></div>", [LONG]),
        (f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG}</p><p>{LONG}</p></div></article>", [LONG]),
        # Neighbours: long blocks in a row beside the article element are text, a single one isn't.
        (f"<article><p>{SHORT}</p></article><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", [SHORT, LONG, LONG]),
        (f"<article><p>{SHORT}</p></article><div><p>{LONG}</p></div>", [SHORT]),
        (f"<p>{SHORT}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>", [SHORT, LONG, LONG, LONG]),
        (f"<p>{SHORT}</p><p>{SHORT}</p><p>{SHORT}</p>", []),
        # What is hidden is no block.
        (f"<article><p>{LONG}</p><div hidden><p>{LONG}</p></div><p style='color:red; display: none'>{LONG}</p><p>{SHORT}</p></article>", [LONG, SHORT]),
        (f"<article><p hidden>{LONG}<p>{SHORT}</p><div style='visibility:hidden'>{LONG}<div>{LONG}</div></div><p class='hidden-gem'>{LONG}</p></article>", [SHORT, LONG]),
    ],
)
def test_words_links_and_neighbours_decide(spark, paths, page, want):
    got = html_text.extract(spark.createDataFrame([(page,)], "html string"), paths).first()["text"]
    assert got == "\n\n".join(want)


def test_every_feature_decides(paths):
    """Each feature is on some path, and the paths read the table's labels."""
    assert {f for path in paths for f, *_ in path} == set(html_text.FEATURES)
    by_hand = lambda row: any(all(row[f] <= t if low else row[f] > t for f, low, t in path) for path in paths)
    assert all(by_hand(dict(zip(html_text.FEATURES, x))) == bool(y) for y, *x in html_text.TABLE)


def test_expression_equals_brute_force(spark, paths):
    grid = itertools.product((1, 3, 9, 22, 80), (0.0, 0.3, 1.0), (0, 7, 15, 90), (0.0, 1.0), (0, 7, 90), (0.0, 0.3, 1.0), (0, 1), (0, 0.5, 1), (0, 1))
    rows = [tuple(map(float, x)) for x in grid]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in html_text.FEATURES))
    got = df.select(*html_text.FEATURES, html_text.is_text(F.struct(*html_text.FEATURES), paths).alias("text")).collect()
    assert len(got) == len(rows) and all(r["text"] == any(all(r[f] <= t if low else r[f] > t for f, low, t in path) for path in paths) for r in got)
    assert not any(r["text"] for r in got if r["side"] == 1)


class Brute(HTMLParser):
    """Blocks of a well-formed page by the standard library's parser: text, words and linked words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.run, self.links, self.off = [], [], 0, 0

    def close_block(self):
        text = " ".join("".join(t for t, _ in self.run).split())
        if text:
            self.found.append((text, sum(len(t.split()) for t, _ in self.run), sum(len(t.split()) for t, linked in self.run if linked)))
        self.run = []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")
        self.links += tag == "a"
        if tag in html_text.BLOCK:
            self.close_block()
        if tag == "br":
            self.run.append((" ", False))

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")
        self.links -= tag == "a"
        if tag in html_text.BLOCK:
            self.close_block()

    def handle_data(self, data):
        if not self.off:
            self.run.append((data, self.links > 0))


def test_blocks_equal_brute_force():
    r = random.Random(9)

    def inline():
        ws = html.escape(" ".join(r.choices(["a", "bb", "é", "<x>", "&", "c\n d", "\xa0"], k=r.randint(1, 9))))
        return r.choice([ws, f" <b>{ws}</b> ", f" <a href='/x?a=1&b=2'>{ws}</a> ", f"{ws}<br>{ws}", f"<script>if (a < b) '</p>'</script>{ws}", f"<!-- <p>{ws} -->"])

    def block(depth):
        tag = r.choice(["div", "p", "section", "article", "ul", "td", "h2", "li"])
        inner = "".join(inline() for _ in range(r.randint(0, 4))) if depth == 0 or tag in ("p", "h2", "li") else "".join(block(depth - 1) for _ in range(r.randint(0, 4)))
        return f"<{tag} class='{r.choice(['a', 'b c', 'entry'])}'>{inner}</{tag}>"

    for _ in range(300):
        page = "<html><body>" + "".join(block(3) for _ in range(3)) + "</body></html>"
        brute = Brute()
        brute.feed(page)
        brute.close()
        brute.close_block()
        got = html_text.blocks(page)
        assert [(b["text"], b["words"]) for b in got] == [(t, n) for t, n, _ in brute.found]
        for i, (b, (_, n, k)) in enumerate(zip(got, brute.found)):
            assert b["links"] == k / n
            assert b["words_after"] == (got[i + 1]["words"] if i + 1 < len(got) else 0) and b["links_before"] == (got[i - 1]["links"] if i else 0)


def test_long_bad_pages_take_linear_time():
    def seconds(n):
        pages = ["<div>" * n + "</span>" * n, "<div><span>" * n + "</td></div>" * n, "<a '" * n, "<p hidden" * n, "x " * 20 * n]
        began = time.process_time()
        for p in pages:
            html_text.blocks(p)
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 12 * max(seconds(8_000), 0.05)


def test_very_long_page(spark, paths):
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    got = html_text.extract(spark.createDataFrame([(1, page), (2, page)], "page_id long, html string"), paths).collect()
    assert all(r["text"] == "\n\n".join([LONG] * 20_000) and r["n_chars"] == len(r["text"]) for r in got)
