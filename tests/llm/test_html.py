"""HTML extraction against a second extractor, pages whose article is known, and odd pages."""

import random
import re
import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from trustbook.llm import html

SCHEMA = "page_id long, url string, html string"


class Second(HTMLParser):
    """Another extractor, for pages with a well-formed article element: text outside of a stack of skipped elements."""

    INLINE = {"b", "i", "em", "strong", "a", "span", "code", "u", "small"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.skip, self.article = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.end()
        if tag == "article":
            self.article += 1
        if tag in ("script", "style", "nav", "footer", "aside", "form") or (tag == "div" and dict(attrs).get("class") == "ad"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.end()
        if tag == "article":
            self.article -= 1
        if tag in ("script", "style", "nav", "footer", "aside", "form") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if self.article and not self.skip:
            self.now.append(data)

    def end(self):
        text = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(self.now)).strip(" ")
        if text:
            self.blocks.append(text)
        self.now = []


def second(text):
    # an advert's div closes at its own end tag, so it goes before the parser counts
    p = Second()
    p.feed(re.sub(r'<div class="ad">[^<]*</div>', "", text or ""))
    p.close()
    p.end()
    return " ".join(p.blocks)


def extract(spark, rows):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_equals_a_second_extractor_on_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: second(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == want


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n)) + f" {rng.random():.6f}"


LAYOUTS = {
    "plain": '<body><div class="site-header"><h1><a href="/">Site name</a></h1></div><div class="main-nav"><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></div><div class="post"><h1>{title}</h1><div class="entry">{first}</div><div class="more">{second}</div></div><div class="sidebar"><p>About us</p></div><p>Published by the same people as always.</p></body>',
    "wrapped": '<body><form id="page"><div class="content has-sidebar"><h1>{title}</h1>{first}<div class="market-share">{second}</div></div></form><div class="comments"><p>Nice one, said a reader.</p></div><div class="cookie-banner">Cookies here</div></body>',
    "semantic": '<body><header><h1>Site name</h1></header><main><article><header><h1>{title}</h1><span>by someone</span></header>{first}<aside>Look here</aside><div class="post-body">{second}</div><footer>Filed under x</footer></article><article class="comment"><p>First!</p></article></main><div id="footer">Imprint</div></body>',
    "table": "<body><table><tr><td><a href=/>Home</a> <a href=/2>Two</a> <a href=/3>Three</a></td></tr><tr><td><h1>{title}</h1>{first}{second}</td></tr></table></body>",
    "sections": '<body><div id="top" role="banner">Brand</div><div id="main"><h1>{title}</h1><div id="introduction">{first}</div><div id="discussion">{second}</div></div><div role="contentinfo">2024</div></body>',
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_known_articles_come_back(spark, layout):
    rng = random.Random(layout)
    rows, want = [], {}
    for i in range(24):
        title = words(rng, 4)
        parts = [[words(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 4))] for _ in range(2)]
        first, second_ = ("".join(f"<p>{p}</p>" for p in part) for part in parts)
        rows.append((i, f"https://{layout}.example/{i}", LAYOUTS[layout].format(title=title, first=first, second=second_)))
        want[i] = " ".join([title, *parts[0], *parts[1]])
    rows += [(100 + i, *rows[0][1:]) for i in range(30)]  # copies of a page don't make its text recur
    assert extract(spark, rows) == want | {100 + i: want[0] for i in range(30)}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content has-sidebar"><p>Some text</p></div>', "Some text"),
        ('<main><p>One</p><div class="market-share"><p>Two</p></div></main>', "One Two"),
        ('<article><div class="post-header"><h1>Title</h1></div><p>Body</p></article>', "Title Body"),
        ("<article><p>x <math><mi>y</mi></math> z</p></article>", "x y z"),
        ('<article><p>t</p><script src="a"/>alert(1)</script><p>u</p></article>', "t u"),
        ('<article title="a hidden gem"><p>t</p></article><div hidden>no</div>', "t"),
        ("<p>a<!-- > --> b</p><!--> <p>c", "a b c"),
        ('<p title="a > b">t</p>', "t"),
        ("a < b &lt; c", "a < b < c"),
        ("<", "<"),
        ("<a", "<a"),
        ("</p></div></article>", ""),
        ("<script>never closed", ""),
    ],
)
def test_odd_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<div>x", '<a "', "<a b='", "<blockquote>", "</p><div>", "<span class=ad>", "<ul><li>x", "<h1>a</h1>", "<!-- ", "<p>"])
def test_long_pages_take_linear_time(piece):
    took = []
    for size in (100_000, 400_000):
        page = piece * (size // len(piece))
        began = time.process_time()
        html.main_text(page, ["none"], [0.9], [1])
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2


def test_long_pages_take_linear_memory():
    tracemalloc.start()
    html.main_text("<div>" * 200_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_repeated_rows_and_other_columns(spark):
    page = "<article><p>text</p></article>"
    rows = [(1, "http://a.example/", page, "x"), (1, "http://a.example/", page, "y"), (None, None, None, None), (2, None, page, "z"), (3, "http://a.example/", "", "")]
    out = html.extract(spark.createDataFrame(rows, SCHEMA + ", host string")).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in out) == [("1", "text"), ("1", "text"), ("2", "text"), ("3", ""), ("None", "")]
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0
