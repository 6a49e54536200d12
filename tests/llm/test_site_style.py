import re
import time
from collections import Counter
from html import unescape

import pytest

from tickloom.llm import site_style
from tickloom.llm.queries import QUERIES
from tickloom.llm.site_style import Page, main_texts, visible_text

SF = "/root/testdata/sf0.001"


def site_style_host(url):
    return re.sub(r"^[a-z]+://([^/:?#]*).*", r"\1", url).lower()


def text(html):
    return Page(html).main_text()


def test_article_without_the_rest():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>H</header><nav><ul><li><a href=/>x</a></ul></nav>
    <!-- ad --><div class="ad">buy</div><aside>side</aside><div id="cookie-notice">ok?</div><article><h1>Title &amp; more</h1><p><b>One<br><p>two
      three&nbsp;four</p><ul><li>a<li>b</ul><form>send</form><section class="comments"><p>nice</p></section></article><footer>&copy; x</footer></body></html>"""
    assert text(html) == "Title & more\nOne\ntwo three four\na\nb"


def test_odd_markup():
    assert text("") == ""
    assert text("plain < text & <b>bold</b>") == "plain < text & bold"
    assert text("<p>a<p>b<div>c") == "a\nb\nc"
    assert text("<article><p>open") == "open"
    assert text('<p title="a>b">x</p><a href="unclosed>y</a>') == "x\ny"
    assert text("<script>never closed <p>x") == ""
    assert text("<p>&lt;b&gt; &#65;&#x42;</p>") == "<b> AB"
    assert text("<!-- open <p>x") == ""
    assert text("<div><p>x" * 3000) == "\n".join(["x"] * 3000)


def test_repeated_branches_of_a_host_go(spark):
    page = '<body><div class="x1">Always the same here</div><div class="x2"><p>{0} is new</p><p>and {0} too</p></div></body>'
    rows = [(i, f"http://A.example/{i}", page.format(f"w{i}"), "clash", "clash") for i in range(12)] + [(50 + i, f"http://few.example/{i}", page.format(i), "", "") for i in range(2)] + [(90, None, None, "", ""), (91, "x", "", "", ""), (91, "x", "", "", ""), (None, "http://a.example/", "<p>z</p>", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, nodes string")
    found = {(r.page_id, r.text) for r in main_texts(pages).collect()}
    want = {(i, f"w{i} is new\nand w{i} too") for i in range(12)} | {(50 + i, f"Always the same here\n{i} is new\nand {i} too") for i in range(2)} | {(90, ""), (91, ""), (None, "z")}
    assert found == want and main_texts(pages).count() == len(rows) and main_texts(pages.limit(0)).count() == 0


def test_query_against_the_pages_own_article(spark):
    """In these pages the article element has the main text, in blocks of headings and paragraphs."""
    found = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op9_main_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?(?:b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert found[p.page_id] == (want, len(want))


def test_copies_of_one_article_keep_their_text(spark):
    """On a host of nothing but copies every node has entropies of 0, however many there are."""
    words = "A story that every page of this host has in full"
    layouts = [f'<body><article><div class="post-body"><p>{words}</p><p>and more</p></div></article></body>', f"<body><div><p>{words}</p><p>and more</p></div></body>"]
    rows = [(i, f"http://h{k}n{n}.example/{i}", html) for k, html in enumerate(layouts) for n in (2, 8, 1000) for i in range(n)]
    found = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).groupBy("text").count().collect()
    assert [tuple(r) for r in found] == [(f"{words}\nand more", 2020)]


def test_names_are_a_prior_only():
    """Names on wrappers, and names of which a part is listed, take nothing away."""
    assert text('<body class="no-sidebar"><article><p>x') == "x"
    assert text('<body class="sidebar"><article class="post has-sidebar"><p>x') == "x"
    assert text('<div class="modal"><article><p>x</article></div>') == "x"
    for name in ("share-prices", "related-work", "hidden-gems", "adults", "no-comments"):
        assert text(f'<article><p>a</p><section class="{name}">b</section></article>') == "a\nb", name
    for name in ("ad", "ad-box-300x250", "site_footer", "comments-area", "comment-list", "post-share", "x newsletter"):
        assert text(f'<article><p>a</p><section class="{name}">b</section></article>') == "a", name
    story = " ".join(f"word{i}" for i in range(40))
    assert text(f"<body><article>only a teaser</article><div><p>{story}</p></div></body>") == f"only a teaser\n{story}"
    assert text(f'<body><form><main><p>{story}</p><aside><article>other</article></aside></main></form></body>') == story
    assert text(f'<main><p>{story}</p><section class="comments"><article><p>nice</p></article></section></main>') == story
    assert text(f'<body><article><p>{story}</p></article><section class="comments"><article><p>{story} too</p></article></section></body>') == story


def neutral(html):
    """The page with neither article, nav, footer nor telling class names."""
    html = html.replace('class="ad"', 'class="x1"')
    for name, other in (("article", "x2"), ("nav", "x3"), ("footer", "x4")):
        html = html.replace(f"<{name}>", f'<div class="{other}">').replace(f"</{name}>", "</div>")
    return html


def test_tree_decides_without_names(spark, monkeypatch):
    """On hosts with pages enough, the tree finds the same main text when nothing is named; without the tree it isn't found."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    many = {h for h, _ in Counter(site_style_host(r.url) for r in pages).most_common(5)}
    pages = [r for r in pages if site_style_host(r.url) in many]
    named = spark.createDataFrame([(r.page_id, r.url, r.html) for r in pages], "page_id long, url string, html string")
    unnamed = spark.createDataFrame([(r.page_id, r.url, neutral(r.html)) for r in pages], "page_id long, url string, html string")
    texts = lambda df: {r.page_id: r.text for r in main_texts(df).collect()}
    want, got = texts(named), texts(unnamed)
    assert len(want) > 300
    same = sum(got[i] == t for i, t in want.items())
    assert same == len(want)
    monkeypatch.setattr(site_style, "LEAST_PAGES", 10**9)
    off = texts(unnamed)
    assert sum(off[i] == t for i, t in want.items()) == 0


def test_low_boxes_inside_an_article_go(spark):
    page = '<body><article><p>story {0} of its own</p><div class="x9">Read our other stories, all of them</div><div class="x8">caption {0}</div><p>more {0}</p></article></body>'
    rows = [(i, f"http://b.example/{i}", page.format(f"w{i}")) for i in range(20)]
    found = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"story w{i} of its own\ncaption w{i}\nmore w{i}" for i in range(20)}


@pytest.mark.parametrize("unit", ["<div>", "</x>", "<a b='", "<a'>'", "<!", "<!--", "<p>", "<x><p>", "<li><x>", "<script ", "</script", "<p class='a'>x", "&", "<", "<a b=\"'>"])
def test_long_malformed_pages(unit):
    """A megabyte of any of these takes time in proportion to its length."""
    html = unit * (1_000_000 // len(unit)) + "</x>" * 20_000
    for run in (lambda h: Page(h).main_text(), lambda h: Page(h, stats=True).blocks, visible_text):
        began = time.process_time()
        run(html)
        assert time.process_time() - began < 6


def test_nested_then_stray_tags():
    n = 60_000
    for html in ("<div>" * n + "</x>" * n, "<x>" * n + "<p></p>" * n, "<p><div>" + "<x>" * n + "<p></p>" * n):
        began = time.process_time()
        Page(html).main_text()
        assert time.process_time() - began < 6


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p>a b c</p><svg class="i"/><p>d e f</p></article>', "a b c\nd e f"),
        ("<article><p>a b c</p><button>x<p>d e f</p></article>", "a b c\nx\nd e f"),
        ("<p>see <select><option>x</option> d e f</p><p>more</p>", "see\nx\nd e f\nmore"),
        ("<p>b <video src=x/> c</p><p>d</p>", "b c\nd"),
        ("<article><p>a</p><svg><g><svg><text>no</text></svg></g></svg><p>b <button>x <b>no</b></button> c</p></article>", "a\nb c"),
        ("<article><p>a</p><object>y</article><footer>f</footer><object>z</object>", "a\ny"),
        ('<form id="aspnetForm"><div><h1>t</h1><p>a longer story</p></div><div class="comments"><p>x</p></div></form>', "t\na longer story"),
        ('<body><div class="modal-content"><p>story here</p></div></body>', "story here"),
        ('<body><div class="modal"><form class="login"><p>story here, all of it</p></form></div></body>', "story here, all of it"),
        ('<body><div class="modal"><p>no</p></div><article><p>story</p></article></body>', "story"),
    ],
)
def test_elements_end_where_they_do(html, text):
    assert Page(html).main_text() == text


def test_unclosed_elements_are_shown(spark):
    assert visible_text('<p>a</p><svg class="i"/><p>b</p><button>c<p>d</p>') == "a\nb\nc\nd"
    assert visible_text("<p>a <button>no</button> b</p>") == "a\nb"


def test_a_host_of_one_form(spark):
    """Pages of one host that are a form each keep their texts, with a tree and without."""
    rows = [(i, "http://h/", f'<form id="aspnetForm"><div class="top"><p>Menu of the house</p></div><div><h1>Title {i}</h1><p>{" ".join(f"word{i}x{k}" for k in range(60))}</p></div></form>') for i in range(20)]
    got = site_style.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(f"word{r.page_id}x0" in r.text for r in got)


def test_long_names_are_told_apart():
    """Names that differ beyond the length kept of them are nodes of their own."""
    page = Page("".join(f'<div class="{"a" * 100}{i}"><p>t{i}</p></div>' for i in range(3)), stats=True)
    assert len({path for path, _ in page.texts if path.count("/") == 1}) == 3


def test_many_open_elements_take_linear_time():
    import time

    began = time.time()
    for html in ("<svg>" * 100_000 + "</div>" + "</svg>" * 100_000, "<button>" * 100_000, "<button>" * 50_000 + "</button>", "<div><select></div>" * 50_000):
        Page(html).main_text()
    assert time.time() - began < 60
