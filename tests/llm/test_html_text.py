import html
import re
import time

import pytest

from reasonloom.llm import html_text, queries

extract = html_text.extract


def test_query_on_all_pages(spark, small_dir):
    """The pages of these tables mark their text by one element."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    rows = queries.op8_html_text(spark, small_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body))
        texts = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == " ".join(t for t in texts if t)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


LONG = "Some longer running text of an article that goes on, with commas, for a while. " * 3
CHROME = [
    "<nav><ul><li><a href=x>Home</a></ul></nav>",
    '<div class="sidebar"><p>On the side there is a lot of text that nobody wants to read.</div>',
    "<header><h2>Site</h2></header>",
    "<footer>&copy; somebody</footer>",
    '<div id="comments"><p>Great post, I liked it a lot and will come back.</p></div>',
    "<form><label>Mail</label><input><button>Send</button></form>",
    '<div class="cookie-notice"><p>We use cookies and so on and so forth.</p></div>',
    '<div class="ad-banner">Buy this now</div>',
    "<script>var x = '<p>no</p>' < 3;</script><style>p{}</style>",
    '<aside><p>Related reading elsewhere.</p></aside>',
    '<ul class="menu"><li>One<li>Two</ul>',
    "<!-- a comment with <p>tags</p> -->",
]


@pytest.mark.parametrize("chrome", CHROME)
@pytest.mark.parametrize("tag", ["article", "div class=post", "div"])
def test_chrome_before_and_after(chrome, tag):
    main = f"<{tag}><h1>Title</h1><p>{LONG}</p><p>{LONG}<p>Short.</p></{tag.split()[0]}>"
    page = f"<html><body>{chrome}{main}{chrome}</body></html>"
    assert extract(page) == " ".join(f"Title {LONG}{LONG} Short.".split())


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain &amp; text", "plain & text"), ("<p>a", "a"),
        ("<p>a</p><p>b  c\n d</p>", "a b c d"), ("<div><b>bo</b>ld</div>", "bold"),
        ("a<br>b", "a b"), ("<p>x &lt;b&gt; &#8364; &eacute;&nbsp;y", "x <b> \u20ac \xe9 y"),
        ("<script>", ""), ("<p", ""), ("</p></div>", ""), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ('<p title="a > b">t</p>', "t"), ("<DIV><P>Up</DIV>", "Up"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ],
)
def test_small_pages(page, text):
    assert extract(page) == text


def test_densities_choose_the_text_among_unnamed_boxes():
    links = "".join(f"<li><a href=/{k}>A link of some words</a></li>" for k in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div><div><ul>{links}</ul></div>"
    assert extract(page) == " ".join((LONG + LONG).split())


PART = "<p>" + "x" * 500
LINKS = "<div><ul>" + "<li><a href=/>A link of some words</a>" * 8 + "</ul></div>"


@pytest.mark.parametrize(
    "page, kept",
    [
        ("<h1>The title</h1><div>{5}</div><div>{4}</div>", "The title {9}"),
        ("<div><h1>The title</h1></div><div>{2}</div><div>{5}</div>", "The title {7}"),
        ("<h1>The title</h1><div>By me</div>{links}<div>{5}</div>{links}<div>{4}</div>", "The title By me {9}"),
        ("<div>{5}</div><h2>More</h2><p>Short.</p><div>{4}</div>", "{5} More Short. {4}"),
        ("<div>{5}</div><h2>Elsewhere</h2>{links}<div>{4}</div>{links}", "{9}"),
        ("<div>{5}</div><div>{links}<div>{4}</div></div>", "{9}"),
        ("<article>{5}</article>{links}<article>{4}</article>", "{9}"),
        ("<article>{5}</article><div class=more>{4}</div>", "{5}"),
        ("<h1>The title</h1>" + "x" * 60 + "<article>{5}</article>", "The title {5}"),
        ("<article><div>{5}</div>" + "x" * 500 + "<div>{4}</div></article>", "{10}"),
    ],
)
def test_siblings_below_the_body(page, kept):
    page = page.replace("{links}", LINKS)
    for n in (2, 4, 5):
        page = page.replace(f"{{{n}}}", PART * n)
    for n in (4, 5, 7, 9, 10):
        kept = kept.replace(f"{{{n}}}", " ".join(["x" * 500] * n))
    assert extract(f"<html><body>{page}</body></html>") == kept


ONE = " ".join(LONG.split())


@pytest.mark.parametrize(
    "page, text",
    [
        # a page that is one form
        ("<form action=x><h1>Title</h1><p>{1}</p><p>{1}</p><input><button>Go</button></form>", "Title {1} {1}"),
        ("<form><div id=all><p>{1}</p><select><option>a</select><p>{1}</p></div></form>", "{1} {1}"),
        ("<form><p>Search</p><button>Go</button></form><div><h1>Title</h1><p>{1}</p></div>", "Title {1}"),
        # boxes of a page builder
        ('<div class="elementor"><div class="elementor-widget"><p>{1}</p></div>'
         '<div class="elementor-widget"><p>{1}</p></div></div>', "{1} {1}"),
        ('<div class="elementor-widget"><h1>Title</h1></div><div class="elementor-widget"><p>{1}</p></div>'
         "<div class=elementor-widget><ul><li><a href=a>One link</a><li><a href=b>Another link</a></ul></div>",
         "Title {1}"),
        # names inside an article
        ('<article><h1>T</h1><p>{1}</p><h2 id="social-effects">Social effects</h2><p>{1}</p>'
         '<section id="related-work"><h2>Related work</h2><p>{1}</p></section></article>',
         "T {1} Social effects {1} Related work {1}"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>{1}</p></article>', "Title {1}"),
        ('<article><p>{1}</p><div class="comments"><p>Great post!</p></div></article>', "{1}"),
        ('<article><p>{1}</p><div id="share"><a href=x>Tell a friend</a> <a href=y>Print</a></div></article>', "{1}"),
        # other attributes that speak of hidden things
        ('<div><p title="how to show hidden files">{1}</p><p data-x=\'id="sidebar"\'>{1}</p></div>', "{1} {1}"),
        ("<div><p>{1}</p><p hidden>no</p><p aria-hidden=true>no</p></div>", "{1}"),
        # formulas, and headers inside main
        ("<div><p>{1} so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></div>",
         "{1} so x=2 holds."),
        ("<main><header><h1>Title</h1></header><p>{1}</p></main>", "Title {1}"),
        ("<header><h1>Site</h1></header><main><p>{1}</p></main>", "{1}"),
    ],
)
def test_nothing_of_the_text_is_lost(page, text):
    page, text = (x.replace("{1}", ONE) for x in (page, text))
    assert extract(f"<html><body>{page}</body></html>") == text


@pytest.mark.parametrize(
    "page",
    [
        "<p>" + "<b>" * 20_000 + "{1}",
        "<p>" + "<b>x" * 20_000 + "{1}",
        "<i>" * 20_000 + "</b>" * 20_000 + "{1}",
        "<div><p>{1}</p></div>" + "<span>a</span>" * 20_000,
        "<span></span>" * 20_000 + "<div><p>{1}</p></div>",
        "<b><p>" * 10_000 + "{1}",
        "<li><b>" * 20_000 + "{1}",
        "<td><i>" * 20_000 + "{1}",
        "<header>" * 20_000 + "</header>" * 20_000 + "<p>{1}",
        "<section><h2>a</h2>" * 10_000 + "<p>{1}",
    ],
)
def test_time_grows_with_the_page(page):
    page = page.replace("{1}", ONE)
    start = time.process_time()
    text = extract(page)
    assert time.process_time() - start < 1.5 and ONE in text


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + f"<p>{LONG}</p>"
    assert extract(deep) == LONG.strip()
    assert len(extract("<p>" + "word " * 200_000)) == 999_999


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>a"), (2, "v", ""), (3, "w", "<p>" + "x" * 10_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'clash' AS text", "1 AS n_chars"
    )
    got = sorted((tuple(r) for r in html_text.extract_pages(pages).collect()), key=str)
    wanted = [(1, "u", "", 0)] * 2 + [(None, None, "a", 1), (2, "v", "", 0), (3, "w", "x" * 10_000, 10_000)]
    assert got == sorted(wanted, key=str)
    assert html_text.extract_pages(pages.limit(0)).count() == 0
