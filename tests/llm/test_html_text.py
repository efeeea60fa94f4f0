import html
import re

import pytest

from passagelake.llm.html_text import extract, main_text, parse, subtree_hashes
from passagelake.llm.queries import op2_html_text

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, host string"


def test_query_equals_a_reading_of_the_known_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op2_html_text(spark, SF).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for row in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[row["page_id"]], re.S)[1]
        spaced = re.sub(r"</?(p|h1)>|<br>", " ", article)
        text = " ".join(html.unescape(re.sub(r"<[^>]+>", "", spaced)).split())
        assert (row["text"], row["n_chars"]) == (text, len(text))


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("no tags at all", "no tags at all"),
        ("<p>a &amp; b&nbsp;c &#233; &lt;tag&gt;</p>", "a & b c é <tag>"),
        ("<body><nav>menu</nav><header>top</header><p>one<p>two<footer>end</footer>", "one two"),
        ("<main><h1>T</h1><p>x<b>y</b>z</p></main><div>outside</div>", "T xyz"),
        ("<article><p>a</p><aside>side</aside><form>f<input></form><p>b</p></article>", "a b"),
        ("<article><p>a</p><section id='comments'><p>first!</p></section></article>", "a"),
        ("<article><div class='cookie-notice'>we</div><p>a</p><div class=ad-slot>buy</div></article>", "a"),
        ("<article><p>ad hoc text about menus</p></article>", "ad hoc text about menus"),
        ("<article class='comment'><p>c</p></article><article><p>a</p></article>", "a"),
        ("<body class='has-sidebar'><article>a</article><div>b</div></body>", "a"),
        ("<div class='page-menu'><article>a</article></div>", "a"),
        ("<article>a<script>var t='</p>';</script><style>p{}</style>b<!-- c --><noscript>d</noscript></article>", "ab"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one two x y"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>quote \" in text <a title='a > b'>link</a></p></article>", 'quote " in text link'),
        ("<article><p>a<br>b<br/>c</p></article></article></div>", "a b c"),
        ("<p>a<div hidden>h</div><div style='display: none'>n</div>b", "a b"),
    ],
)
def test_main_text(source, text):
    assert main_text(source) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<article>" + "<p>word</p>" * 20_000 + "</article>") == " ".join(["word"] * 20_000)
    assert len(subtree_hashes(parse("<div>" * 3000 + "x"))) == 3000


def test_template_subtrees_of_a_host_go_and_content_stays(spark):
    def page(i, host):
        return (
            i, f"http://{host}/p{i}",
            f"<body><div><p>Site claim</p></div><section><p>Page {i} text</p></section>"
            "<p>A line that all pages have</p></body>", "clash",
        )

    rows = [page(i, "Many.example") for i in range(8)] + [page(i, "few.example") for i in range(20, 23)]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3]["text"] == "Page 3 text A line that all pages have" and got[3]["n_templates"] == 1
    assert got[20]["text"] == "Site claim Page 20 text A line that all pages have"


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "x", "<p>a</p>", ""), (2, "http://h/", "", None)]
    got = extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_a_page_make_no_template(spark):
    copied = "<body><div>The whole text stands in a div</div><ul><li>and a list</li></ul></body>"
    rows = [(i, f"http://h/{i}", copied, None) for i in range(8)]
    rows += [(20 + i, f"http://h/{20 + i}", f"<body><div>Page {i}</div></body>", None) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(8)} == {"The whole text stands in a div and a list"}
    assert got[22] == "Page 2"


def test_the_subtree_with_the_main_text_stays(spark):
    # Pages that differ in what is not text, and a template around the article.
    rows = [(i, f"http://h/{i}", f"<body><div>All the text</div><!-- {i} --></body>", None) for i in range(8)]
    rows += [(20 + i, f"http://g/{i}", f"<div><article>Same</article><ul><li>x</li></ul></div><p>{i}", None) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(8)} == {"All the text"}
    assert {got[20 + i] for i in range(8)} == {"Same"}


def test_a_notice_on_many_pages_of_a_large_host_goes(spark):
    def page(i):
        notice = "<div>Unmarked notice</div>" if i < 120 else ""
        return i, f"http://hot/{i}", f"<body><p>Page {i} text</p>{notice}</body>", None

    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame([page(i) for i in range(900)], SCHEMA)).collect()}
    assert got == {i: f"Page {i} text" for i in range(900)}


@pytest.mark.parametrize(
    "kept",
    [
        '<section id="discussion"><p>kept words</p></section>',
        '<div class="copyright-law">kept words</div>',
        '<p class="share">kept words</p>',
        '<div class="ad-free">kept words</div>',
        '<div class="notice-period">kept words</div>',
        '<div class="related"><p>kept words</p> <a href="/">x</a></div>',
    ],
)
def test_names_alone_delete_no_part_of_an_article(kept):
    assert "kept words" in main_text(f"<body><article><p>before</p>{kept}<p>after</p></article></body>")


@pytest.mark.parametrize(
    "gone",
    [
        '<div class="ad">gone</div>', '<div id="ad-box-2">gone</div>', '<div class="cookieNotice">gone</div>',
        '<div class="comments"><p>gone</p></div>', '<ul class="share"><li><a href="/">gone</a></li></ul>',
        '<div class="related-links"><a href="/">gone</a> <a href="/b">gone</a></div>',
        '<div role="alert">gone</div>', '<p hidden>gone</p>',
    ],
)
def test_boilerplate_inside_an_article_goes(gone):
    assert main_text(f"<body><article><p>before</p>{gone}<p>after</p></article></body>") == "before after"


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "deep",
        "<b>" * 100_000 + "deep",
        "<p>" + "<button><div>" * 50_000 + "deep",
        "<div class='ad'><div class='related'>" * 50_000 + "<article>deep",
        "<article>" + "<div class='share'>" * 100_000 + "deep",
        "<table><tr><td>" * 33_000 + "deep",
        "</b><p></i>" * 33_000 + "deep",
    ],
)
def test_deep_pages_take_time_by_their_length(page):
    import time

    began = time.process_time()
    text = main_text(page)
    subtree_hashes(parse(page))
    assert time.process_time() - began < 10
    assert text in ("deep", "")


def test_unmarked_menus_of_pages_without_an_article_go_by_recurrence(spark):
    menu = "<div><ul><li>Home</li><li>All pages</li></ul></div>"
    rows = [(i, f"https://h.org/{i}", f"<body>{menu}<div><p>Story number {i} of many</p></div></body>") for i in range(40)]
    rows += [(100 + i, f"https://other.org/{i}", f"<body>{menu}<p>Alone {i}</p></body>") for i in range(2)]
    found = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(found[i] == f"Story number {i} of many" for i in range(40))
    assert found[100] == "Home All pages Alone 0"
