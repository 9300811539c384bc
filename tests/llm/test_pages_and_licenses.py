"""Page text against a reading of the markup, and license scans."""

from __future__ import annotations

import html
import re
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import licenses, page_diff, queries
from recordloom.llm.html_lines import candidates, common_lines
from tests.llm.test_duplicates import agrees_with_sql, rows_of


def test_query_returns_the_articles(spark, sf_dir):
    found = {r.page_id: r for r in queries.op1_page_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        inside = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1)>", inside)]
        text = "\n".join(x for b in blocks if (x := " ".join(html.unescape(b).split())))
        assert (found[page.page_id].text, found[page.page_id].n_chars) == (text, len(text))


def test_markup_that_is_no_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body>
      <header>Site</header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">Cookies</div>
      <main><h1>Head&amp;line</h1><p>One <b>two</b><br>three &eacute;&nbsp; &#x41;
      <script>var a = "</p>";</script><p>Second <i>para
      <div class="ad">Buy</div><form><p>Name</p></form><aside>Aside</aside>
      <section class="comments"><p>First!</p></section><!-- <p>gone</p> -->
      <p>a &lt; b < c</p></main><footer>Foot</footer>"""
    assert [t for t, _ in candidates(page)] == [
        "Head&line", "One two three é A", "Second para", "a < b < c",
    ]
    assert candidates("") == [] and candidates("<p") == [("<p", True)]
    assert [t for t, _ in candidates("<div>x</div>" * 3)] == ["x"] * 3


def test_shared_lines_go_where_nothing_announces_the_article(spark):
    def page(number, text):
        body = f"<div>Shop</div><div>{text}</div><div>Imprint</div><div>All of us</div>"
        return (number, f"http://h.example/a/{number}", body)

    rows = [page(i, f"Story {i}") for i in range(1, 6)]
    rows += [
        (6, "http://other.example/", "<div>Shop</div><div>Alone</div>"),
        (7, None, "<div>Shop</div>"),
        (8, "http://h.example/zzz", None),
        (None, "http://x.example/", ""),
        (9, "http://t.example/1", "<article><p>Same</p><p>Old</p></article>"),
        (10, "http://t.example/2", "<article><p>Same</p><p>New</p></article>"),
    ]
    rows += [rows[0]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = [tuple(r)[:3] for r in page_diff.main_text(pages).select("page_id", "text", "url").collect()]
    texts = dict((i, t) for i, t, _ in found)
    assert len(found) == len(rows)
    assert all(texts[i] == f"Story {i}" for i in range(1, 6))
    assert texts[6] == "Shop\nAlone" and texts[7] == "Shop"
    assert texts[8] == texts[None] == ""
    assert texts[9] == "Same\nOld" and texts[10] == "Same\nNew"
    assert page_diff.main_text(pages.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    body = "<div>A</div><div>B</div><div>C</div>"
    rows = [(i, f"http://h.example/{i}", body) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.text for r in page_diff.main_text(pages).collect()} == {"A\nB\nC"}


def test_much_furniture_and_little_article(spark):
    """Ten lines of furniture around one of article, amid runs of copies and empty pages."""

    def page(number, path, story):
        menu = [f"<div>Menu {i}</div>" for i in range(10)]
        return (number, f"http://h.example/{path}", "".join([*menu[:6], f"<div>{story}</div>", *menu[6:]]))

    stories = ["A", "B", "B", "B", "B", "C", "C", "C", "D", "B"]
    rows = [page(i, f"x/{i}", f"Story {s}") for i, s in enumerate(stories)]
    rows += [(10, "http://h.example/x/00", ""), (11, "http://h.example/x/1/b", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in page_diff.main_text(pages).collect()}
    assert found == {i: f"Story {s}" for i, s in enumerate(stories)} | {10: "", 11: ""}


def test_marks_are_whole_names_and_not_of_what_holds_the_article():
    for start in (
        '<body class="has-sidebar">', '<body class="search header">', '<div class="with-comments">',
        '<html id="widget"><body>', '<main class="social notice"><div>',
    ):
        assert [t for t, _ in candidates(f"{start}<p>Text</p>")] == ["Text"]
    post = '<article class="post comments"><p>Text</p><div class="a comments"><p>First</p></div></article>'
    assert candidates(post) == [("Text", False)]
    cards = "<div>The text</div><article><p>Card</p></article>"
    assert candidates(cards) == [("The text", True), ("Card", False)]


def test_article_cards_beside_the_text(spark):
    rows = [
        (i, f"http://h.example/{i}",
         f"<body class='has-sidebar'><div>Shop</div><div>Text {i}</div><article><p>Card</p></article>")
        for i in range(3)
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in page_diff.main_text(pages).collect()}
    assert found == {i: f"Text {i}\nCard" for i in range(3)}


LINES = st.lists(st.integers(0, 3), max_size=9)


@settings(max_examples=300, deadline=None)
@given(LINES, LINES)
def test_common_lines_are_a_longest_common_subsequence(one, other):
    places = common_lines(one, other)
    table = [[0] * (len(other) + 1) for _ in range(len(one) + 1)]
    for i, j in product(range(len(one)), range(len(other))):
        table[i + 1][j + 1] = (
            table[i][j] + 1 if one[i] == other[j] else max(table[i][j + 1], table[i + 1][j])
        )
    assert places == sorted(set(places)) and len(places) == table[-1][-1]
    rest = iter(other)
    assert all(one[at] in rest for at in places)


def test_license_query(spark, sf_dir):
    agrees_with_sql(spark, sf_dir, "op6_license_scan")


def test_licenses_anywhere_in_a_text(spark, edge_docs, no_docs):
    filler = " ".join(f"w{i}" for i in range(300))
    grant = dict(licenses.TEMPLATES)["MIT"]
    rows = [(1, None), (2, ""), (3, filler)]
    places = range(0, 300, 7)
    words = filler.split()
    for k, at in enumerate(places):
        rows.append((100 + k, " ".join([*words[:at], "Released under the MIT License.", *words[at:]])))
        rows.append((200 + k, " ".join([*words[:at], grant, *words[at:]])))
    rows.append((4, "released UNDER  the\nmit-license"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.license): r for r in licenses.scan(docs).collect()}
    assert set(found) == {(i, "MIT") for i, t in rows if i >= 4}
    assert all(r.containment == 1.0 and r.windows >= 1 for r in found.values())
    assert licenses.scan(no_docs).count() == 0
    assert licenses.scan(edge_docs).count() == 0
    assert rows_of(licenses.scan(docs, templates=[])) == []


def test_templates_of_any_length_and_repeated_or_missing_ids(spark):
    body = " ".join(f"clause{i} of{i % 7}" for i in range(2_600))  # 5 200 words
    rows = [(1, "before " * 500 + body + " after" * 500), (1, body), (None, body), (2, body[:9_000])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = licenses.scan(docs, templates=[("long", body)]).collect()
    assert {r.doc_id for r in found} == {1, None} and all(r.containment == 1.0 for r in found)
    assert [licenses.length_class(n) for n in (1, 8, 9, 2_048, 2_049)] == [8, 8, 32, 2_048, 8_192]
