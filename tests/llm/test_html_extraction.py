"""Extraction of main texts: pages with an article element, layouts known by comparison only, and odd markup."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import html_extraction, page_tree

SCHEMA = "page_id long, url string, html string, host string, text string, outline string, part int"
RNG = random.Random(13)


def prose(n):
    return " ".join(RNG.choice(["alder", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple"]) for _ in range(n))


def alone(page):
    return html_extraction.extracted(page, None)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<article><h1>A\n title</h1><p>one<b>two</b> three<br>four<p>five</article>", "A title onetwo three four five"),
        ("<article><p>a &lt;b&gt; &#233;&nbsp;x &amp;amp;</p></article>", "a <b> é x &amp;"),
        ("<nav>menu</nav><article>kept</article><footer>foot</footer>", "kept"),
        ("<header>site</header><article><header><h1>T</h1></header>body</article>", "T body"),
        ("<article>x<script>if (a</p>b) '<p>'</script>y<style>p{}</style>z<!-- c <p> -->!</article>", "xyz!"),
        ("<main><article>first</article><aside>side</aside><article>second</article></main>", "first second"),
        ("<article>one<aside>side</aside>two</article>", "one two"),
        ("<article>body<section id='comments'><article class='comment'>reader</article></section></article>", "body"),
        ("<article>body<div class='share-buttons'>share</div><form>f<input></form></article>", "body"),
        ("<div class='ad-slot'>ad</div><div class=content><p>text of it</p></div><div id=main-nav>nav</div>", "text of it"),
        ("<body class='has-sidebar'><div class='page-wrapper with-ads'><p>text</p></div></body>", "text"),
        ("<form id=aspnet><article>in a form</article></form>", "in a form"),
        ("<article><ul><li>one<li>two<ul><li>deep</ul><li>three</ul></article>", "one two deep three"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
        ("<article><p title='a>b'>quoted</p><p title=\"x>open</p></article>", "quoted open"),
        ("<article>cut off <b>here", "cut off here"),
        ("<article hidden>none</article><p>shown</p>", "shown"),
        ("<p>unended <a", "unended <a"),
        ("<a " * 50, ("<a " * 50).strip()),
    ],
)
def test_one_page(page, want):
    assert alone(page) == want


def test_deep_and_long_pages():
    page_tree.deep()
    assert alone("<div>" * 20_000 + "core" + "</div>" * 20_000) == "core"
    words = prose(300_000)
    assert alone(f"<nav>n</nav><article><p>{words}</article>") == words
    many = "".join(f"<p>w{i}</p><h2>h{i}</h2>" for i in range(300))
    assert alone(f"<article>{many}</article>") == " ".join(f"w{i} h{i}" for i in range(300))


def test_matching_counts_equal_nodes_in_order():
    def tree(label, *kids):
        slot = page_tree.Slot(label, False, False, 1, 0, 0, {})
        slot.kids = list(kids)
        return slot

    a = tree("body", tree("div", tree("p"), tree("ul")), tree("div", tree("h1")), tree("div", tree("p")))
    b = tree("body", tree("div", tree("h1")), tree("span"), tree("div", tree("p"), tree("ul")))
    # the second and third div of a with both of b: body, div h1, div p
    assert page_tree.matching(a, b) == 5
    assert page_tree.matching(a, a) == 8
    assert page_tree.matching(tree("p"), tree("div")) == 0


def layout(i, body):
    """A page whose parts have no names: only comparison tells them apart."""
    return (
        f"<html><body><div><p>Daily Tree, all the trees that are fit to print since 1887</p></div><div><div><h1>{prose(6)} {i}</h1>"
        f"<div><p>Written by our own correspondents in the woods</p></div><div>{body}</div></div>"
        f"<div><p>Read all the terms of use and find out about jobs with us</p></div></div></body></html>"
    )


@pytest.fixture(scope="module")
def pages():
    bodies = ["".join(f"<p>{prose(40)}</p>" for _ in range(RNG.randint(1, 6))) for _ in range(40)]
    rows = [(i, f"http://WWW.Trees.test/{i}", layout(i, body)) for i, body in enumerate(bodies)]
    # copies of one article hold a host
    copy = layout("copy", "<p>" + prose(50) + "</p>")
    rows += [(100 + i, f"http://copies.test/{i}", f"<article>{copy}</article>") for i in range(9)]
    rows += [(200, None, "<article>no url</article>"), (None, "http://trees.test.other/", "<p>no id</p>"), (201, "http://www.trees.test/x", None)]
    rows += [(202, "no host", ""), (203, "http://www.trees.test/y", "<article>another layout</article>"), (0, "http://www.trees.test/0", rows[0][2])]
    return rows, bodies


def test_wrappers(spark, pages):
    rows, bodies = pages
    frame = spark.createDataFrame([(*r, "h", "t", "o", 1) for r in rows], SCHEMA)
    got = html_extraction.main_texts(frame.repartition(5)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {(r.page_id, r.url): r.text for r in got}
    titles = {i: rows[i][2].split("<h1>")[1].split("</h1>")[0] for i in range(len(bodies))}
    for i, body in enumerate(bodies):
        paragraphs = body.replace("<p>", " ").replace("</p>", " ").split()
        assert texts[i, rows[i][1]] == " ".join([titles[i], *paragraphs])
    assert len({texts[100 + i, f"http://copies.test/{i}"] for i in range(9)}) == 1
    assert "copy Written by our own" in texts[100, "http://copies.test/0"]
    assert texts[200, None] == "no url" and texts[None, "http://trees.test.other/"] == "no id"
    assert texts[201, "http://www.trees.test/x"] == texts[202, "no host"] == ""
    assert texts[203, "http://www.trees.test/y"] == "another layout"


def test_outlines_are_the_same_however_pages_are_dealt(spark, pages):
    frame = spark.createDataFrame([(*r, "h", "t", "o", 1) for r in pages[0][:40]], SCHEMA)
    one, many = (html_extraction.wrappers(frame.repartition(n)).select("outline").collect() for n in (1, 7))
    assert one == many and len(one) == 1


def test_no_pages(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert html_extraction.main_texts(frame).collect() == []
    assert html_extraction.main_texts(frame.filter(F.lit(False))).columns == ["page_id", "url", "text", "n_chars"]


def test_rare_template_is_found_however_many_slots_a_host_has(spark):
    """6 of 700 pages have an offer; one page with 500 blocks of its own doesn't change what they give."""
    letters = "abcdefghij"
    names = [f"q{a}{b}{c}z" for a in letters for b in letters for c in letters[:5]]
    large = "<article>" + "".join(f"<div class={n}>{n}</div>" for n in names) + "</article>"

    def texts(last):
        offer = "<div class=deal>Buy it now</div>"
        pages = [f"<article><p>text {prose(20)} {i}</p>{offer if i % 100 == 5 and i < 600 else ''}</article>" for i in range(699)]
        rows = [(i, f"http://shop.net/{i}", page) for i, page in enumerate([*pages, last])]
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
        return {r.page_id: r.text for r in html_extraction.main_texts(frame).collect()}

    for last in ("<article><p>plain</p></article>", large):
        found = texts(last)
        assert not [t for i, t in found.items() if i < 699 and "Buy it now" in t]
    assert found[699] == " ".join(names)
