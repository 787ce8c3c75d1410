import html
import itertools
import re
import time

import numpy as np
import pytest

from passagework.llm import page_text
from passagework.llm.labelled_pages import labelled_pages
from passagework.llm.leaf_blocks import Block, leaf_blocks
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chain():
    return page_text.standard_chain()


@pytest.mark.parametrize(("page", "want"), [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("a &amp; b&nbsp; c &lt;p&gt;", ["a & b c <p>"]),
    ("<p>one <b>two</b>\n three<br>four</p>", ["one two three four"]), ("x <!-- <p>y</p> --> z", ["x z"]),
    ("<script>var t='</p>';<p></script>ok", ["ok"]), ("<STYLE>p{}</style\n>ok", ["ok"]), ("<script>no end <p>x", []),
    ('<div title="a > b">c</div>', ["c"]), ("1 < 2 <3", ["1 < 2 <3"]), ("<li>a<li>b</ul>c", ["a", "b", "c"]),
    ("<svg>no end <p>x", ["no end", "x"]), ("<p>unclosed <a href='", ["unclosed <a href='"]), ("<!DOCTYPE html>&copy;", ["©"]),
    ("<textarea>a</textarea>b<select><option>c</select>", ["b"]), ("<!-- open", [])])
def test_blocks(page, want):
    assert [b.text for b in leaf_blocks(page)] == want


def test_formulas_and_fallbacks_of_an_article_stay(spark):
    """What is not rendered as plain paragraphs is still the article's; the chain labels it like any other block."""
    words = "The committee measured the height of every tree along the river and wrote the results down in a long table."
    page = (f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>Trees</h1><p>{words}</p>"
            f"<p>The area is <math><mi>r</mi><mo>=</mo><mn>5</mn></math> in all cases, as {words}</p>"
            f"<object><p>Inside the object. {words}</p></object><noscript><p>Inside the noscript. {words}</p></noscript>"
            f"<p>{words}</p></article><footer><p>Copyright 2020</p></footer></body></html>")
    text = page_text.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text
    assert "area is r=5 in all cases" in text and "Inside the object." in text and "Inside the noscript." in text
    assert "Home" not in text and "Copyright" not in text


def test_paths_and_links():
    a, b, c = leaf_blocks('<body><article class="post-body"><p>t <a href=x>link</a></p></article><footer id=foot>f</footer><ul><li>'
                          "<a>all</a>")
    assert a.path == ("body", "article", "p") and a.names == {"post", "body"} and a.linked == 4
    assert b.path == ("body", "footer") and b.names == {"foot"}
    assert c.path == ("body", "ul", "li") and c.linked == c.total


def test_time_is_linear_in_odd_pages():
    start = time.time()
    for page in ("<" * 200_000, '<a "' * 50_000, "<p>" * 100_000, "<div>" * 20_000 + "x", "&amp" * 100_000, "<!--" * 50_000):
        leaf_blocks(page)
    assert time.time() - start < 20


def test_viterbi_finds_the_best_of_all_labellings(chain):
    rng = np.random.default_rng(2)
    blocks = [Block("some words here.", ("body", t), frozenset(), 0, 16) for t in ("p", "nav", "p", "footer", "li", "p")]
    for _ in range(20):
        names = {n for i, b in enumerate(blocks) for n in page_text.features(b, i / 5)}
        own = page_text.Chain({n: rng.normal() for n in names}, rng.normal(size=(2, 2)), rng.normal(size=2))

        def value(labels, own=own):
            total = own.first[labels[0]]
            for i, (b, y) in enumerate(zip(blocks, labels, strict=True)):
                total += y * sum(own.weights[n] for n in page_text.features(b, i / 5))
                total += own.moves[labels[i - 1]][y] if i else 0
            return total

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert tuple(map(int, own.decode(blocks))) == best


def test_unseen_pages_of_the_layouts(chain):
    right = total = 0
    for blocks, labels in labelled_pages(300, 99):
        right += sum(a == b for a, b in zip(chain.decode(blocks), labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_article_among_all_kinds_of_boilerplate(chain):
    page = """<html><body><header><a href="/">Site</a> the best site</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
        <div class="cookie-notice">We use cookies. Please agree.</div><aside><p>Read more of this.</p></aside>
        <article><h1>Title</h1><p>First &eacute; paragraph of some length, with words.</p><p>Second one.</p>
        <form><label>Name</label><input></form><div class="advert">Buy this now.</div></article>
        <section class="comments"><h3>Comments</h3><p>I liked this text very much.</p></section>
        <footer>&copy; Site. All rights.</footer></body></html>"""
    assert chain.text(page) == "Title\n\nFirst é paragraph of some length, with words.\n\nSecond one."
    assert chain.text("<nav><a href=x>a</a></nav><footer>b</footer>") == ""


def test_query_on_whole_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op6_page_text"][0](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>|</?b>", " ", x)).split()) for x in re.split("</?p>|</?h1>", article)]
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (2, "<article><p>Some text of it.</p></article>", None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = page_text.extract(pages)
    assert got.columns == pages.columns
    assert [r.text for r in got.collect()] == ["", "", "Some text of it."] * 2
    assert page_text.extract(pages.limit(0)).count() == 0
    long = spark.createDataFrame([("<article>" + "<p>Some text of it.</p>" * 20_000,)], "html string")
    assert page_text.extract(long).first().text.count("\n\n") == 19_999
