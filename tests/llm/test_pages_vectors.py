"""Page extraction and vector search, with awkward rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import html_extract, vector_search
from tallyloom.llm.html_extract import Matcher, Node, Tree, extract_pages, main_text, parsed
from tallyloom.llm.vector_search import nearest


def text(page):
    return main_text(parsed(page))


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>
      word&nbsp;here.<br>next<p>Two &lt;x&gt;</p><div class="ad">Buy</div><ul><li>a<li>b</ul><script>var t="</p>";</script>
    <form><input>Search</form><section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Head & line\nOne bold word here. next\nTwo <x>\na\nb"


def test_broken_markup():
    assert [text(x) for x in (None, "", "   ", "plain <words", "<p>a<p>b", "<div><p>x</div>y", "<!-- open", "<script>never closed", "<b>x</i></b> y<")] == ["", "", "", "plain <words", "a\nb", "x\ny", "", "", "x y<"]
    assert text("<p>" + "<div>" * 3000 + "deep") == "deep"


def test_tree_matching_is_largest():
    m = Matcher()
    a, b = m.tree("<div><p>1</p><ul><li>x</li><li>y</li></ul><p>2</p></div>"), m.tree("<div><ul><li>q</li></ul><p>3</p></div>")
    assert len(m.matched(a, b)) == m.size(a.shape[0], b.shape[0]) == 5  # root, div, ul, one li, one p


@pytest.mark.parametrize("cells", [1 << 22, 4])
def test_tree_matching_is_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "TABLE_CELLS", cells)
    rng = random.Random(3)

    def drawn(depth):
        n = Node(rng.choice("xyz"))
        n.parts = [drawn(depth - 1) for _ in range(rng.randint(0, 5))] if depth else []
        return n

    def largest(x, y):
        if x.tag != y.tag:
            return 0
        best = [[0] * (len(y.parts) + 1) for _ in range(len(x.parts) + 1)]
        for i, s in enumerate(x.parts):
            for j, t in enumerate(y.parts):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + largest(s, t))
        return 1 + best[-1][-1]

    for _ in range(60):
        roots = [Node("root"), Node("root")]
        for r in roots:
            r.parts = [drawn(3) for _ in range(rng.randint(1, 6))]
        m = Matcher()
        a, b = (Tree(r, m.shape) for r in roots)
        found = m.matched(a, b)
        assert len(found) == largest(*roots) == m.size(a.shape[0], b.shape[0])
        up = [{c: k for k, own in enumerate(t.kids) for c in own} for t in (a, b)]
        assert all(a.nodes[x].tag == b.nodes[y].tag for x, y in found)
        assert {(up[0][x], up[1][y]) for x, y in found if x} <= set(found) and all((x < z) == (y < w) for x, y in found for z, w in found if x != z)


def test_wide_deep_and_quoted_pages():
    m = Matcher()
    deep, wide = "<div>" * 5000 + "x", "".join(f"<p>{k}</p>" + "<div><ul></ul></div>" * (k % 3) for k in range(3000))
    assert len(m.matched(m.tree(deep), m.tree(deep + "<p>y"))) == 5001
    assert len(m.matched(m.tree(wide), m.tree("<h1>new</h1>" + wide))) == 1 + 3000 + 2 * 3000
    began = time.process_time()
    for junk in ('<a "', "<a '", '<a b="', "<!", "<a =", "<![CDATA[", "<ul>", "</x><b>"):
        text(junk * 250_000)
    assert time.process_time() - began < 40


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")


def test_wrapper_drops_constant_blocks(spark):
    body = "<body><div><p>Daily herald of the coast</p></div><div><p>{0}</p><p>{0} again</p></div><div><p>Call us today</p></div></body>"
    rows = [(f"http://a.example/{i}", body.format(f"story {i}")) for i in range(12)] + [("http://b.example/1", body.format("lone")), (None, body.format("no url")), ("http://a.example/n", None), ("http://a.example/0", body.format("story 0"))]
    got = {r.page_id: r for r in extract_pages(pages(spark, rows)).collect()}
    assert got[3].text == "story 3\nstory 3 again" and got[3].n_chars == len(got[3].text)
    assert got[12].text == "Daily herald of the coast\nlone\nlone again\nCall us today" and "no url" in got[13].text
    assert got[14].text == "" and got[15].text == got[0].text
    assert extract_pages(pages(spark, rows).limit(0)).count() == 0


def test_constancy_alone_tells_content(spark, monkeypatch):
    """Neutral names everywhere: what is the same on every page goes, short varying parts outside the content go."""
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(n))
    body = "<body><div class=a><div>{0}</div><div>{1}</div></div><div class=b><div><p>All rights with us</p><p>{2}</p><p>{3}</p><div class=share-box><p>{4}</p></div></div></div></body>"
    rows = [(f"http://h.example/{i}", [line(2), line(2), line(30), line(20), line(3)]) for i in range(20)]
    docs = pages(spark, [(u, body.format(*x)) for u, x in rows])
    want = {i: f"{x[2]}\n{x[3]}" for i, (_, x) in enumerate(rows)}
    assert {r.page_id: r.text for r in extract_pages(docs).collect()} == want
    monkeypatch.setattr(html_extract, "BROADCAST_CHARS", 0)  # pages and wrappers meet by host and salt
    assert {r.page_id: r.text for r in extract_pages(docs).collect()} == want


def test_article_in_a_block_with_a_telling_name(spark):
    page = "<body><div class=related-notice><h1>{0}</h1><p>{1}</p><p>{1} more</p></div><div><p>x{0}</p></div></body>"
    docs = pages(spark, [(f"http://h.example/{i}", page.format(f"Head {i}", f"long story {i} " * 9)) for i in range(10)])
    assert all(r.text.startswith(f"Head {r.page_id}\nlong") and "x" not in r.text for r in extract_pages(docs).collect())


def test_words_inside_quoted_values_are_no_attributes():
    assert text('<body><p title="the hidden gem">One</p><p data-x="a class=ad here">Two</p><p title=\'id="nav"\'>Three</p><p hidden>Four</p><p CLASS = "ad">Five</p><p x=y hidden=until>Six</p></body>') == "One\nTwo\nThree"
    start = time.time()
    parsed("<p " + "a='" * 50_000 + ">x")
    parsed("<p " + 'class="x" ' * 50_000 + ">x")
    assert time.time() - start < 5


@pytest.mark.parametrize("size", [1e160, 1e-170])
def test_nearest_of_very_long_and_short_vectors(spark, size):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)) * size
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plain = spark.createDataFrame([(i, (v / size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = lambda d: [(r.query_id, r["rank"], r.vec_id) for r in nearest(d, F.col("id") % 20 == 0).collect()]
    assert sorted(found(df)) == sorted(found(plain)) and len(found(df)) == 300


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[100:250] = x[7]  # one vector many times
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(400, None, "a"), (420, [0.0] * 8, "a"), (440, [float("nan")] * 8, "a"), (460, [1.0, None] * 4, "a"), (480, [1.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls string")
    got = {}
    for r in nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hit = 0
    for q, found in got.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:20]
        found.sort()
        hit += len({v for _, v, _ in found} & set(want.tolist()))
        assert [k for k, _, _ in found] == list(range(1, 21)) and np.allclose([c for _, _, c in found], s[[v for _, v, _ in found]])
    assert hit >= 0.9 * 20 * len(got)
    few = nearest(df.where("vec_id < 3"), F.col("id") % 20 == 0).collect()
    assert len(few) == 2 and nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_too_few_in_the_probed_lists(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "LEAST_PROBES", 1)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("id") % 200 == 0, top=300, probed_share=0.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        assert [v for _, v in sorted(found)] == np.lexsort((np.arange(400), -s))[:300].tolist()
    assert set(got) == {0, 200}
