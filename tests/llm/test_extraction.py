"""Main text against the pages' own markup, rendered pages, and enumeration of all choices."""

import html
import itertools
import re
import time

import numpy as np
import pytest

from tiercast.llm import extraction
from tiercast.llm.common import read
from tiercast.llm import dom
from tiercast.llm.dom import LEAF, parse

SF_DIR = "/root/testdata/sf0.001"


def article(source):
    """The blocks of the pages' one <article>."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
    blocks = [re.sub(r"<br>", " ", b) for b in re.split(r"</?(?:p|h1)>", inside)]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_a_table(spark):
    pages = read(spark, SF_DIR, "pages")
    want = {r.page_id: (r.url, article(r.html), len(article(r.html))) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extraction.main_texts(pages).collect()}
    assert got == want


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train([r.html for r in read(spark, SF_DIR, "pages").collect()])


def test_rendered_pages_not_seen_in_training(model):
    prose = ["Quite another text, with words of its own and a few sentences. It goes on for a while, and then it ends."] * 3
    renderer = extraction.Renderer(prose, ["x"], seed=12345)
    hits = words = found = 0
    for _ in range(150):
        source = renderer.page()
        page = parse(source)
        want = [t for t, k, g in zip(page.text, page.kept, page.tag) if g == LEAF and k]
        got = model.extract([source])[0].split("\n")
        hits += sum(t in got for t in want)
        words += len(want)
        found += len([g for g in got if g])
    assert hits / words > 0.9 and hits / found > 0.85


ODD = [
    (1, None, ""), (2, "", ""), (3, "<html><body></body></html>", ""), (4, "<script>var x = '<p>no</p>';", ""), (5, "<!-- <p>never closed", ""),
    (6, "<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One  two,\n three. And four&nbsp;five.<p>Six <b>se</b>ven.</article><footer>F</footer>",
     "T & U\nOne two, three. And four five.\nSix seven."),
    (6, "<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One  two,\n three. And four&nbsp;five.<p>Six <b>se</b>ven.</article><footer>F</footer>",
     "T & U\nOne two, three. And four five.\nSix seven."),
]


def test_odd_pages(spark):
    rows = spark.createDataFrame([(i, None, h, "own") for i, h, _ in ODD], "page_id long, url string, html string, text string")
    pages = rows.unionByName(read(spark, SF_DIR, "pages").selectExpr("-1 - page_id as page_id", "url", "html", "'x' as text"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in extraction.main_texts(pages).where("page_id > 0").collect())
    assert got == sorted((i, t, len(t)) for i, _, t in ODD)
    assert extraction.main_texts(rows.limit(0)).count() == 0
    assert extraction.extract(rows.drop("text")).columns == ["page_id", "url", "html", "text", "n_chars"]


def test_deep_and_broken_pages_do_not_fail(model):
    for source in ["<div>" * 20_000 + "x", "</p></div>" * 5000, '<p title="' * 3000, "<" * 5000, "<p>" + "word " * 200_000, "<a <b <i>x</i></a>", "&#xfffffff; &bogus; &lt"]:
        assert len(model.extract([source])) == 1


def test_the_tree():
    page = parse("<p>a<p>b<ul><li>c<li>d <i>e</i></ul>f<table><tr><td>g<td>h</table><script>no</script>z")
    assert [t for t in page.text if t] == ["a", "b", "c", "d e", "f", "g", "h", "z"]
    for i in range(1, len(page.tag)):
        assert page.parent[i] < i < page.end[i] <= page.end[page.parent[i]]


def test_decoding_is_the_likeliest_choice_without_contradictions():
    r = np.random.default_rng(3)
    for source in ["<div><p>a</p><div><p>b</p></div></div><p>c</p>", "a<div>b<p>c</div>d", "<ul><li>a<li>b<li>c</ul>"]:
        page = parse(source)
        n = len(page.tag)
        for _ in range(30):
            z = r.normal(0, 2, n)
            p = 1 / (1 + np.exp(-z))
            best, choice = -np.inf, None
            for keep in itertools.product((False, True), repeat=n):
                if all(not keep[i] or keep[page.parent[i]] for i in range(1, n)):
                    total = np.log(np.where(keep, p, 1 - p)).sum()
                    if total > best:
                        best, choice = total, keep
            assert extraction.decode(page, z) == [t for t, k in zip(page.text, choice) if t and k]


def test_boosting_learns_a_rule():
    r = np.random.default_rng(0)
    x = r.random((2000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = extraction.boost(x[:1500], y[:1500], extraction.Fit())
    assert ((trees.logits(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.97


@pytest.mark.parametrize("inside, want", [
    ("<p>a</p><svg viewBox='0 0 1 1'/><p>b</p>", ["a", "b"]), ("<p>a</p><math/><p>b</p>", ["a", "b"]),
    ("<p>a</p><object data=x /><p>b</p>", ["a", "b"]), ("<p>a</p><noscript><p>b</p>", ["a", "b"]),
    ("<p>a</p><select><p>b</p>", ["a", "b"]), ("<p>a</p><template><p>b</p>", ["a", "b"]),
    ("<p>a</p><iframe src=x><p>b</p>", ["a", "b"]), ("<p>a</p><svg><path d='M0'/><p>b</p>", ["a", "b"]),
    ("<p>a</p><noscript><p>b</p></noscript><p>c</p>", ["a", "b", "c"]), ("<object><p>a</p></object>", ["a"]),
    ("<p>as <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", ["as x=1 holds"]),
    ("<p>a <svg><title>t</title><path d='M0'/></svg> b</p>", ["a b"]), ("<p>a<noscript><img src=x></noscript>b</p>", ["a b"]),
    ("<p>a</p><svg><text>b</text><style/><circle r=1 /></svg><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><iframe>no</iframe><textarea><p>no</textarea><title>no</title><script>no</script><p>b</p>", ["a", "b"]),
])
def test_no_text_is_lost_by_its_element(inside, want):
    page = parse(f"<nav>n</nav><article>{inside}</article><footer>f</footer>")
    assert [t for t in page.text if t] == ["n", *want, "f"]
    at = page.tag.index("article")
    assert [t for t in page.text[at : page.end[at]] if t] == want


def test_many_unclosed_elements_take_no_long_time():
    for tag in ("svg", "math", "object", "select", "noscript", "template", "iframe", "textarea", "title"):
        assert parse(f"<{tag}>" * 20_000 + "x").text[-1] == "x"


@pytest.mark.parametrize("junk", [
    "<a" * 500_000, "<b>" + "<div>" * 140_000 + "</b>" * 60_000, "<p><table>" + "<i>" * 100_000 + "<div></div>" * 50_000,
    '<a "' * 250_000, "<ul><li>" * 60_000 + "</li>" * 100_000])
def test_a_megabyte_of_junk_is_parsed_in_no_time(junk):
    start = time.process_time()
    page = dom.parse(junk + "<p>end")
    assert time.process_time() - start < 10 and "end" in page.text
