"""Benchmark passages and url rules against plain versions."""

import time

import numpy as np
import pytest
from helpers import contamination, odd_documents
from pyspark.sql import functions as F

from compare import connect, differences
from tiercast.llm import decontamination, urls
from tiercast.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def test_a_table(spark):
    docs, benchmark = read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "benchmark")
    got = sorted(tuple(r) for r in decontamination.verdicts(docs, benchmark).collect())
    want = sorted(contamination(pairs(docs, "doc_id"), pairs(benchmark, "item_id")))
    assert got == want and any(r[-1] for r in want)


def test_passages_equal_sql(spark):
    got = decontamination.verdicts(read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "benchmark"))
    assert differences(got, connect(SF_DIR), decontamination.ORACLE) is None


ITEMS = [(1, "plain TEXT of a few"), (2, "word"), (3, None), (4, " ., "), (None, "no id here"), (10, "very long text word of a very long text word of a very long text"), (1, "plain TEXT of a few")]


@pytest.mark.parametrize("pass_words", [1, 6, 1000])
def test_odd_rows_and_several_passes(spark, pass_words):
    docs = odd_documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.judge(decontamination.find(docs.select("doc_id", "text"), items, pass_words=pass_words))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()]
    want = contamination(pairs(docs, "doc_id"), [("null" if i is None else i, t) for i, t in ITEMS])
    assert sorted(got, key=str) == sorted(want, key=str)


def test_portions_are_bounded_and_a_worker_holds_one(spark):
    """Ten portions and more, a long item among them: every one near its size, one table alive, results as in one pass."""
    r = np.random.default_rng(11)
    draw = lambda n: " ".join(f"w{k}" for k in r.integers(0, 40, n))
    texts = [draw(n) for n in (6_000, 40, 13, 12, 5, 900, 2_000, 300, 300, 300)]
    items = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "item_id long, text string")
    folders = decontamination.portions(items, pass_words=900)
    sizes = [sum(row.words.count(b" ") + 1 for row in spark.read.parquet(f).collect()) for f in folders]
    assert len(folders) >= 10 and max(sizes) < 4 * 900
    for f in folders:
        decontamination._tables(f, 13)
        assert len(decontamination._built) == 1
    rows = [(i, draw(50) + " " + " ".join(t.split()[a : a + 20]) + " " + draw(9), "r") for i, (t, a) in enumerate(zip(texts, (5_000, 3, 0, 0, 0, 880, 6, 1, 2, 3)))]
    docs = spark.createDataFrame([*rows, (None, None, "r"), (3, rows[3][1], "r")], "doc_id long, text string, __row string")
    many = decontamination.find(docs, items, pass_words=900)
    assert many.columns == ["doc_id", "text", "__row", "n_words", "hits", "items"]
    got, one = (sorted(map(str, x.collect())) for x in (many, decontamination.find(docs, items)))
    assert got == one
    found = decontamination.judge(many)
    want = contamination(pairs(docs, "doc_id"), pairs(items, "item_id"))
    keys = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(x[k] for k in keys) for x in found.collect()), key=str) == sorted(want, key=str)


def test_clean_rows_keep_their_columns(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.hits for r in kept.collect()} == {"h"}
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0


def test_random_words():
    r = np.random.default_rng(4)
    draw = lambda n: [b"%d" % w for w in r.integers(0, 4, n)]
    items = [(str(i), draw(r.integers(1, 9))) for i in range(12)]
    search = decontamination.WuManber(items, window=4)
    for _ in range(200):
        w = draw(r.integers(0, 30))
        spans, found = search.search(w)
        want = set()
        for item, words in items:
            for k in range(max(1, len(words) - 3)):
                p = words[k : k + 4]
                want |= {(i, i + len(p), item) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p}
        assert set(spans) == {s[:2] for s in want} and found == {s[2] for s in want}


def test_rules_equal_sql(spark):
    got = urls.verdicts(read(spark, SF_DIR, "pages"))
    assert differences(got, connect(SF_DIR), urls.ORACLE) is None


URLS = [
    (1, "http://a.NET/x", "a.net", "/x", "net/", "block"), (2, "http://net", "net", "", None, "allow"), (3, None, "", "", None, "allow"),
    (4, "no scheme net/", "", "", None, "allow"), (5, "x://EXAMPLE.net/en/?q", "example.net", "/en/", "example.net/en/", "allow"),
    (6, "x://www.example.net/english", "www.example.net", "/english", "net/", "block"), (7, "x://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    (8, "x://a.example.com/de/#://b.net/", "a.example.com", "/de/", "example.com/de/", "block"), (9, "", "", "", None, "allow"),
    (10, "://y.org/fr/" + "z" * 100_000, "y.org", "/fr/" + "z" * 100_000, "org/fr/", "allow"), (10, "x://net:80/", "net:80", "/", None, "allow"),
    (None, "http://.net/", ".net", "/", "net/", "block"), (11, "x://É.net/ü", "É.net", "/ü", "net/", "block"),
]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(u[0], u[1], "r") for u in URLS], "page_id long, url string, rule string")
    got = sorted((tuple(r) for r in urls.verdicts(pages).collect()), key=str)
    assert got == sorted(((u[0], *u[2:]) for u in URLS), key=str)
    assert urls.verdicts(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_collisions_do_not_decide(tmp_path):
    same = lambda text: len(text) % 3
    urls.write_digests(str(tmp_path / "d"), [("net", "/", "block"), ("org", "/", "allow"), ("a.b", "/cd/", "block")], same)
    judge = urls.Digests(str(tmp_path / "d"), same).judge
    hosts = [("net", "/"), ("com", "/"), ("org", "/"), ("x.a.b", "/cd/e"), ("x.a.b", "/ce/")]
    assert judge(hosts) == [("net/", "block"), (None, "allow"), ("org/", "allow"), ("a.b/cd/", "block"), (None, "allow")]


def test_many_rules(tmp_path):
    rules = [(f"h{i}.example", f"/{'p' * (i % 4)}", "block" if i % 2 else "allow") for i in range(5000)]
    urls.write_digests(str(tmp_path / "d"), rules)
    got = urls.Digests(str(tmp_path / "d")).judge([(f"www.{h}", p + "rest") for h, p, _ in rules])
    assert got == [(h + p, v) for h, p, v in rules]


def test_hosts_of_a_megabyte(tmp_path):
    urls.write_digests(str(tmp_path / "d"), urls.RULES)
    digests = urls.Digests(str(tmp_path / "d"))
    start = time.process_time()
    got = digests.judge([("a." * 500_000 + "example.com", "/de/x"), ("a" * 1_000_000, "/de/x"), ("." * 1_000_000, "/"), ("x." * 400_000 + "www.example.net", "/en/")])
    assert time.process_time() - start < 5
    assert got == [("example.com/de/", "block"), (None, "allow"), (None, "allow"), ("example.net/en/", "allow")]
