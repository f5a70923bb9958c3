"""Language, toxicity and quality: exact parts against plain versions, the rest by held-out accuracy."""

import numpy as np
import pytest
from helpers import odd_documents
from pyspark.sql import functions as F

from tiercast.llm import language, quality, toxicity
from tiercast.llm.common import read

SF_DIR = "/root/testdata/sf0.01"


def test_the_automaton_reads_exactly_the_substrings():
    r = np.random.default_rng(1)
    for _ in range(30):
        text = bytes(r.integers(97, 100, r.integers(1, 25)).tolist())
        follow = language.suffix_automaton(text)

        def reads(s):
            state = 0
            for c in s:
                state = follow[state].get(c)
                if state is None:
                    return False
            return True

        for n in range(1, 6):
            for s in {bytes(r.integers(97, 100, n).tolist()) for _ in range(40)}:
                assert reads(s) == (s in text)


def plain_phrases(text, reference):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in reference and text[at : at + n] in reference:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrases_equal_plain_parsing():
    r = np.random.default_rng(2)
    draw = lambda n, k: bytes((97 + r.integers(0, k, n)).tolist())
    references = {"x": draw(300, 3), "y": draw(200, 5), "z": b"abcabcabc"}
    parser = language.CrossParser(references)
    texts = [draw(n, 7) for n in (1, 2, 30, 400, 512)] + [b"abc" * 50, b"\xff\xfe", b""]
    got = parser.phrases(texts)
    for text, row in zip(texts, got):
        assert row.tolist() == [plain_phrases(text, references[n]) for n in parser.languages]


@pytest.mark.parametrize("stretch, portion", [(512, 1 << 20), (7, 1 << 20), (16, 48), (1, 3)])
def test_phrases_run_across_stretches(monkeypatch, stretch, portion):
    """Whole texts, also where a stretch ends inside a phrase, a phrase spans stretches, or readings never fall into step."""
    monkeypatch.setattr(language, "STRETCH", stretch)
    monkeypatch.setattr(language, "PORTION", portion)
    r = np.random.default_rng(3)
    draw = lambda n, k: bytes((97 + r.integers(0, k, n)).tolist())
    references = {"x": draw(300, 3), "y": draw(2000, 5), "z": b"aaa b", "w": b"abc" * 70}
    parser = language.CrossParser(references)
    texts = [draw(n, 4) for n in (5, 1543, 40, 700, 16)] + [b"a" * 1200, b"abc" * 400, references["y"], b"", references["y"][300:1700] + b"aaaa", b"a b " * 90]
    for text, row in zip(texts, parser.phrases(texts)):
        assert row.tolist() == [plain_phrases(text, references[n]) for n in parser.languages]


def test_languages_of_held_out_documents(spark):
    docs = read(spark, SF_DIR, "documents")
    found = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n, low, high = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right / n > 0.97 and 0 <= low <= high <= 1


def test_language_reads_text_only(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    known = language.references(docs)
    other = docs.withColumns({"doc_id": -F.col("doc_id"), "lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    a = [(r.text, r.lang_pred, r.score) for r in language.identify(docs, known).collect()]
    assert sorted(a, key=str) == sorted(((r.text, r.lang_pred, r.score) for r in language.identify(other, known).collect()), key=str)


def test_languages_of_odd_rows(spark):
    docs = odd_documents(spark)
    train = docs.withColumn("lang", F.lit("en"))
    got = language.identify(docs.select("doc_id", "text"), language.references(train)).collect()
    unknown = {r.text for r in got if r.lang_pred == "und"}
    assert unknown == {None, "", " \n\t ", "!!! ???"} and len(got) == docs.count()
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    kept = language.with_language(train)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4 and {r.score for r in kept.collect()} == {"own"}
    assert language.predictions(docs.limit(0)).count() == 0


@pytest.mark.parametrize("run, label", [(toxicity.classify, "toxic"), (quality.ratings, "quality")])
def test_held_out_accuracy(spark, run, label):
    docs, labels = read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "labels")
    found = run(docs, labels)
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").where("held_out").collect()
    scores, truth = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    assert scores.min() >= 0 and scores.max() <= 1
    one, zero = scores[truth == 1], scores[truth == 0]
    assert (one[:, None] > zero[None, :]).mean() > 0.9


@pytest.mark.parametrize("run", [toxicity.classify, quality.ratings])
def test_odd_rows_and_labels(spark, run):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (6, None, None), (99, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = run(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert len(run(docs, labels.limit(0)).collect()) == docs.count()
    assert run(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("keep", [toxicity.clean, quality.select])
def test_kept_rows_keep_their_columns(spark, keep):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    kept = keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() and {(r.score, r.tail) for r in kept.collect()} == {("own", "t")}


def test_toxicity_needs_labels_only_from_its_folds(spark):
    docs, labels = read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "labels")
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_portions_change_no_feature(monkeypatch):
    text = "Some words, some more of them and ÄÖÜ. " * 40
    before = toxicity.buckets(text).tolist(), [x.tolist() for x in quality.features(text)]
    monkeypatch.setattr(toxicity, "PORTION", 17)
    monkeypatch.setattr(quality, "PORTION", 13)
    assert toxicity.buckets(text).tolist() == before[0]
    assert np.allclose(quality.features(text)[1], before[1][1]) and quality.features(text)[0].tolist() == before[1][0]


def test_ordered_grades():
    r = np.random.default_rng(0)
    sets = ["plain words here ", "SHOUTED WORDS!! ", "a | b | c | ", "0123 4567 "]
    texts = ["".join(r.choice([sets[g], sets[max(g - 1, 0)]], 12)) for g in range(4) for _ in range(60)]
    grades = [g for g in (1, 2, 4, 7) for _ in range(60)]
    model = quality.fit(texts, grades, quality.Fit(ridge=0.01, steps=400))
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [1, 2, 4, 7]
    means = [np.mean([model.rate(t, 4)[0] for t in texts[60 * k : 60 * k + 60]]) for k in range(4)]
    assert (np.diff(means) > 0).all()
    for t in texts[::17]:
        above = model.above(t)
        expected, tail = model.rate(t, 4)
        chances = -np.diff(np.concatenate(([1.0], above, [0.0])))
        assert (chances >= 0).all() and np.isclose(expected, chances @ [1, 2, 4, 7]) and np.isclose(tail, chances[2:].sum())
        assert model.rate(t, 8)[1] == 0.0 and model.rate(t, 0)[1] == 1.0


@pytest.mark.parametrize("label", [None, 0, 1])
def test_without_two_classes_no_document_is_called_toxic(spark, label):
    docs = odd_documents(spark)
    rows = [(i, label) for i in range(9)] if label is not None else []
    kept = toxicity.clean(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str)
