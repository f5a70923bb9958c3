"""Every stage against a brute-force version on what its predecessor kept."""

import numpy as np
import pytest
from helpers import closure, contamination, fingerprint, odd_documents

import corpus_pipeline
from tiercast.llm.common import read
from tiercast.llm import language, toxicity

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, SF_DIR, "documents").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF_DIR).cache())
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "decontamination", "packing"]
    for kept in stages[1:-1]:
        assert kept.dtypes == stages[0].dtypes
    text = {r.doc_id: r for r in stages[0].collect()}
    for kept in stages[1:-1]:
        assert all(r == text[r.doc_id] for r in kept.collect())


def test_toxicity(spark, stages):
    model = toxicity.train(stages[0], read(spark, SF_DIR, "labels"))
    assert ids(stages[1]) == sorted(r.doc_id for r in stages[0].collect() if model.score(r.text or "") < 0.5)


def test_language(stages):
    known = language.references(stages[1])
    parser = language.CrossParser(known)
    assert ids(stages[2]) == sorted(r.doc_id for r in stages[1].collect() if parser.decide([r.text or ""])[0][0] != "und")


def test_near_copies(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    fps = [fingerprint(t) for _, t in rows]
    root = closure(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert ids(stages[3]) == sorted({rows[r][0] for r in root})


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in read(spark, SF_DIR, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in stages[3].collect()]
    assert ids(stages[4]) == sorted(r[0] for r in contamination(rows, items) if not r[-1])


def test_packing(stages):
    pieces = stages[5].collect()
    assert {p.doc_id for p in pieces} == set(ids(stages[4]))
    stream = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = [s * 2048 + o for s, o, _ in stream]
    assert at == np.cumsum([0, *(n for _, _, n in stream)])[:-1].tolist()


def test_run_equals_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start)
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect(), key=key) == sorted(stages[5].collect(), key=key)


def test_odd_rows_pass_every_stage(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.dtypes == docs.dtypes
        assert 0 < kept.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
    near = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert sorted(r.doc_id for r in near.where("doc_id is not null").collect()) == [1, 2, 5, 5, 6, 7, 8]
    assert sorted(r.text for r in near.where("doc_id = 5").collect()) == ["another word", "word"]
    assert near.where("doc_id is null").count() == 1
    again = corpus_pipeline.drop_near_copies(spark, docs.repartition(7), SF_DIR)
    assert sorted(map(str, again.collect())) == sorted(map(str, near.collect()))
