"""SimHash groups, components and embedding links against all pairs."""

import math
import random

import numpy as np
import pytest
from helpers import closure, fingerprint, odd_documents
from pyspark.sql import functions as F

from tiercast.llm import embeddings, simhash
from tiercast.llm.common import read
from tiercast.llm.components import components

SF_DIR = "/root/testdata/sf0.001"


def test_fingerprints_of_odd_texts():
    for t in ["", "a", "a b", "A b  C d", "x " * 50, "é Ü " * 9, " one\x0btwo\x0cthree four five\r\nsix "]:
        assert simhash.fingerprint(t) == fingerprint(t), t


def all_pairs(rows, bits=4):
    fps = [fingerprint(t) for _, t in rows]
    root = closure(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= bits)
    least = {}
    for (doc_id, _), r in zip(rows, root):
        least[r] = min(least.get(r, doc_id), doc_id)
    return {(d, "%016x" % f, least[r]) for (d, _), f, r in zip(rows, fps, root)}


def test_groups_of_a_table(spark):
    docs = read(spark, SF_DIR, "documents")
    got = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert got == all_pairs([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    named = [(r.doc_id, r.text) for r in docs.where("doc_id is not null and doc_id <> 5").collect()]
    assert {tuple(r) for r in got if r.doc_id not in (None, 5)} == all_pairs(named)
    assert {r.component_id for r in got if r.doc_id is None} == {None} and {r.component_id for r in got if r.doc_id == 5} == {5}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def crowded(n=600, seed=5):
    """Fingerprints that agree on most bits, so that block groups are crowded, and chains between them."""
    r = random.Random(seed)
    base, out = r.getrandbits(64), set()
    while len(out) < n:
        fp = base
        for _ in range(r.choice((2, 3, 9, 14, 25))):
            fp ^= 1 << r.randrange(64)
        out.add(fp)
    return sorted(out)


@pytest.mark.parametrize("group", [24, 200, 4096])
def test_links_do_not_depend_on_the_group_size(spark, group):
    fps = crowded()
    rows = [(i, simhash._signed(f)) for i, f in enumerate(fps)]
    found = simhash.links(spark.createDataFrame(rows, "node long, fp long"), group=group)
    pairs = {(r.a, r.b) for r in found.collect()}
    assert all(a in range(len(fps)) and b in range(len(fps)) for a, b in pairs)
    joined = {r.node: r.component for r in components(found).collect()}
    want = closure(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [joined.get(i, i) for i in range(len(fps))] == want
    held = simhash.groups(spark.createDataFrame(rows, "node long, fp long"), group=group).groupBy("mask", "value", "first", "second").count()
    assert held.agg(F.max("count")).first()[0] <= 2 * group


def test_the_index_finds_exactly_the_pairs_within_the_distance():
    fps = np.array(sorted(crowded(300), key=lambda f: int(f)), np.uint64)
    index = simhash.GrayIndex(np.repeat([0, 1, 2], [100, 1, 199]), fps)
    got = {(int(i), int(j)) for a, b in index.links(4) for i, j in zip(a, b)}
    side = lambda i: 0 if i < 100 else 1 if i < 101 else 2
    assert got == {(i, j) for j in range(300) for i in range(j) if side(i) == side(j) and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(400, 450)] + [(9, 9), (None, 3), (70, 71), (71, 70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 400 for i in [500, *range(400, 450)]} | {70: 70, 71: 70}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(seed=2, size=24):
    """Random vectors, near copies round the threshold, a crowd of near copies, copies, and unusable rows."""
    r = np.random.default_rng(seed)
    rows = [v for v in r.standard_normal((150, size))]
    for cos in (0.94, 0.951, 0.97, 0.99, 0.999):
        for v in rows[:20]:
            w = r.standard_normal(size)
            w -= (w @ v) / (v @ v) * v
            rows.append(3 * (cos * v / np.linalg.norm(v) + math.sqrt(1 - cos**2) * w / np.linalg.norm(w)))
    rows += [rows[0] + 0.05 * r.standard_normal(size) for _ in range(120)] + [rows[1]] * 40
    rows = [v.tolist() for v in rows]
    return rows + [None, [], [0.0] * size, [float("nan")] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), [float("inf")] * size, [1.0, 2.0], [1.0, 2.0]]


def cosines(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v)
        return v / np.linalg.norm(v)

    units = [unit(v) for v in rows]
    return lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95


@pytest.mark.parametrize("block", [16, 2048])
def test_embedding_links(spark, block, monkeypatch):
    rows = planted()
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, node int")
    whole = embeddings.link_rows
    monkeypatch.setattr(embeddings, "link_rows", lambda d, t: whole(d, t, block))
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    linked = cosines(rows)
    counts = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    assert len(got) == len(rows)
    assert all(got[i].n_links <= counts[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(counts)
    root = closure(len(rows), linked)
    assert np.mean([got[i].component_id == root[i] for i in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_of_odd_tables(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [0.0, 1.0]), (9, None), (9, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(table).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True)], key=str)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("number", [256, 1024, 4096])
def test_pairs_at_the_threshold_share_pivots_at_every_number(spark, number):
    r = np.random.default_rng(4)
    x, y = r.standard_normal((2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, y)))]
    reps = spark.createDataFrame(rows, "node long, vector array<double>, weight long")
    told = embeddings.describe(reps, embeddings.Pivots(least=number, sample=0))  # pivots apart from the pairs
    lists = {n: set(k) for n, k in told.select("node", embeddings._lists(F.col("pivots"))).collect()}
    assert np.mean([not lists[i].isdisjoint(lists[i + 1500]) for i in range(1500)]) > 0.965


@pytest.mark.parametrize("common", [0.0, 0.75, 0.9])
def test_cones_are_parted_and_planted_pairs_found(common):
    """Vectors with a common direction: lists stay short, and pairs at the threshold share a list."""
    r = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = np.zeros(64)
    base[3] = 1
    x = unit(math.sqrt(common) * base + math.sqrt(1 - common) * unit(r.standard_normal((6000, 64))))
    index = embeddings.fit(x[:2048], 256, 64, embeddings.Pivots())
    aside = r.standard_normal((1000, 64))
    aside -= (aside * x[-1000:]).sum(1, keepdims=True) * x[-1000:]
    copies = 0.95 * x[-1000:] + math.sqrt(1 - 0.95**2) * unit(aside)
    share = [len(set(a) & set(b)) >= 2 for a, b in zip(index.order(x[-1000:]).tolist(), index.order(unit(copies)).tolist())]
    assert np.mean(share) > 0.955
    p = np.sort(index.order(x), axis=1)
    i, j = np.triu_indices(p.shape[1], 1)
    lengths = np.unique(p[:, i] * 256 + p[:, j], return_counts=True)[1].astype(float)
    assert (lengths * (lengths - 1) / 2).sum() < (0.04 if common < 0.9 else 0.25) * 6000 * 5999 / 2


def test_the_index_of_few_dimensions_or_one_vector():
    for sample in (np.empty((0, 2)), np.array([[0.0, 3.0]]), np.array([[1.0, 0.0], [0.0, 1.0]]), np.eye(3), np.ones((4, 1))):
        index = embeddings.fit(sample, 256, sample.shape[1], embeddings.Pivots())
        assert embeddings.NEAREST <= index.nearest <= embeddings.MOST and index.pivots.shape[1] == sample.shape[1]
        assert np.isfinite(index.pivots).all()
    how = embeddings.Pivots(held=1 << 20)
    assert how.number(10**9, 1024) * 1024 * 8 <= 1 << 20 and how.drawn(128, 1024) == 128
