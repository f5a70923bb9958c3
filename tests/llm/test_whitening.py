"""Whitening against plain linear algebra and whole-number arithmetic."""

import math

import numpy as np
import pytest

from tiercast.llm import spectrum, whitening
from tiercast.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


def plain(rows):
    """(ids, x, n, sums, covariance) of the usable rows, with Python's whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    return [i for i, _ in kept], x, n, sums, y, y.T @ y / n


def check(got, rows, components=8):
    ids, x, n, sums, y, v = plain(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(ids) * components
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, components + 1))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-9
    deviation = {}
    for i, row in zip(ids, x):
        deviation.setdefault(i, []).append(sum((n * c - s) ** 2 for c, s in zip(row, sums)))
    for k in range(components):
        own = [r for r in got if r.component == k + 1]
        assert all(abs(r.explained - values[k] / np.trace(v)) <= 1e-9 for r in own)
        want = y @ vectors[:, k] / math.sqrt(values[k])
        by_id, expected = {}, {}
        for r in own:
            by_id.setdefault(r.vec_id, []).append((r.whitened, r.deviation))
        for i, w in zip(ids, want):
            expected.setdefault(i, []).append(w)
        sign = np.sign(sum(sorted(w for w, _ in by_id[i])[0] * sorted(expected[i])[0] for i in by_id if len(by_id[i]) == 1))
        for i, found in by_id.items():
            assert sorted(w for w, _ in found) == pytest.approx(sorted(sign * w for w in expected[i]), abs=1e-7)
            assert sorted(d for _, d in found) == sorted(deviation[i])


def test_a_table(spark):
    table = read(spark, SF_DIR, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(whitening.whiten(table.repartition(5)).collect(), rows)


NAN, INF = float("nan"), float("inf")
ODD = [
    (1, [1.0, 2.0, 0.5]), (2, [-1.0, 0.25, 3.0]), (3, None), (4, [1.0, None, 0.0]), (5, [NAN, 0.0, 1.0]), (6, [INF, 0.0, 1.0]),
    (7, [0.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (None, [4.0, -2.0, 1.0]), (8, [0.1, -0.1, 9.75]), (9, [0.3, 0.7, -0.2]),
]


def test_odd_rows_and_clashing_columns(spark):
    table = spark.createDataFrame(
        [(i, v, "c", 1, "v", 2) for i, v in ODD],
        "vec_id long, embedding array<float>, component string, n int, vector string, at int")
    check(whitening.whiten(table).collect(), [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in ODD], 3)


def test_other_lengths_stay_out(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(10)]
    table = spark.createDataFrame(rows + [(90, []), (91, [1.0]), (92, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    check(whitening.whiten(table).collect(), rows, 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_tables_without_any_spread_give_no_rows(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.collect() == []
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_vectors_on_a_line_have_one_component(spark):
    rows = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(40)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows, 1)


def test_huge_entries_and_sums_beyond_64_bits(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3.4e12, 2.0])]
    fitted = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[min(max(math.floor(1024 * c) + 100_000, -whitening.LIMIT), whitening.LIMIT) for c in v] for _, v in rows]
    assert fitted.sums == [sum(c) for c in zip(*x)]
    got = whitening.project(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), fitted).collect()
    assert {r.vec_id: int(r.deviation) for r in got} == {
        i: sum((3 * c - s) ** 2 for c, s in zip(row, fitted.sums)) for (i, _), row in zip(rows, x)}


def test_exact_squares():
    r = np.random.default_rng(5)
    off = r.integers(-(1 << 51), 1 << 51, (20, 30))
    assert whitening._square_sums(off) == [sum(int(v) ** 2 for v in row) for row in off]


@pytest.mark.parametrize("spread", [
    np.arange(30.0), 10.0 ** -np.arange(30.0), np.repeat([9.0, 9.0, 9.0, 5.0, 5.0, 1.0], 5), np.ones(30),
    np.r_[[3, 3 - 1e-11, 3 - 1e-8, 3 - 1e-5, 2, 2], np.full(24, 0.5)], np.r_[[7.0], np.zeros(29)], np.zeros(30)])
def test_eigenpairs(spread):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((30, 30)))[0]
    a = (q * spread) @ q.T
    values, vectors = spectrum.leading(a, 8)
    top = np.sort(spread)[::-1][:8]
    assert len(values) == (top > 1e-13 * max(top[0], 1e-300)).sum()
    assert np.allclose(values, top[: len(values)], rtol=0, atol=1e-13 * top[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-13 * max(top[0], 1.0)


@pytest.mark.parametrize("seed", range(6))
def test_counts_are_the_inertia(seed):
    r = np.random.default_rng(seed)
    a = r.standard_normal((25, 25))
    a = a + a.T - np.diag(np.diag(a)) * (seed % 2)  # with zeros on the diagonal, too
    for shift in (-3.0, 0.0, 0.5, 4.0):
        assert spectrum.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


def test_a_wrong_number_is_found(monkeypatch):
    a = np.diag(np.arange(1.0, 11.0))
    monkeypatch.setattr(spectrum, "_rayleigh", lambda *args: (5.0, np.eye(10)[4]))
    with pytest.raises(spectrum.Uncertified):
        spectrum.leading(a, 3)
