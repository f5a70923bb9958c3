"""Document quality by ordinal cumulative-link regression on graded ratings.

One set of weights over hashed text features is shared by all grades; ordered
thresholds cut the resulting line into grades: the chance of a grade above the
k-th is sigmoid(w.x - threshold_k). From these come the expected grade and the
tail probability of reaching a wanted grade, by which documents are selected.

Features are hashed character trigrams, case and marks included, by the root of
their share, and two words of their own for the text's length and its share of
distinct words. The model is fitted on a bounded sample of rated rows
(``Sample``); every whole text is read for its rating.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drawn, held_out, learnable, restored, set_aside, ship, slices, text_column

FOLDS, HELD = 5, 0
BUCKET_BITS = 16
#: Characters of a text hashed at once; bounds memory on very long texts, changes no feature.
PORTION = 1 << 20
_STEPS = 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sample:
    """Bound of the fit: rated rows of each grade, grades, and the longest text among them, in characters."""

    rows_per_grade: int = 1200
    grades: int = 20
    longest: int = 20_000


@dataclass(frozen=True)
class Fit:
    ridge: float = 2.0
    steps: int = 120
    rate: float = 0.1


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text: ascending distinct buckets, none for an empty text."""
    if not text:
        return np.empty(0, np.int64), np.empty(0)
    size = 1 << BUCKET_BITS
    counts = np.zeros(size)
    whole = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    for start in range(0, len(whole) - 2, PORTION):
        c = whole[start : start + PORTION + 2].astype(np.uint64)
        grams = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
        counts += np.bincount(((grams * _MULTIPLIER) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=size)
    counts /= len(whole) - 2
    words = text.split()
    distinct = len(set(words)) / len(words) if words else 0.0
    for kind, step in ((1, min(int(np.log2(len(text) + 1)), _STEPS)), (2, int(distinct * _STEPS))):
        counts[(kind * 40 + step) * 2654435761 % size] += 1.0
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at])


class Model:
    """Weights by bucket, ascending thresholds, and the grades they part."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def above(self, text: str) -> np.ndarray:
        """Chance of a grade above each grade but the last; descending."""
        at, x = features(text)
        z = self.weights[at] @ x
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -500, 500)))

    def rate(self, text: str, wanted: int) -> tuple[float, float]:
        """(expected grade, chance of a grade of ``wanted`` or more)."""
        above = self.above(text)
        expected = self.grades[0] + float(np.diff(self.grades) @ above)
        reached = [g >= wanted for g in self.grades]
        first = reached.index(True) if any(reached) else None
        tail = 0.0 if first is None else 1.0 if first == 0 else float(above[first - 1])
        return expected, tail


def fit(texts: list[str], ratings: list[int], how: Fit = Fit()) -> Model:
    """The model of rated texts. With one grade all texts have it; without ratings the only grade is 0."""
    grades = sorted(set(ratings)) or [0]
    if len(grades) == 1:
        return Model(np.zeros(1 << BUCKET_BITS), np.empty(0), grades)
    y = np.searchsorted(grades, ratings)
    n, k = len(y), len(grades)
    found = [features(t) for t in texts]
    rows = np.repeat(np.arange(n), [len(f[0]) for f in found])
    used, columns = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    x = np.concatenate([f[1] for f in found])
    share = np.array([(y <= g).mean() for g in range(k - 1)])
    cut = np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(cut), 1e-3))
    beside = np.concatenate((np.zeros(len(used)), cut[:1], steps))
    mean, square = np.zeros(len(beside)), np.zeros(len(beside))
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    m = len(used)
    for step in range(1, how.steps + 1):  # Adam on the regularised likelihood
        w = beside[:m]
        cut = beside[m] + np.concatenate(([0.0], np.cumsum(np.exp(beside[m + 1 :]))))
        z = np.bincount(rows, x * w[columns], n)
        below = sigmoid(np.concatenate((cut, [np.inf]))[y] - z)
        lower = np.where(y > 0, sigmoid(cut[np.maximum(y - 1, 0)] - z), 0.0)
        chance = np.maximum(below - lower, 1e-12)
        up, down = below * (1 - below) / chance, lower * (1 - lower) / chance
        off = (up - down) / n
        by_cut = (np.bincount(y, down, k)[1:] - np.bincount(y, up, k)[:-1]) / n
        tail = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate((
            np.bincount(columns, x * off[rows], m) + how.ridge * w / n, tail[:1], np.exp(beside[m + 1 :]) * tail[1:]))
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        beside = beside - how.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(1 << BUCKET_BITS)
    weights[used] = beside[:m]
    return Model(weights, beside[m] + np.concatenate(([0.0], np.cumsum(np.exp(beside[m + 1 :])))), grades)


def train(docs: DataFrame, ratings: DataFrame, grade: str = "quality", sample: Sample = Sample(), how: Fit = Fit()) -> Model:
    """Fit on a share of the learnable rated rows of each grade, drawn by the hash of their ids.

    The share makes about ``rows_per_grade`` rows. Null ids, grades and texts teach nothing; of
    repeated ratings the largest counts, of repeated documents the text that sorts first. More
    than ``sample.grades`` grades are refused.
    """
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade"))
    rated = rated.where(learnable("doc_id", FOLDS, HELD) & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    counts = rated.groupBy("grade").agg(F.count("*").alias("n")).limit(sample.grades + 1).collect()
    if len(counts) > sample.grades:
        raise ValueError(f"more than {sample.grades} grades")
    share = F.lit(1.0)
    for r in counts:
        share = F.when(F.col("grade") == r.grade, sample.rows_per_grade / r.n).otherwise(share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # About rows_per_grade ids a grade, whatever the data: the broadcast and what comes back are bounded.
    rows = texts.where(F.length("text") <= sample.longest).join(F.broadcast(rated.where(drawn(share, "doc_id"))), "doc_id")
    found = sorted(rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).collect())
    return fit([r.text for r in found], [r.grade for r in found], how)


def rate(docs: DataFrame, model: Model, wanted: int) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail``, the chance of a grade of ``wanted`` or more.

    Null and empty texts are rated by the thresholds alone. Every row is rated
    on its own text; columns of the two names are replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("expected_grade", "tail").withColumns({"expected_grade": F.lit(0.0), "tail": F.lit(0.0)})
    keep = rows.columns[:-2]

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grades, tails = zip(*(shared.value.rate(t, wanted) for t in text_column(batch, "text")))
            added = [pa.array(grades, pa.float64()), pa.array(tails, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], names=[*keep, "expected_grade", "tail"])

    return rows.mapInArrow(rated, rows.schema)


def ratings(docs: DataFrame, rated: DataFrame, wanted: int = 1, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, score (the tail probability) and selected for every document.

    An empty table gives no rows; a row with a null doc_id is rated and not held out.
    Very long texts are rated whole, a portion at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rate(rows, train(docs, rated), wanted)
    return found.select(
        "doc_id", held_out("doc_id", FOLDS, HELD).alias("held_out"), "expected_grade",
        F.col("tail").alias("score"), (F.col("tail") >= least).alias("selected"))


def select(docs: DataFrame, rated: DataFrame, wanted: int = 1, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that reach the grade ``wanted`` with a chance of ``least``, with their columns."""
    aside = set_aside(docs, "expected_grade", "tail")
    return restored(rate(aside, train(docs, rated), wanted).where(F.col("tail") >= least), docs)
