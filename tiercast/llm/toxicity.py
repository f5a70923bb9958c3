"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its lower-cased character n-grams, hashed into buckets.
From labelled texts each bucket gets the log ratio of the smoothed share of
toxic texts that hold it to that of the others. A logistic regression is then
fitted on features of that size, so a bucket starts out as strong as the labels
make it and regularisation works against buckets that tell little.

The model is fitted on a bounded sample of labelled rows (``Sample``); scores
read every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drawn, held_out, learnable, restored, set_aside, ship, slices, text_column

ORDERS = (3, 4, 5)
BUCKET_BITS = 20
#: Characters of a text hashed at once; bounds memory on very long texts, changes no bucket.
PORTION = 1 << 18
#: Labels are learnt from rows whose crc32 of the id, modulo FOLDS, is not HELD.
FOLDS, HELD = 5, 0

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Sample:
    """Bound of the fit: labelled rows of each class, and the longest text among them, in characters."""

    rows_per_class: int = 1500
    longest: int = 20_000


@dataclass(frozen=True)
class Fit:
    """Buckets kept need ``least`` texts; the ``features`` of the strongest ratios are fitted."""

    smoothing: float = 1.0
    least: int = 4
    features: int = 12_000
    ridge: float = 1.0
    steps: int = 100
    rate: float = 0.08


def buckets(text: str, keep: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the n-grams of ``text``; with ``keep`` (a flag per bucket) only those flagged."""
    whole = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32)
    found = []
    for start in range(0, len(whole), PORTION):
        codes = whole[start : start + PORTION + max(ORDERS) - 1].astype(np.uint64)
        rolled = codes * _BASE
        for n in range(2, min(max(ORDERS), len(codes)) + 1):
            rolled = (rolled[: len(codes) - n + 1] + codes[n - 1 :]) * _BASE
            if n in ORDERS:
                mixed = (rolled ^ (rolled >> np.uint64(29))) * (_MULTIPLIER + np.uint64(2 * n))
                bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                found.append(np.unique(bucket) if keep is None else np.unique(bucket[keep[bucket]]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


class Model:
    """``weight`` per bucket (zero where it says nothing) and the bias; ``learnt`` if the fit saw both classes."""

    def __init__(self, weight: np.ndarray, bias: float, learnt: bool = True):
        self.learnt = learnt
        self.used = np.flatnonzero(weight).astype(np.int32)
        self.values = weight[self.used].astype(np.float64)
        self.bias = float(bias)
        self._dense = None

    def __getstate__(self):
        return {"used": self.used, "values": self.values, "bias": self.bias, "learnt": self.learnt, "_dense": None}

    def score(self, text: str) -> float:
        if self._dense is None:
            dense = np.zeros(1 << BUCKET_BITS)
            dense[self.used] = self.values
            self._dense = dense, dense != 0
        dense, keep = self._dense
        z = self.bias + dense[buckets(text, keep)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts: list[str], labels: list[int], how: Fit = Fit(), share_toxic: float | None = None) -> Model:
    """The model of labelled texts; ``share_toxic`` is the share of label 1 where the texts were drawn from, if not theirs.

    Without both classes every text scores the share of label 1, or 0.5 without any text.
    """
    y = np.asarray(labels, np.float64)
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
        return Model(np.zeros(1 << BUCKET_BITS), np.log(share / (1 - share)), learnt=False)
    counts = np.zeros((2, 1 << BUCKET_BITS))
    for text, label in zip(texts, labels):
        counts[label, buckets(text)] += 1
    of = np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 2 * how.smoothing
    logs = np.log((counts + how.smoothing) / of)
    ratio = np.where(counts.sum(0) >= how.least, logs[1] - logs[0], 0.0)
    # Strength of the evidence, not only the size of the ratio: |p1 - p0| over its standard error.
    share = (counts + how.smoothing) / of
    error = np.sqrt((share * (1 - share) / of).sum(0))
    strength = np.where(ratio != 0, np.abs(share[1] - share[0]) / error, 0.0)
    chosen = np.argsort(-strength, kind="stable")[: how.features]
    chosen = np.sort(chosen[strength[chosen] > 2.0])
    keep = np.zeros(1 << BUCKET_BITS, bool)
    keep[chosen] = True

    columns, ends = [], []
    for text in texts:
        columns.append(np.searchsorted(chosen, buckets(text, keep)))
        ends.append(len(columns[-1]))
    rows = np.repeat(np.arange(len(texts)), ends)
    columns = np.concatenate(columns) if columns else np.empty(0, np.int64)
    x = ratio[chosen][columns]
    n, k = len(texts), len(chosen)
    w, bias = np.full(k, 0.0), 0.0
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, how.steps + 1):  # Adam on the regularised log loss
        z = np.bincount(rows, x * w[columns], n) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        slope = np.append(np.bincount(columns, x * off[rows], k) + how.ridge * w / n, off.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        move = how.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    if share_toxic is not None and 0 < share_toxic < 1:
        bias += np.log(share_toxic / (1 - share_toxic)) - np.log(y.mean() / (1 - y.mean()))
    weight = np.zeros(1 << BUCKET_BITS)
    weight[chosen] = w * ratio[chosen]
    return Model(weight, bias)


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), how: Fit = Fit()) -> Model:
    """Fit on a share of the learnable labelled rows of each class, drawn by the hash of their ids.

    The share makes about ``rows_per_class`` rows. Rows with a null id, label or text and labels
    other than 0 and 1 teach nothing; of repeated label rows the largest label counts, of repeated
    documents the text that sorts first.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(learnable("doc_id", FOLDS, HELD) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, sample.rows_per_class / max(counts.get(1, 0), 1)).otherwise(
        sample.rows_per_class / max(counts.get(0, 0), 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # About rows_per_class ids a class, whatever the data: the broadcast and what comes back are bounded.
    rows = texts.where(F.length("text") <= sample.longest).join(F.broadcast(marked.where(drawn(share, "doc_id"))), "doc_id")
    rows = sorted(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    return fit([r.text for r in rows], [r.toxic for r in rows], how, counts.get(1, 0) / max(sum(counts.values()), 1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from 0.5).

    Null and empty texts score as a text without n-grams that say anything.
    Every row is scored on its own text; a column of either name is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("score", "predicted").withColumn("score", F.lit(0.0))
    keep = rows.columns[:-1]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [shared.value.score(t) for t in text_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(scored, rows.schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), how: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of (doc_id, text); the model learns from ``labels``.

    An empty table gives no rows; a row with a null doc_id is scored, teaches nothing and is not held out.
    Very long texts are scored whole, a portion at a time; those above ``sample.longest`` teach nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, train(docs, labels, sample, how))
    return scored.select("doc_id", held_out("doc_id", FOLDS, HELD).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not judged toxic, with their columns; all of them if the labels teach no two classes."""
    model = train(docs, labels)
    if not model.learnt:
        return docs
    scored = score(set_aside(docs, "score", "predicted"), model)
    return restored(scored.where(F.col("predicted") == 0), docs)
