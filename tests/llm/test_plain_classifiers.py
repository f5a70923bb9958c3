"""Features, log-count ratios and scores of the classifiers against plain Python, gram by gram."""

import math

import numpy as np
import pytest

from tiercast.llm import quality, toxicity

WORD = 1 << 64
TEXTS = ["", " ", "a", "You are  GOOD\tand kind", "ÄÖ ü 漢字 🙂🙂", "aaaa aaaa aaaa", "x" * 700, "one two three " * 60]


def plain_buckets(text):
    c = [ord(x) for x in f" {' '.join(text.lower().split())} "]
    found = set()
    for n in toxicity.ORDERS:
        for i in range(len(c) - n + 1):
            h = 0
            for code in c[i : i + n]:
                h = (h + code) * int(toxicity._BASE) % WORD
            h = (h ^ (h >> 29)) * ((int(toxicity._MULTIPLIER) + 2 * n) % WORD) % WORD
            found.add(h >> (64 - toxicity.BUCKET_BITS))
    return found


@pytest.mark.parametrize("portion", [7, 64, 1 << 16])
def test_ngrams_of_toxicity(portion, monkeypatch):
    monkeypatch.setattr(toxicity, "PORTION", portion)
    for text in TEXTS:
        assert set(toxicity.buckets(text).tolist()) == plain_buckets(text), text[:20]


def test_toxicity_scales_by_log_count_ratios():
    texts = ["bad awful bad", "awful words", "so bad", "truly awful", "nice day", "good day", "kind words", "a nice thing"] * 4
    labels = [1, 1, 1, 1, 0, 0, 0, 0] * 4
    # One step from zero moves every weight by the rate against the sign of its slope: w * ratio shows the ratio.
    how = toxicity.Fit(steps=1, ridge=0.0)
    model = toxicity.fit(texts, labels, how)
    grams = [plain_buckets(t) for t in texts]
    for bucket, value in zip(model.used.tolist(), model.values.tolist()):
        n = [sum(bucket in g for g, y in zip(grams, labels) if y == label) for label in (0, 1)]
        ratio = math.log((n[1] + 1) / (16 + 2)) - math.log((n[0] + 1) / (16 + 2))
        assert abs(value) == pytest.approx(abs(ratio) * how.rate, rel=1e-4)
    assert len(model.used) > 10
    whole = toxicity.fit(texts, labels)
    weight = dict(zip(whole.used.tolist(), whole.values.tolist()))
    for text in TEXTS + texts[:8]:
        z = whole.bias + sum(weight.get(b, 0.0) for b in plain_buckets(text))
        assert whole.score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    assert whole.score("bad and awful") > 0.5 > whole.score("a nice day")


def plain_features(text):
    size, counts = 1 << quality.BUCKET_BITS, {}
    if not text:
        return {}
    c = [ord(x) for x in f" {text} "]
    total = len(c) - 2
    for i in range(total):
        gram = ((c[i] << 42) % WORD) ^ ((c[i + 1] << 21) % WORD) ^ c[i + 2]
        b = gram * int(quality._MULTIPLIER) % WORD >> (64 - quality.BUCKET_BITS)
        counts[b] = counts.get(b, 0.0) + 1 / total
    words = text.split()
    distinct = len(set(words)) / len(words) if words else 0.0
    for kind, step in ((1, min(int(math.log2(len(text) + 1)), quality._STEPS)), (2, int(distinct * quality._STEPS))):
        b = (kind * 40 + step) * 2654435761 % size
        counts[b] = counts.get(b, 0.0) + 1.0
    return {b: math.sqrt(n) for b, n in counts.items()}


@pytest.mark.parametrize("portion", [5, 1 << 16])
def test_features_and_ratings_of_quality(portion, monkeypatch):
    monkeypatch.setattr(quality, "PORTION", portion)
    rng = np.random.default_rng(3)
    model = quality.Model(rng.standard_normal(1 << quality.BUCKET_BITS), np.array([-1.0, 0.5, 2.0]), [0, 1, 3, 7])
    for text in TEXTS:
        want = plain_features(text)
        at, x = quality.features(text)
        assert dict(zip(at.tolist(), x.tolist())) == pytest.approx(want)
        z = sum(model.weights[b] * v for b, v in want.items())
        above = [1 / (1 + math.exp(t - z)) for t in (-1.0, 0.5, 2.0)]
        chances = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        grade = sum(g * p for g, p in zip((0, 1, 3, 7), chances))
        for wanted, tail in ((0, 1.0), (1, above[0]), (2, above[1]), (3, above[1]), (7, above[2]), (8, 0.0)):
            assert model.rate(text, wanted) == (pytest.approx(grade), pytest.approx(tail))
