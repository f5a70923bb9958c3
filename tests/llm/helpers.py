"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re

import xxhash

LONG = "Word of a very long text. " * 40_000
ODD = [
    (1, "Plain text, of a few words only."), (2, None), (3, ""), (4, " \n\t "), (5, "word"), (5, "word"), (5, "another word"),
    (None, "no id here at all"), (None, "no id here at all"), (6, LONG), (7, "Ünïcödé — 你好 Привет <|endoftext|> it's 3.14"), (8, "!!! ???"),
]
ODD_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, hits string, "
    "items int, n_words string, lang_pred int, tail string, expected_grade string, fp long, node string"
)


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns of the operators' own names."""
    return spark.createDataFrame([(i, t, None, "s", None, "own", 9, "h", 3, "w", 4, "t", "e", 5, "n") for i, t in ODD], ODD_SCHEMA)


def fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(n, linked):
    """Smallest index reachable from each of n items."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(documents, items, window=13):
    owners = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                owners.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for doc_id, text in documents:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in owners}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in owners:
                    hit.update(range(k, k + size))
                    found |= owners[tuple(w[k : k + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out
