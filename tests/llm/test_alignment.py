"""Alignment against the plain libraries and a merge of one document at a time."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import odd_documents
from tiercast.llm import alignment
from tiercast.llm.common import read
from tiercast.llm.tokens import byte_letters, vocabulary_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, A bytes, B ids, B bytes) by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    letter = {c: n for n, c in byte_letters().items()}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], [], [], []
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(letter[c] for c in a.id_to_token(i)) for i in a_ids]
        b_spelt = [b_bytes(i) for i in b_ids]
        whole = (" " + text).encode()
        return (a_ids, a_bytes, b_ids, b_spelt) if b"".join(a_bytes) == whole == b"".join(b_spelt) else ([], [], [], [])

    return both


def merged(a_bytes, b_bytes):
    """(places of linked tokens, cuts) by walking over the ends."""
    a_ends, b_ends = np.cumsum(list(map(len, a_bytes))), np.cumsum(list(map(len, b_bytes)))
    at = {int(e): j for j, e in enumerate(b_ends)}
    return [(i, at[int(e)], int(e)) for i, e in enumerate(a_ends) if int(e) in at]


def expected(rows, plain):
    aligned = [(d, *plain(t)) for d, t in rows]
    links, counts = [], Counter()
    for _, a, ab, b, bb in aligned:
        own = merged(ab, bb)
        links.append(own)
        counts.update((a[i], b[j]) for i, j, _ in own)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (d, a, _, b, _), own in zip(aligned, links):
        groups, i0, j0 = [], 0, 0
        for i, j, _ in own:
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        n = [counts[a[i], b[j]] for i, j, _ in own]
        out.append((d, len(a), len(b), len(groups), len(own), sum(k == best[b[j]] for k, (_, j, _) in zip(n, own)), sum(n), digest))
    return sorted(out, key=str)


def found(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_a_table(spark, plain):
    docs = read(spark, SF_DIR, "documents")
    assert found(alignment.alignment_digests(docs.repartition(5))) == expected([(r.doc_id, r.text) for r in docs.collect()], plain)


def test_odd_rows_clashing_columns_and_small_blocks(spark, plain, monkeypatch):
    docs = odd_documents(spark)
    more = spark.createDataFrame(
        [(20, "a▁b"), (21, " "), (22, "  two  "), (23, "a \n b"), (24, "\x00\x01"), (25, "tab\tand more"), (26, "▁"), (27, "-" * 5000)],
        "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows, plain)
    assert [w[1:] for w in want if w[0] in (2, 3, 20, 26)] == [(0, 0, 0, 0, 0, 0, "")] * 4
    assert found(alignment.alignment_digests(docs)) == want
    got = {(r.doc_id, r.text): r for r in alignment.align(docs).collect()}
    for d, t in rows:
        a, ab, b, bb = plain(t)
        r = got[d, t]
        assert (r.a_ids, r.b_ids) == (a, b)
        assert list(zip(r.link_a, r.link_b, r.cuts)) == merged(ab, bb)


def test_an_empty_table(spark):
    assert alignment.alignment_digests(odd_documents(spark).limit(0)).collect() == []
    assert alignment.align(odd_documents(spark).limit(0)).collect() == []


@pytest.mark.parametrize("stretch", [1, 7, 256, 10**9])
def test_random_texts_by_any_stretch(plain, monkeypatch, stretch):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    r = random.Random(stretch)
    alphabet = ["a", "Be", "don't", " ", " ", "  ", "\n", "\t", " ", "3", "½", "é", "ǅ", "—", "你好", "\x1c", ".", "'s", "😀", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "▁"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(800)] + [None, ""]
    batch = alignment.align_batch(pa.array(texts), *alignment._paths(None, None))
    for k, t in enumerate(texts):
        a, ab, b, bb = plain(t)
        a0, a1, b0, b1 = *batch.a_bounds[k : k + 2], *batch.b_bounds[k : k + 2]
        assert (batch.a_ids[a0:a1].tolist(), batch.b_ids[b0:b1].tolist()) == (a, b), repr(t)
        own = slice(*batch.link_bounds[k : k + 2])
        assert list(zip((batch.links_a[own] - a0).tolist(), (batch.links_b[own] - b0).tolist())) == [(i, j) for i, j, _ in merged(ab, bb)]


def test_lockstep_of_two_lists():
    a, b = np.array([2, 3, 7, 9, 12]), np.array([1, 3, 4, 9, 10, 12])
    assert [x.tolist() for x in alignment.lockstep(a, b, np.array([0, 12]))] == [[1, 3, 4], [1, 3, 5]]
    assert [x.tolist() for x in alignment.lockstep(a, b, np.arange(13))] == [[1, 3, 4], [1, 3, 5]]
    none = np.empty(0, np.int64)
    assert [len(x) for x in alignment.lockstep(none, none, np.array([0]))] == [0, 0]
