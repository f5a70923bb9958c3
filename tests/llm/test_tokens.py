"""Records and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import odd_documents
from pyspark.sql import functions as F

from tiercast.llm import packing, records
from tiercast.llm.common import read
from tiercast.llm.tokens import Encoder, PieceStore, encoder, vocabulary_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_whole_text(plain):
    r = random.Random(3)
    alphabet = ["a", "Be", "don't", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "3", "½", "²", "é", "ǅ", "—", "你好", "\x1c", "\x85", ".", "'s", "😀", "<|endoftext|>"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(3000)]
    enc = encoder(vocabulary_path())
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == plain(t), repr(t)


def test_words_are_kept_and_not_the_pieces_they_stand_in(plain):
    """A word before a comma and before a stop is one word; only what words cannot tell goes to the library by piece."""
    enc = Encoder(vocabulary_path())
    texts = ["a tea, tea. coffee. coffee, tea, 你好", "a coffee, tea. 你好 tea  "]
    for _ in range(2):
        ids, begins = enc.encode_all(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(begins, begins[1:])] == [plain(t) for t in texts]
    stores = [s for s in vars(enc).values() if isinstance(s, PieceStore)]
    assert sorted(w for s in stores for w in s.numbers) == sorted(["a", " tea", " coffee", ",", ".", " 你好", "  "])


@pytest.mark.parametrize("kept", [0, 2, 5])
def test_a_full_store_changes_no_id(plain, kept):
    enc, r = Encoder(vocabulary_path(), kept), random.Random(kept)
    words = ["tea,", "café", "你好", "don't", "12½", "—", "", "\n", "river.", "x"]
    for _ in range(50):
        texts = [" ".join(r.choices(words, k=r.randint(0, 9))) for _ in range(5)]
        ids, begins = enc.encode_all(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(begins, begins[1:])] == [plain(t) for t in texts]


def expected(rows, plain, end):
    return {d: plain(t) + [end] for d, t in rows}


def test_records_of_a_table(spark, plain):
    docs = read(spark, SF_DIR, "documents")
    want, start = {}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array(plain(r.text) + [0], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    written = records.write_records(docs.repartition(5))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in records.record_digests(written).collect()}
    assert got == want
    part = written.index().where(F.col("n_tokens") > 500).orderBy(F.rand(1))
    assert {r.doc_id: r.n_tokens for r in written.read(part).collect()} == {d: v[1] for d, v in want.items() if v[1] > 500}


def test_records_of_odd_rows(spark, plain):
    docs = odd_documents(spark)
    got = records.write_records(docs).read().collect()
    rows = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got]
    assert sorted(rows, key=str) == sorted([(r.doc_id, plain(r.text) + [0]) for r in docs.collect()], key=str)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [r.doc_id for r in ordered] == [None, None, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8]


def test_empty_table(spark):
    none = odd_documents(spark).limit(0)
    assert records.record_digests(records.write_records(none)).count() == 0
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("at", [0, 9, 14, 30, -1])
def test_a_changed_byte_is_found(at):
    record = bytearray(records.frame(7, b"\1\2\3\4\5\6\7\x08", 2))
    assert records.unframe(bytes(record))[0] == 7
    record[at % len(record)] ^= 1
    with pytest.raises(records.BrokenRecord):
        records.unframe(bytes(record))


def test_a_cut_record_is_found():
    with pytest.raises(records.BrokenRecord):
        records.unframe(records.frame(7, b"\1\2", 2)[:-6])


def check_packing(pieces, rows, plain, length):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for d, ids in expected(rows, plain, 1).items():
        own = sorted(by_doc[d], key=lambda p: p.start)
        assert sum((np.frombuffer(p.ids, "<u4").tolist() for p in own), []) == ids
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(p.ids) and p.length * 4 == len(p.ids) for p in own)
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
    last = max(by_sequence)
    assert sorted(by_sequence) == list(range(last + 1))
    for s, own in by_sequence.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert s == last or sum(p.length for p in own) == length


def test_packing_of_a_table(spark, plain):
    docs = read(spark, SF_DIR, "documents")
    check_packing(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], plain, 2048)


def test_packing_of_odd_rows_and_the_windows(spark, plain):
    docs = odd_documents(spark).where("doc_id is not null and doc_id <> 5")
    pieces = packing.pack(docs, length=16).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(pieces.collect(), rows, plain, 16)
    stream = sum((plain(t) + [1] for d, t in sorted(rows)), [])
    got = sorted(packing.sequences(pieces, 16).collect(), key=lambda r: r.sequence_id)
    whole = sum((np.frombuffer(r.ids, "<u4").tolist()[: r.n_tokens] for r in got), [])
    assert whole == stream
    assert all(len(r.ids) == 4 * r.padded_length for r in got)
    n = got[-1].n_tokens
    assert got[-1].padded_length == (n if n & (n - 1) == 0 else 16)
    assert packing.pack(odd_documents(spark)).agg(F.sum("length")).first()[0] == sum(
        len(plain(r.text)) + 1 for r in odd_documents(spark).collect())
