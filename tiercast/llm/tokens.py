"""Token ids of whole texts, and documents laid out in id order.

The vocabulary is a public file read by the ``tokenizers`` library. Byte-level
BPE treats every piece between two safe borders on its own. Arrow cuts the
texts of a slice into pieces and keeps each distinct one once; these are cut
into words, of which only those not met before go to the merges. The ids of the
texts are put together by offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Text encoded at once, and pieces and their characters kept per Python worker; beyond them a
#: store starts anew. No result depends on them.
SLICE_BYTES = 4 << 20
KEPT_PIECES, KEPT_CHARACTERS = 1_200_000, 16 << 20

# A space before anything that may be white space: a superset of what byte-level BPE calls so.
_SPACES = r" [\x00-\x20\x7f-\x{a0}\p{Z}]"
_SPACES_AHEAD = r"(^| )[\x00-\x20\x7f-\x{a0}\p{Z}]"
_BORDER = re.compile(r" (?=\S)")

# The split of byte-level BPE, with its letter, number and space classes up to U+024F.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_BEYOND = r"[^\x00-\x{24f}]"

_encoders: dict[tuple[str, int], "Encoder"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, … of each run, all runs end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def bounds(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin and, last, end."""
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


class PieceStore:
    """The ids of pieces met before: a number for each piece, and its run in one flat array."""

    def __init__(self, dtype: np.dtype, kept: int):
        self.dtype, self.kept = dtype, kept
        self._start([], np.empty(0, dtype), np.empty(0, np.int64))

    def _start(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.numbers = dict(zip(pieces, range(len(pieces))))
        self.characters = sum(map(len, pieces))
        self.flat, self.ends = flat, bounds(sizes)
        self._again = np.empty(0, np.int64)  # pieces met in the last look-up and before it

    def room(self) -> None:
        """If the store is full, keep what came up again last, the frequent pieces; a slice's own may go beyond that."""
        if len(self.numbers) <= self.kept and self.characters <= KEPT_CHARACTERS:
            return
        kept = np.unique(self._again)
        pieces = list(self.numbers)
        pieces = [pieces[i] for i in kept.tolist()]
        if len(pieces) > self.kept // 2 or sum(map(len, pieces)) > KEPT_CHARACTERS // 2:
            kept, pieces = kept[:0], []
        self._start(pieces, *self.ids(kept))

    def look_up(self, pieces: list[str], encode) -> np.ndarray:
        """A number for each of ``pieces``, all distinct; ``encode`` gives (ids, sizes) of those not met before."""
        numbers = self.numbers
        found = np.fromiter(map(numbers.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        self._again = found[found >= 0]
        if len(missing):
            new = list(map(pieces.__getitem__, missing.tolist()))
            found[missing] = np.arange(len(numbers), len(numbers) + len(new))
            ids, sizes = encode(new)
            numbers.update(zip(new, count(len(numbers))))
            self.flat = np.concatenate((self.flat, ids.astype(self.dtype)))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
            self.characters += sum(map(len, new))
        return found

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces end to end, and how many each has."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        return self.flat[runs(starts, sizes)], sizes


def listed(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def numbered(values: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct strings, and for each value the place of its own."""
    coded = values.dictionary_encode()
    return listed(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


class Encoder:
    """Ids of texts, ``width`` bytes each.

    A text is cut before each space that a non-space follows; no token of the
    vocabulary crosses such a border. Pieces of characters up to U+024F are
    cut further by the vocabulary's own split, and only new words go to its
    merges; other new pieces go to the library whole.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._model = self._tokenizer.model
        self.size = self._tokenizer.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self._letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self._heads, self._far, self._words = (PieceStore(self.dtype, kept) for _ in range(3))

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        byte = {c: b for b, c in byte_letters().items()}
        spelled = (self._tokenizer.id_to_token(i) or "" for i in range(self.size))
        return [bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s in spelled]

    def _whole(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library."""
        return joined([e.ids for e in self._tokenizer.encode_batch(pieces, add_special_tokens=False)])

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, the units of the vocabulary's split, by its merges alone."""
        space, letters, tokenize = self._letters[ord(" ")], self._letters, self._model.tokenize
        return joined([
            [t.id for t in tokenize(
                w.replace(" ", space) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters))]
            for w in words])

    def _after_space(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces that each follow a space: by their words, or by the library."""
        if not len(pieces):
            return np.empty(0, self.dtype), np.zeros(0, np.int64)
        far = pc.or_(pc.equal(pieces, ""), pc.match_substring_regex(pieces, _BEYOND)).to_numpy(zero_copy_only=False)
        near = pieces.filter(pa.array(~far)) if far.any() else pieces
        words = pa.array(_SPLIT.findall(" ".join(["", *listed(near)])), pa.string())
        ends = np.cumsum(pc.utf8_length(near).to_numpy().astype(np.int64) + 1)
        cuts = np.searchsorted(np.cumsum(pc.utf8_length(words).to_numpy(), dtype=np.int64), ends) + 1
        distinct, codes = numbered(words)
        self._words.room()
        ids, sizes = self._words.ids(self._words.look_up(distinct, self._merged)[codes])
        sizes = np.diff(bounds(sizes)[np.concatenate(([0], cuts))])
        if not far.any():
            return ids, sizes
        self._far.room()
        more, more_sizes = self._far.ids(self._far.look_up([" " + p for p in listed(pieces.filter(pa.array(far)))], self._whole))
        order = np.argsort(np.concatenate((np.flatnonzero(~far), np.flatnonzero(far))))
        starts, all_sizes = bounds(np.concatenate((sizes, more_sizes))), np.concatenate((sizes, more_sizes))[order]
        return np.concatenate((ids, more))[runs(starts[order], all_sizes)], all_sizes

    def encode_all(self, texts: pa.Array, after_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the bounds of each text; null counts as empty.

        With ``after_space`` a space stands before every text.
        """
        texts = texts.cast(pa.string()).fill_null("")
        if not len(texts):
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ")
        bare = np.full(len(texts), not after_space)  # the first piece follows no space
        odd = pc.match_substring_regex(texts, _SPACES_AHEAD if after_space else _SPACES).to_numpy(zero_copy_only=False)
        if odd.any():
            rows = np.flatnonzero(odd)
            lead = " " if after_space else ""
            cut = [_BORDER.split(lead + texts[i].as_py()) for i in rows.tolist()]
            order = np.arange(len(texts))
            order[rows] = len(texts) + np.arange(len(rows))
            lists = pa.concat_arrays([lists, pa.array(cut, lists.type)]).take(pa.array(order))
            bare[rows] = True
        per_text = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begins = bounds(per_text)
        is_head = np.zeros(begins[-1], bool)
        is_head[begins[:-1][bare]] = True
        pieces = lists.flatten().filter(pa.array(~is_head)).dictionary_encode()
        heads, head_codes = numbered(pc.list_element(lists, 0).filter(pa.array(bare)))
        ids, piece_sizes = self._after_space(pieces.dictionary)
        self._heads.room()
        head_ids, head_sizes = self._heads.ids(self._heads.look_up(heads, self._whole))
        # Put together: the run of each piece lies either among the pieces' ids or, behind them, among the heads'.
        run = np.empty(begins[-1], np.int64)
        run[~is_head], run[is_head] = pieces.indices.to_numpy(), len(piece_sizes) + head_codes
        sizes = np.concatenate((piece_sizes, head_sizes))
        starts, sizes = bounds(sizes)[run], sizes[run]
        return np.concatenate((ids, head_ids))[runs(starts, sizes)], bounds(sizes)[begins]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def encoder(path: str, kept: int = KEPT_PIECES) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]


def in_id_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) range-partitioned and sorted by doc_id; repeated ids by text, then place.

    The place spreads any number of repeated rows over several partitions.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"),
    )
    order = ["doc_id", "tie", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the strings of ``column`` hold about ``limit`` bytes, or one row more than that."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[list, list[bytes], Encoder]]:
    """(doc ids, ids with the end id) for bounded slices of a partition."""
    enc = encoder(path)
    end = np.array([end_id], dtype=enc.dtype).tobytes()
    for batch in by_bytes(batches, "text"):
        ids, begins = enc.encode_all(batch.column("text"))
        whole, cuts = ids.tobytes(), (begins * enc.width).tolist()
        yield batch.column("doc_id").to_pylist(), [whole[a:b] + end for a, b in zip(cuts, cuts[1:])], enc
