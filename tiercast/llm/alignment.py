"""Alignment of the tokens of two tokenizers over the same bytes.

A is byte-level BPE, B sentencepiece with byte fallback; both spell a space and
then the text. Where a token of A and a token of B end on the same byte there
is a cut, and the two are linked; the tokens between two cuts form a group.

One NumPy state holds a pair of pointers for every document of a batch; each
step looks at where the tokens of all of them end, links and cuts where both
end together, and moves on the pointer that is behind. What is finished is
compacted away. A long document takes part with a pair of pointers for each
stretch of its bytes, so that a step count goes with the stretch, not with the
longest document; two ends on either side of a border never meet, hence links
and cuts are those of one pass.

Corpus-wide counts of id pairs go back to the documents by blocks: a block
knows its distinct pairs, so that only those are joined, never single links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tiercast.sources.storage import write_through

from .common import ship
from .tokens import PieceStore, bounds, by_bytes, encoder, joined, numbered, runs, vocabulary_path

PIECES = "piece_bpe_32k.model"
#: Text aligned at once, and the bytes one pair of pointers goes over. No result depends on them.
BLOCK_BYTES, STRETCH = 1 << 20, 256
#: Pieces kept by each of the two encoders, fewer than where only one works.
KEPT = 250_000

_INNER_SPACE = re.compile("(?<=[^ ]) ")
_piece_encoders: dict[str, "PieceEncoder"] = {}

_ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
    ("link_a", pa.list_(pa.int32())), ("link_b", pa.list_(pa.int32())), ("cuts", pa.list_(pa.int64())), ("text", pa.string())])
_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())), ("hashes", pa.list_(pa.string())), ("width", pa.int32()), ("links", pa.binary()),
    ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


class PieceEncoder:
    """Ids of a space and a text by a sentencepiece model whose pieces hold spaces only in front.

    A text is cut before each space that follows a non-space; no piece of the
    model crosses such a border. Only parts not met before go to the library.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        if any("▁" in self._model.id_to_piece(i).lstrip("▁") for i in range(self.size)):
            raise ValueError(f"{path}: a piece holds a space behind other characters")
        self._space = [self._model.piece_to_id("▁")]
        self._store = PieceStore(np.dtype("<u2" if self.size <= 1 << 16 else "<u4"), KEPT)

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        model = self._model
        return [
            bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self._model.encode(parts, num_threads=1)
        lists = [ids if p else self._space for p, ids in zip(parts, lists)]  # nothing after a space: the space
        return joined(lists)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the bounds of each text."""
        lists = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, "^ |  ").to_numpy(zero_copy_only=False)
        if odd.any():
            rows = np.flatnonzero(odd)
            order = np.arange(len(texts))
            order[rows] = len(texts) + np.arange(len(rows))
            cut = [_INNER_SPACE.split(texts[i].as_py()) for i in rows.tolist()]
            lists = pa.concat_arrays([lists, pa.array(cut, lists.type)]).take(pa.array(order))
        parts, codes = numbered(lists.flatten())
        self._store.room()
        ids, sizes = self._store.ids(self._store.look_up(parts, self._encoded)[codes])
        return ids, bounds(sizes)[bounds(lists.value_lengths().to_numpy(zero_copy_only=False))]


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each model and Python worker."""
    if path not in _piece_encoders:
        _piece_encoders[path] = PieceEncoder(path)
    return _piece_encoders[path]


class _Spelling:
    """The bytes of all tokens of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array(list(map(len, tokens)), np.int64)
        self._starts = bounds(self.sizes)[:-1]
        self._flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self._flat[runs(self._starts[ids], self.sizes[ids])]


class _Tokenizers:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path, KEPT), piece_encoder(b_path)
        self.a_spelling, self.b_spelling = _Spelling(self.a.token_bytes()), _Spelling(self.b.token_bytes())
        a, b = range(self.a.size), range(self.b.size)
        #: An id as it stands inside a group and, for each vocabulary, at the end of its side of one.
        self.words = [f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b]


_tokenizers: dict[tuple[str, str], _Tokenizers] = {}


def _pair(a_path: str, b_path: str) -> _Tokenizers:
    if (a_path, b_path) not in _tokenizers:
        _tokenizers[a_path, b_path] = _Tokenizers(a_path, b_path)
    return _tokenizers[a_path, b_path]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all tokens with a_ends[i] == b_ends[j], in order; both lists rise.

    ``borders`` are the byte offsets between which a pair of pointers goes, the
    first 0 and the last where both lists end.
    """
    i, i_end = np.searchsorted(a_ends, borders[:-1], "right"), np.searchsorted(a_ends, borders[1:], "right")
    j, j_end = np.searchsorted(b_ends, borders[:-1], "right"), np.searchsorted(b_ends, borders[1:], "right")
    state = np.stack((i, i_end, j, j_end))
    links_a, links_b = [], []
    while True:
        going = (state[0] < state[1]) & (state[2] < state[3])
        if not going.all():
            state = state[:, going]
        if not state.shape[1]:
            break
        a, b = a_ends[state[0]], b_ends[state[2]]
        cut = a == b
        links_a.append(state[0][cut])
        links_b.append(state[2][cut])
        state[0] += a <= b
        state[2] += b <= a
    if not links_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


@dataclass
class Batch:
    """The aligned texts of a batch: ids end to end with the bounds of each text, and the linked tokens in order."""

    a_ids: np.ndarray
    a_bounds: np.ndarray
    b_ids: np.ndarray
    b_bounds: np.ndarray
    a_ends: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray
    link_bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.a_bounds) - 1


def _taken(ids: np.ndarray, begins: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the good texts, and bounds for all texts."""
    sizes = np.where(good, np.diff(begins), 0)
    return ids[runs(begins[:-1], sizes)], bounds(sizes)


def align_batch(texts: pa.Array, a_path: str, b_path: str) -> Batch:
    """Both tokenizations of a space and each text, and their links.

    Null and empty texts, and texts that either tokenizer does not spell byte for byte, have no tokens.
    """
    both = _pair(a_path, b_path)
    texts = texts.cast(pa.string()).fill_null("")
    (a_ids, a_bounds), (b_ids, b_bounds) = both.a.encode_all(texts, after_space=True), both.b.encode_all(texts)
    a_ids, b_ids = a_ids.astype(np.int64), b_ids.astype(np.int64)
    spaced = pc.binary_join_element_wise(pa.array([""] * len(texts)), texts, " ")
    sizes = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = bounds(sizes)
    data = np.frombuffer("".join(spaced.to_pylist()).encode(), np.uint8)
    good = sizes > 1
    for ids, cuts, spelling in ((a_ids, a_bounds, both.a_spelling), (b_ids, b_bounds, both.b_spelling)):
        good &= np.diff(bounds(spelling.sizes[ids])[cuts]) == sizes
    for ids, cuts, spelling in ((a_ids, a_bounds, both.a_spelling), (b_ids, b_bounds, both.b_spelling)):
        own, _ = _taken(ids, cuts, good)
        wanted, within = _taken(data, begins, good)
        good &= np.diff(bounds(spelling.spell(own) != wanted)[within]) == 0
    a_ids, a_bounds = _taken(a_ids, a_bounds, good)
    b_ids, b_bounds = _taken(b_ids, b_bounds, good)
    a_ends = np.cumsum(both.a_spelling.sizes[a_ids])
    b_ends = np.cumsum(both.b_spelling.sizes[b_ids])
    # A border at each text's end and, inside, after every stretch.
    sizes = np.where(good, sizes, 0)
    stretches = -(-sizes // STRETCH)
    starts = np.repeat(bounds(sizes)[:-1], stretches) + STRETCH * runs(np.zeros(len(sizes), np.int64), stretches)
    links_a, links_b = lockstep(a_ends, b_ends, np.append(starts, sizes.sum()))
    return Batch(a_ids, a_bounds, b_ids, b_bounds, a_ends, links_a, links_b, np.searchsorted(links_a, a_bounds))


def group_hashes(batch: Batch, words: list[str], a_size: int, b_size: int) -> list[str]:
    """Per text the SHA-256 of its groups, written ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    a_in, b_in = np.diff(batch.links_a, prepend=-1), np.diff(batch.links_b, prepend=-1)
    a_last, b_last = np.zeros(len(batch.a_ids), bool), np.zeros(len(batch.b_ids), bool)
    a_last[batch.links_a] = b_last[batch.links_b] = True
    written = np.empty(len(batch.a_ids) + len(batch.b_ids), np.int64)
    # A group's own A tokens stand behind the B tokens of the groups before, its B tokens behind its A tokens.
    written[np.arange(len(batch.a_ids)) + np.repeat(batch.links_b + 1 - b_in, a_in)] = batch.a_ids + a_size * a_last
    written[np.arange(len(batch.b_ids)) + np.repeat(batch.links_a + 1, b_in)] = batch.b_ids + 2 * a_size + b_size * b_last
    parts = list(map(words.__getitem__, written.tolist()))
    ends = (batch.a_bounds + batch.b_bounds).tolist()
    return [hashlib.sha256("".join(parts[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or vocabulary_path(), b_path or vocabulary_path(PIECES)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document its text, the ids of both tokenizers, the places of linked tokens and the byte offset of each cut.

    ``link_a[k]`` and ``link_b[k]`` are the places in ``a_ids`` and ``b_ids`` of the
    tokens that end at ``cuts[k]`` (bytes of a space and the text). Null and empty texts, and texts that either
    tokenizer does not spell byte for byte (such as those with U+2581), have empty lists. Null and
    repeated doc_ids keep all their rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    a_path, b_path = _paths(a_path, b_path)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bytes(batches, "text", BLOCK_BYTES):
            b = align_batch(rows.column("text"), a_path, b_path)
            within = np.diff(b.link_bounds)

            def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

            bytes_before = np.concatenate(([0], b.a_ends))[b.a_bounds[:-1]]
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), lists(b.a_ids, b.a_bounds), lists(b.b_ids, b.b_bounds),
                lists(b.links_a - np.repeat(b.a_bounds[:-1], within), b.link_bounds),
                lists(b.links_b - np.repeat(b.b_bounds[:-1], within), b.link_bounds),
                lists(b.a_ends[b.links_a] - np.repeat(bytes_before, within), b.link_bounds, pa.int64()),
                rows.column("text"),
            ], schema=_ALIGNED)

    return _texts(docs).mapInArrow(aligned, (
        "doc_id long, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, cuts array<long>, text string"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per batch of documents: their numbers and hashes, their links as places among the distinct id pairs."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        both = _pair(a_path, b_path)
        for rows in by_bytes(batches, "text", BLOCK_BYTES):
            b = align_batch(rows.column("text"), a_path, b_path)
            linked = b.b_ids[b.links_b].astype(np.int64) << 32 | b.a_ids[b.links_a]
            pairs, places, counts = np.unique(linked, return_inverse=True, return_counts=True)
            width = 2 if len(pairs) <= 1 << 16 else 4
            row = (
                block, rows.column("doc_id").to_pylist(), np.diff(b.a_bounds), np.diff(b.b_bounds), np.diff(b.link_bounds),
                group_hashes(b, both.words, both.a.size, both.b.size), width, places.astype(f"<u{width}").tobytes(), pairs, counts)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)
            block += 1

    return _texts(docs).mapInArrow(blocks, (
        "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, hashes array<string>, "
        "width int, links binary, pairs array<long>, counts array<long>"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, b_id, links, best): corpus-wide links of each id pair, and whether no pair of its B id has more."""
    counted = (
        blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("links"))
    )
    counted = counted.withColumn("b_id", F.shiftright("pair", 32))
    # At most one row for each A id under a B id.
    highest = counted.groupBy("b_id").agg(F.max("links").alias("highest"))
    return counted.join(highest, "b_id").select("pair", "b_id", "links", (F.col("links") == F.col("highest")).alias("best"))


def alignment_digests(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: tokens, groups and links, links whose id pair is its B id's most frequent, and the groups' hash.

    ``count_sum`` adds up, over the document's links, the corpus-wide number of
    links of the same id pair; ``n_best`` counts links whose number is the highest of their B id, ties included.
    Texts without tokens (see ``align``) give zeros and ''; null and repeated
    doc_ids keep all their rows, each counted; an empty table gives no row.
    """
    ship(docs.sparkSession)
    blocks = write_through(_blocks(docs, *_paths(a_path, b_path)), "aligned")
    counts = write_through(pair_counts(blocks), "pair-counts")
    # At most one row for each distinct pair of a block: far fewer than its links.
    of_block = (
        blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "links", "best"))).alias("known"))
        .select("block", F.col("known.links").alias("known"), F.col("known.best").alias("best"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                r = {name: rows.column(name)[k] for name in rows.schema.names}
                places = np.frombuffer(r["links"].as_py(), f"<u{r['width'].as_py()}")
                n_groups = r["n_groups"].values
                ends = bounds(n_groups.to_numpy())
                links = r["known"].values.to_numpy() if len(places) else np.empty(0, np.int64)
                best = r["best"].values.to_numpy(zero_copy_only=False).astype(np.int64) if len(places) else links
                sums, bests = bounds(links[places])[ends], bounds(best[places])[ends]
                yield pa.RecordBatch.from_arrays([
                    r["doc_ids"].values, r["n_a"].values, r["n_b"].values, n_groups, n_groups,
                    pa.array(np.diff(bests)), pa.array(np.diff(sums)), r["hashes"].values], schema=_DIGEST)

    numbers = blocks.drop("pairs", "counts").join(of_block, "block", "left")
    return numbers.mapInArrow(finish, (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
