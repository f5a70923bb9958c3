"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a reference text. A text is parsed
from left to right into the longest phrases that occur in the reference; text
in the reference's language needs few, long phrases. The phrases, each worth
log2 of the reference's length in bits, over the length of the text estimate
the cross entropy; the language with the least wins.

Text is lower-cased, and ASCII characters other than letters become single
spaces; phrases are runs of the remaining UTF-8 bytes, so any script works.
Many texts are parsed in lockstep: a text is cut into stretches of ``STRETCH``
bytes, each first parsed from a fresh phrase; one step moves all stretches by a
byte in all automata at once. Then every stretch is read again from where the one
before it really ended, until both readings stand in the same state: from there
on they agree. So the counts are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import held_out, learnable, restored, set_aside, ship, slices, text_column

#: Languages are learnt from rows whose crc32 of the id, modulo FOLDS, is not HELD.
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Bytes of a text parsed as one stretch, and bytes parsed in lockstep at once.
STRETCH, PORTION = 512, 1 << 20

_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_PHRASE = np.int32(-(1 << 31))
_PLACE = np.int32((1 << 31) - 1)


@dataclass(frozen=True)
class Sample:
    """Bound of the references: texts drawn per language, bytes taken of each, bytes of the reference."""

    texts: int = 128
    bytes_per_text: int = 1024
    reference: int = 32_768


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def suffix_automaton(reference: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``reference``."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in reference:
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return follow


class CrossParser:
    """Automata of all languages in one table of transitions.

    ``table[state * symbols + symbol]`` is the next state times ``symbols``. If
    the phrase cannot go on, the entry leads on from the root by the symbol and
    carries the mark of a new phrase. A symbol that the reference lacks is a
    phrase of its own and leads back to the root.
    """

    def __init__(self, references: dict[str, bytes]):
        self.languages = sorted(references)
        seen = sorted(set(b"".join(references.values())))
        self.symbols = len(seen) + 1
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        tables, self.roots, base = [], [], 0
        for name in self.languages:
            follow = suffix_automaton(references[name])
            table = np.full((len(follow), self.symbols), -1, np.int64)
            for state, steps in enumerate(follow):
                table[state, self.symbol[list(steps)]] = [(base + t) * self.symbols for t in steps.values()]
            first = np.where(table[0] >= 0, table[0], base * self.symbols)
            table[0] = -1  # whatever is read at the root starts a phrase
            tables.append(np.where(table >= 0, table, first[None, :] - (1 << 31)).astype(np.int32))
            self.roots.append(base * self.symbols)
            base += len(follow)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
        if base * self.symbols >= 1 << 31:
            raise ValueError("references are too long for one table")
        self.bits = np.log2([max(2, len(references[n])) for n in self.languages])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases each text needs in each language: one row a text."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        owner, parts, size, before = [], [], 0, None
        for i, text in enumerate(texts):
            for s in range(0, len(text), STRETCH):
                owner.append(i)
                parts.append(text[s : s + STRETCH])
                size += STRETCH
                if size >= PORTION:
                    end = self._parse(parts, owner, out, before)
                    before = end if s + STRETCH < len(text) else None
                    owner, parts, size = [], [], 0
        if parts:
            self._parse(parts, owner, out, before)
        return out

    def _parse(self, parts: list[bytes], owner: list[int], out: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """Adds the phrases of stretches in text order; returns the states after the last one.

        ``before``: the states after the stretch before the first one, if that goes on with its text.
        """
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        lengths = np.array([len(parts[i]) for i in order])
        symbols = np.zeros((STRETCH, len(parts)), np.int32)
        for k, i in enumerate(order):
            symbols[: lengths[k], k] = self.symbol[np.frombuffer(parts[i], np.uint8)]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(parts), axis=1)
        count = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-lengths, -np.arange(STRETCH), side="left")  # stretches longer than the step
        for step in range(int(lengths[0])):
            n = live[step]
            nxt = self.table[state[:, :n] + symbols[step, :n]]
            count[:, :n] -= nxt >> 31
            state[:, :n] = nxt & _PLACE
        place = np.argsort(order)
        owner, lengths, ends = np.array(owner), lengths[place], state[:, place]
        np.add.at(out, owner, count[:, place].T)

        goes_on = np.concatenate(([before is not None], owner[1:] == owner[:-1]))
        chain = np.cumsum(~goes_on)
        fresh_ends, more = ends.copy(), np.zeros(ends.shape, np.int64)
        starts = np.concatenate((ends[:, :1] if before is None else before[:, None], ends[:, :-1]), axis=1)
        waiting = np.repeat(goes_on[None, :], len(ends), axis=0)
        # First all at once, as if every stretch had come into step by its end; then, where one had not, those after it in order.
        lang, part = np.nonzero(waiting)
        while len(part):
            waiting[lang, part] = False
            more[lang, part], end, in_step = self._again(symbols, place[part], lengths[part], lang, starts[lang, part])
            end = np.where(in_step, fresh_ends[lang, part], end)
            moved = (end != ends[lang, part]) & (part + 1 < len(parts))
            ends[lang, part] = end
            lang, part, end = lang[moved], part[moved] + 1, end[moved]
            waiting[lang, part] |= goes_on[part]
            starts[lang, part] = end
            lang, part = np.nonzero(waiting)
            first = np.unique(lang * (len(parts) + 1) + chain[part], return_index=True)[1]
            lang, part = lang[first], part[first]
        np.add.at(out, owner, more.T)
        return ends[:, -1]

    def _again(self, symbols: np.ndarray, column: np.ndarray, lengths: np.ndarray, lang: np.ndarray, start: np.ndarray):
        """Stretches read from ``start`` beside a fresh reading, until both agree or the stretch ends.

        Returns the phrases that this reading has more, its state, and whether they agree.
        """
        more, end, in_step = np.zeros(len(column), np.int64), start.copy(), np.zeros(len(column), bool)
        at, state, fresh, step = np.arange(len(column)), start, np.array(self.roots, np.int32)[lang], 0
        while len(at):
            symbol = symbols[step, column[at]]
            state, fresh = self.table[state + symbol], self.table[fresh + symbol]
            more[at] += (fresh >> 31) - (state >> 31)
            state, fresh = state & _PLACE, fresh & _PLACE
            end[at], in_step[at] = state, state == fresh
            step += 1
            on = (state != fresh) & (lengths[at] > step)
            at, state, fresh = at[on], state[on], fresh[on]
        return more, end, in_step

    def decide(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text. The score is the lead of the winner in bits, as a share of the runner-up."""
        letters = [bool(_LETTER.search(t)) for t in texts]
        data = [folded(t) if has else b"" for t, has in zip(texts, letters)]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        entropy = self.phrases(data) * self.bits / np.maximum([[len(d)] for d in data], 1)
        out = []
        for row, has in zip(entropy, letters):
            if not has:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(row.argmin())
            rest = np.delete(row, best)
            lead = 1.0 if not len(rest) else float(1 - row[best] / rest.min()) if rest.min() > 0 else 0.0
            out.append((self.languages[best], min(max(lead, 0.0), 1.0)))
        return out


def references(docs: DataFrame, sample: Sample = Sample()) -> dict[str, bytes]:
    """The reference text of every language of the learnable rows.

    A language gives the text with the smallest hash in each of ``texts``
    buckets of hashes, so copies count once and at most ``texts`` rows a
    language come to the driver, cut to ``bytes_per_text`` characters.
    """
    text = F.col("text").cast("string")
    rows = docs.where(learnable("doc_id", FOLDS, HELD) & F.col("lang").isNotNull() & text.rlike(r"\p{L}")).select(
        F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64(text, F.lit(3)).alias("hash"))
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(sample.texts)))
    low = rows.groupBy("lang", "bucket").agg(F.min("hash").alias("hash"))
    # At most ``texts`` rows a language.
    found = rows.join(F.broadcast(low), ["lang", "bucket", "hash"]).select(
        "lang", "hash", F.substring("text", 1, sample.bytes_per_text).alias("text")).distinct().collect()
    out: dict[str, bytes] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.hash, r.text)):
        out[r.lang] = (out.get(r.lang, b"") + b" " + folded(r.text)[: sample.bytes_per_text])[: sample.reference]
    return {k: v for k, v in out.items() if v.strip()}


_parsers: dict[int, CrossParser] = {}


def identify(docs: DataFrame, known: dict[str, bytes]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, read from each whole text alone.

    ``und`` and score 0 where the text is null or has no letter, or no language
    is known. A tie goes to the language that sorts first, with score 0. Other
    columns pass through; columns of the two names are replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)})
    keep = rows.columns[:-2]

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(shared.value.items())))
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = CrossParser(shared.value)
        for batch in slices(batches):
            langs, scores = zip(*_parsers[key].decide(text_column(batch, "text")))
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(decided, rows.schema)


def predictions(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of (doc_id, text, lang).

    Rows with a null id or lang teach nothing; a null id is not held out.
    Repeated rows are predicted each on its own. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = identify(rows, references(docs, sample))
    return found.select("doc_id", held_out("doc_id", FOLDS, HELD).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """The rows of ``docs`` in some language, with their columns; null and letterless texts go.

    If no row teaches a language, every text with a letter stays.
    """
    known = references(docs, sample)
    if not known:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    found = identify(set_aside(docs, "lang_pred", "score"), known)
    return restored(found.where(F.col("lang_pred") != UNKNOWN), docs)
