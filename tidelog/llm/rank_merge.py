"""Token counts by rank-synchronous merging of ragged arrays.

New pre-tokens of a batch of texts lie in one flat array of symbols with sequence borders. In each
round every sequence merges all places of its own lowest-rank pair at once; sequences without a pair
leave, and what symbols survive are counted.

Input columns ``doc_id`` and ``text``; others are ignored. A null or empty text has no bytes and no
tokens; repeated rows each give a row; a null doc_id stays null; an empty table gives no rows. Memory
is bounded by a slice of texts, one text, and the counts remembered by piece and word, whose number and
length are bounded.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidelog.llm._shared import resident, ship, slices
from tidelog.llm.bpe_stream import byte_alphabet

#: Pre-token pattern of the lower-casing vocabulary (a fixed value, public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Remembered pieces, and as many words; the longest that is remembered; symbols merged at a time (bounds
#: on memory only).
CACHE, SHORT, FLAT = 500_000, 64, 1 << 18
NONE = np.int32(1 << 30)


class Counter:
    """Counts tokens of one vocabulary file with word ends, as its library does without truncation."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        chars = byte_alphabet()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + end] for b in range(256)], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.split = regex.compile(PATTERN)
        # Two generations of each memory: when one is full it takes the place of the older one.
        self.pieces: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.old_words: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge_counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        seq = np.repeat(np.arange(len(words)), sizes)
        counts = sizes.copy()
        rank = np.full(len(sym), NONE)  # of the pair that starts at a symbol
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            per = np.repeat(lowest, np.diff(np.append(starts, len(seq))))
            live = per < NONE
            if not live.all():
                sym, seq, rank, per = sym[live], seq[live], rank[live], per[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == per)
            # Of overlapping places (a a a) the first, third, ... merge.
            first = np.concatenate([[True], np.diff(at) > 1])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            np.subtract.at(counts, seq[at], 1)
            at = at - np.searchsorted(at, at)  # their places once the right halves are gone
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            for here in (at, at[at > 0] - 1):
                pair = here + 1 < len(seq)
                pair[pair] = seq[here[pair]] == seq[here[pair] + 1]
                rank[here] = NONE
                rank[here[pair]] = self.ranks(sym[here[pair]], sym[here[pair] + 1])
        return counts

    def _word_counts(self, words: set[str]) -> dict[str, int]:
        """Symbols of each of these words. What is returned is the caller's own, so that a memory that turns
        over takes nothing from it."""
        of, new = {}, []
        for w in words:
            n = self.words.get(w)
            if n is None:
                n = self.old_words.get(w)
            if n is None:
                new.append(w)
            else:
                of[w] = n
        raw = [w.encode() for w in new]
        for lo, hi in slices(np.array([len(r) for r in raw], np.int64), FLAT):
            of.update(zip(new[lo:hi], self.merge_counts(raw[lo:hi]).tolist(), strict=True))
        if len(self.words) > CACHE // 2:
            self.old_words, self.words = self.words, {}
        self.words.update((w, n) for w, n in of.items() if len(w) <= SHORT)
        return of

    def _learn(self, pieces: list[str]) -> None:
        split = []
        for p in pieces:
            low = "".join(c.lower() for c in q) if "Σ" in (q := unicodedata.normalize("NFC", p)) else q.lower()
            split.append([low] if low.isalpha() else self.split.findall(low))
        of = self._word_counts(set().union(*split))
        self.pieces.update((p, sum([of[w] for w in ws])) for p, ws in zip(pieces, split, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings inside a text are one token each."""
        extra = [0] * len(texts)
        for i, t in enumerate(texts):
            if "<|" in t:
                extra[i] = len(self.special.findall(t))
                texts[i] = self.special.sub(" ", t)
        # White space ends every pre-token, so the pieces between spaces are counted apart.
        split = [t.split(" ") for t in texts]
        new = []
        for p in set().union(*split).difference(self.pieces):
            if (x := self.old.get(p)) is None:
                new.append(p)
            else:
                self.pieces[p] = x
        self._learn(new)
        get = self.pieces.__getitem__
        out = [n + sum(map(get, ps)) for n, ps in zip(extra, split, strict=True)]
        for p in new:
            if len(p) > SHORT:
                del self.pieces[p]
        if len(self.pieces) > CACHE // 2:
            self.old, self.pieces = self.pieces, {}
        return out


def counter(path: str) -> Counter:
    return resident(Counter, path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(text).cast(pa.int64())
            counts: list[int] = []
            for lo, hi in slices(size.to_numpy(zero_copy_only=False), 4 << 20):
                counts += c.count(text.slice(lo, hi - lo).to_pylist())
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
