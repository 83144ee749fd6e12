"""Lempel-Ziv phrase fingerprints: documents that compress alike have like phrase sets.

A text is parsed from left to right into phrases, each the longest known phrase and one code point
more (LZ78). The distinct phrases are hashed, the hashes dealt over ``BINS`` bins, and the fingerprint
keeps the least hash of each bin (one-permutation minimum hashing; an empty bin borrows from the next
filled one). Likeness is the share of bins that agree, 0 to 1.

Input columns ``doc_id`` and ``text``; others are ignored. A null or empty text has no phrases: its
fingerprint is of the empty set, which equals itself. Repeated rows each give a row; ties of doc_id
are ordered by text; a null doc_id comes last in descending order; a table of one row is its own next
document; an empty table gives no rows. A task streams its rows in order and holds two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._shared import from_lists, ship, stored

BINS = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """_BASE ** i modulo 2**64 for i below n."""
    p = np.ones(max(n, 1), np.uint64)
    p[1:] = _BASE
    return np.multiply.accumulate(p)


class Parse:
    """An LZ78 parse that can be copied and continued with another tail."""

    def __init__(self):
        self.seen: set[str] = set()
        self.open = ""
        self.phrases: list[str] = []

    def feed(self, text: str) -> None:
        seen, w = self.seen, self.open
        add, out = seen.add, self.phrases.append
        for c in text:
            w += c
            if w not in seen:
                add(w)
                out(w)
                w = ""
        self.open = w

    def copy(self) -> Parse:
        p = Parse()
        p.seen, p.open, p.phrases = self.seen.copy(), self.open, self.phrases.copy()
        return p

    def fingerprint(self) -> np.ndarray:
        """Least hashes by bin, 16 bits of each."""
        # What is left open at the end is a known phrase, so the set has it already.
        if not self.phrases:
            return np.zeros(BINS, np.uint16)
        raw = np.frombuffer("".join(self.phrases).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, self.phrases), np.int64, len(self.phrases))
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(len(raw)) - np.repeat(starts, sizes)
        powers = _powers(int(sizes.max()) + 1)
        h = _mix(np.add.reduceat(_mix(raw + np.uint64(1)) * powers[inside], starts) + sizes.astype(np.uint64))
        least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, (h >> np.uint64(58)).astype(np.int64), h & np.uint64((1 << 58) - 1))
        filled = np.flatnonzero(least != np.iinfo(np.uint64).max)
        # An empty bin takes the next filled one's value, mixed with how far that is.
        to = filled[np.searchsorted(filled, np.arange(BINS)) % len(filled)]
        far = (to - np.arange(BINS)) % BINS
        return (_mix(least[to] + far.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def _unhex(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u2").astype(np.uint16)


def compare(text: str, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text's digest, and the fingerprints of the text and the edited text."""
    half = len(text) // 2
    kept, tail, other = text[: len(text) - half], text[len(text) - half :], following[:half]
    digest = hashlib.sha256((kept + other).encode("utf-8", "surrogatepass")).hexdigest()
    parse = Parse()
    parse.feed(kept)
    if tail == other:
        parse.feed(tail)
        own = parse.fingerprint()
        return digest, own, own
    edited = parse.copy()
    edited.feed(other)
    parse.feed(tail)
    return digest, parse.fingerprint(), edited.fingerprint()


def fingerprint(text: str) -> np.ndarray:
    p = Parse()
    p.feed(text)
    return p.fingerprint()


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next one in descending doc_id order.

    The table is range-partitioned once; each task walks its rows in order with the next row at hand.
    Only the border rows, two texts a partition, go to a second step that pairs each partition's last
    row with the first row of the next partition that has any (the very last with the very first).
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, first, rows = TaskContext.get().partitionId(), None, None, []

        def finished(doc, text, own, edited, digest, following):
            return (doc, len(text), digest, _hex(own), _hex(edited), likeness(own, edited), likeness(own, following), None, None, None)

        pending = None  # a finished parse that waits for the next document's fingerprint
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if before is None:
                    first = text
                else:
                    digest, own, edited = compare(before[1], text)
                    if pending:
                        rows.append(finished(*pending, own))
                    pending = (before[0], before[1], own, edited, digest)
                before = (doc, text)
                if len(rows) >= 1000:
                    yield from_lists(_ROWS, rows)
                    rows = []
        if before is not None:
            if pending:
                rows.append(finished(*pending, fingerprint(before[1])))
            rows.append((before[0], None, None, None, None, None, None, part, first, before[1]))
            yield from_lists(_ROWS, rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id, or of none, are dealt by how their texts begin.
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").desc_nulls_last(), F.substring("text", 1, 16)).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.col("text"))
    walked = stored(ordered.mapInArrow(run, f"{RESULT}, part int, head string, tail string"), "walked")

    # As many rows as there are partitions.
    borders = walked.where("part is not null").select("doc_id", "part", "tail")
    order = Window.orderBy("part")
    slim = borders.select("part", F.lead("part").over(order).alias("next"), F.min("part").over(Window.partitionBy()).alias("least"))
    following = walked.where("part is not null").select(F.col("part").alias("next"), "head")
    pairs = slim.select("part", F.coalesce("next", "least").alias("next")).join(following, "next").join(borders, "part").select("doc_id", "tail", "head")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tail, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest, own, edited = compare(tail, head)
                rows.append((doc, len(tail), digest, _hex(own), _hex(edited), likeness(own, edited), likeness(own, fingerprint(head))))
            yield from_lists(pa.schema(list(_ROWS)[:7]), rows)

    names = [c.split()[0] for c in RESULT.split(", ")]
    return walked.where("part is null").select(*names).unionByName(pairs.mapInArrow(close, RESULT))
