"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document leaks an item if some ``WINDOW`` consecutive characters of the item stand in it with at
most ``EDITS`` edits (a shorter item: all of it, with edits in proportion). Both texts are compared in
lower case with white space runs as one space. If a window matches with e edits, text and window share
at least WINDOW - Q + 1 - e * Q q-grams, at as many places of the text, whose diagonals (place in text less
place in item) lie within e of each other. So: look up each q-gram of the text in the items' index; keep
places dense enough to hold a match at all; deal their (item, diagonal) pairs over diagonal bands that
overlap by half; keep the bands with q-grams at enough places close together; and align those regions, all
windows of one at a time, in a band of diagonals. The lemma has no false dismissals, so the result is that
of aligning all pairs.

Repetition would make pairs by the square of its length. What repeats with a period of at most ``PERIOD``
is the same everywhere but near its ends, so whole periods are left out of its middle, in items and in texts
with many pairs: every stretch of a window and its edits still stands there, and the first and last of
them where they stood. Pairs are made ``PAIRS`` at a time, by stretches of text that overlap by a window
and by ranges of items, so memory does not grow with their number.

Input columns ``doc_id`` and ``text``, ``item_id`` and ``text``; others are ignored. A null or empty
text or item matches nothing; an item of fewer than Q characters, too short for q-grams and for edits, is
looked for as it stands after lower case and white space, at any place; repeated rows each give
their rows; equal items are each reported; null ids are carried; with an empty benchmark or no
documents, nothing matches. Items are indexed in blocks, by tasks that write them to the shared folder; the
documents are read once, and a task holds some texts and the index of one block.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._shared import filesystem, from_lists, resident, shared_folder, ship, slices

Q, WINDOW, EDITS = 10, 50, 3
#: Characters of items in one block; more items make more blocks. Bytes of texts that are held while the
#: blocks go by.
BLOCK_CHARS, HELD_BYTES = 2_000_000, 32 << 20
#: Longest period of repetition that is shortened; pairs of a text from which that is tried; pairs of places
#: made at a time.
PERIOD, MANY, PAIRS = 256, 1 << 16, 1 << 19
BITS = 20
_B = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4)]
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
OUTSIDE = np.uint32(0xFFFFFFFF)

_lower: np.ndarray | None = None


def _lower_table() -> np.ndarray:
    """Lower case by code point, white space as a space."""
    global _lower
    if _lower is None:
        t = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x1E944):  # no cased letters lie beyond
            c = chr(i)
            if c.isspace():
                t[i] = 32
            elif len(low := c.lower()) == 1:
                t[i] = ord(low)
        _lower = t
    return _lower


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points to compare of the texts one after another, the texts' borders, and each code
    point's place in its own text."""
    codes = _lower_table()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    keep[(ends - sizes)[sizes > 0]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    at = np.concatenate([[0], before[ends]]) if len(texts) else np.zeros(1, np.int64)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    return codes[keep], at, place[keep]


def told(codes: np.ndarray) -> str:
    """Code points as a text."""
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q = 10 code points from each place on."""
    c = codes.astype(np.uint64) + np.uint64(1)
    h2 = c[:-1] * _B[0] + c[1:]
    h4 = h2[:-2] * _B[1] + h2[2:]
    h8 = h4[:-4] * _B[2] + h4[4:]
    return (h8[:-2] * _B[1] + h2[8:]) * _SPREAD


def shortened(codes: np.ndarray) -> np.ndarray:
    """Which code points stay when whole periods are left out of the middle of what repeats with a period of at
    most PERIOD. On either side stays a period and more than a window with its edits, so stretches of
    that length, and the places of the first and the last of each, are the same as before."""
    at = np.arange(len(codes))
    for p in range(1, PERIOD + 1):
        side = WINDOW + EDITS + p
        if len(codes) < 2 * side + p:
            break
        same = np.zeros(len(codes) - p + 2, bool)
        same[1:-1] = codes[p:] == codes[:-p]
        edge = np.flatnonzero(same[1:] != same[:-1])
        first, size = edge[::2], edge[1::2] - edge[::2] + p
        cut = (size - 2 * side) // p * p
        gone = np.flatnonzero(cut > 0)
        if len(gone):
            keep = np.ones(len(codes), bool)
            for k in gone:
                keep[first[k] + side : first[k] + side + cut[k]] = False
            codes, at = codes[keep], at[keep]
    return at


@dataclass
class Index:
    """One block of items: q-grams with their places, and each item's window and budget."""

    ids: list
    codes: list[np.ndarray]
    window: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    sorted_grams: np.ndarray
    #: Of each place of a q-gram, in order: number of the q-gram times number of items, plus the item.
    place: np.ndarray
    offset: np.ndarray
    table: np.ndarray
    #: Items of fewer than Q characters: place in ids and the text to find.
    short: list[tuple[int, str]]

    @staticmethod
    def of(items: list[tuple[int | None, str]]) -> Index | None:
        ids, codes, tiny = [], [], []
        for i, text in items:
            c, _, _ = normal([text.strip()])
            if len(c) >= Q:
                ids.append(i)
                codes.append(c)
            elif len(c):
                tiny.append((i, told(c)))
        short = [(len(ids) + k, t) for k, (_, t) in enumerate(tiny)]
        ids += [i for i, _ in tiny]
        if not codes:
            none = np.zeros(0, np.int64)
            return Index(ids, codes, none, none, none, none, none, none, none, short) if short else None
        # What is shortened holds its q-grams twice at least.
        codes = [c[shortened(c)] if len(c) > 2 * WINDOW and np.unique(g := grams(c)).size < len(g) else c for c in codes]
        sizes = np.array([len(c) for c in codes])
        window = np.minimum(sizes, WINDOW)
        edits = np.minimum(window * EDITS // WINDOW, (window - Q) // Q)
        each = [grams(c) for c in codes]
        g = np.concatenate(each)
        item = np.repeat(np.arange(len(each)), [len(x) for x in each])
        offset = np.concatenate([np.arange(len(x)) for x in each])
        order = np.argsort(g, kind="stable")
        g, item, offset = g[order], item[order], offset[order]
        unique, number = np.unique(g, return_inverse=True)
        table = np.zeros(1 << BITS, bool)
        table[(unique >> np.uint64(64 - BITS)).astype(np.int64)] = True
        return Index(ids, codes, window, edits, window - Q + 1 - edits * Q, unique, number * len(codes) + item, offset, table, short)

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """Leaks of all items, as of_long() tells them."""
        rows = self.of_long(texts) if self.codes else []
        return sorted([*rows, *self.of_short(texts)], key=lambda r: r[:2]) if self.short else rows

    def of_short(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        codes, at, place = normal(texts)
        for t in range(len(texts)):
            text = told(codes[at[t] : at[t + 1]])
            for i, item in self.short:
                n, first, last = 0, -1, text.find(item)
                while last >= 0:
                    n, first, end = n + 1, last if n == 0 else first, last + len(item)
                    last = text.find(item, last + 1)
                if n:
                    yield t, i, int(place[at[t] + first]), int(place[at[t] + end - 1]) + 1, n, 0

    def hits(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places with q-grams of items that are dense enough for some item, their q-grams and texts."""
        g = grams(codes)
        hit = np.flatnonzero(self.table[(g >> np.uint64(64 - BITS)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.sorted_grams, g[hit]), len(self.sorted_grams) - 1)
        real = self.sorted_grams[found] == g[hit]
        hit, found = hit[real], found[real]
        text = np.searchsorted(at, hit, "right") - 1
        inside = hit + Q <= at[text + 1]
        hit, found, text = hit[inside], found[inside], text[inside]
        ok = dense(text, hit, int(self.need.min()), int((self.window + self.edits).max()) - Q)
        return hit[ok], found[ok], text[ok]

    def places(self, found: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the places of q-grams in items a to b begin, and how many they are."""
        base = found * len(self.codes)
        lo = np.searchsorted(self.place, base + a)
        return lo, np.searchsorted(self.place, base + b) - lo

    def of_long(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start, end, windows, least edits) of every leak; places are code points of the
        text as given, the end exclusive, from the first to the last stretch that matches; windows are the
        different ones of the item that do."""
        codes, at, place = normal(texts)
        if len(codes) < Q:
            return []
        hit, found, text = self.hits(codes, at)
        pairs = np.bincount(text, self.places(found, 0, len(self.codes))[1], len(texts))
        if (pairs > MANY).any():
            stay = [at[t] + (shortened(codes[at[t] : at[t + 1]]) if pairs[t] > MANY else np.arange(at[t + 1] - at[t])) for t in range(len(texts))]
            codes, place, at = codes[np.concatenate(stay)], place[np.concatenate(stay)], np.concatenate([[0], np.cumsum([len(x) for x in stay])])
            hit, found, text = self.hits(codes, at)
        out: dict[tuple[int, int], tuple[int, int, int, set]] = {}
        for lo, hi, a, b in self.portions(hit, found):
            for t, i, start, end, cost, window in self.matches(codes, at, hit[lo:hi], found[lo:hi], text[lo:hi], a, b):
                s, e, c, windows = out.get((t, i)) or (start, end, cost, set())
                windows.add(window)
                out[t, i] = (min(s, start), max(e, end), min(c, cost), windows)
        return [(t, i, int(place[s]), int(place[e - 1]) + 1, len(w), c) for (t, i), (s, e, c, w) in sorted(out.items())]

    def portions(self, hit: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Ranges of hits and of items with about PAIRS pairs each. Each range of hits also has those within
        a window and its edits behind it, so that every match lies whole in one."""
        n = np.cumsum(self.places(found, 0, len(self.codes))[1])
        start, reach = 0, int((self.window + self.edits).max())
        while start < len(hit):
            before = int(n[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(n, before + PAIRS, "right")))
            end = int(np.searchsorted(hit, hit[stop - 1] + reach, "right"))
            yield from ((start, end, a, b) for a, b in self.item_ranges(found[start:end], 0, len(self.codes)))
            start = stop

    def item_ranges(self, found: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Ranges of items a to b that have few pairs with these q-grams, or are one item."""
        n = int(self.places(found, a, b)[1].sum())
        if n > 4 * PAIRS and b - a > 1:
            yield from self.item_ranges(found, a, (a + b) // 2)
            yield from self.item_ranges(found, (a + b) // 2, b)
        elif n:
            yield a, b

    def matches(self, codes, at, hit, found, text, a: int, b: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
        """Windows of items a to b that match: (text, item, start, end, edits, window)."""
        first, n = self.places(found, a, b)
        pick = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hit, text, item, offset = np.repeat(hit, n), np.repeat(text, n), self.place[pick] % len(self.codes), self.offset[pick]
        band = (hit - offset) // (self.edits[item] + 1)
        # Every pair is in two bands, each two steps wide: any edits + 1 diagonals lie in one of them.
        text, item, hit, band = np.tile(text, 2), np.tile(item, 2), np.tile(hit, 2), np.concatenate([band, band - 1])
        order = np.lexsort((hit, band, item, text))
        text, item, hit, band = text[order], item[order], hit[order], band[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        group = np.cumsum(fresh)
        # A place counts once, however often its q-gram stands in the item.
        fresh[1:] |= hit[1:] != hit[:-1]
        text, item, hit, band, group = text[fresh], item[fresh], hit[fresh], band[fresh], group[fresh]
        ok = np.zeros(len(hit), bool)
        for m, e, need in {*zip(self.window[a:b].tolist(), self.edits[a:b].tolist(), self.need[a:b].tolist(), strict=True)}:
            mine = np.flatnonzero((self.window[item] == m) & (self.edits[item] == e))
            ok[mine] = dense(group[mine], hit[mine], need, m + e - Q)
        text, item, hit, band, group = text[ok], item[ok], hit[ok], band[ok], group[ok]
        if not len(hit):
            return
        # A region: places of one band no farther apart than a window and its edits.
        cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (hit[1:] - hit[:-1] > WINDOW + EDITS)]))
        for lo, hi in zip(cut, np.append(cut[1:], len(hit)), strict=True):
            t, i, k = int(text[lo]), int(item[lo]), int(band[lo])
            e, m = int(self.edits[i]), int(self.window[i])
            d0, d1 = k * (e + 1), (k + 2) * (e + 1) - 1
            for start, end, cost, w in self.align(codes, at[t], at[t + 1], i, d0, d1, int(hit[lo]), int(hit[hi - 1])):
                yield t, i, start, end, cost, self.codes[i][w : w + m].tobytes()

    def align(self, codes, begin, end, i, d0, d1, p0, p1) -> Iterator[tuple[int, int, int, int]]:
        """Windows of item i that match near places p0 to p1 of the text at begin to end, on diagonals
        d0 to d1 and the edits beside them: (start, end, edits, place in the item) of each. All windows go in step, one
        row of the edit table at a time, its insertions by a running minimum."""
        item, m, e = self.codes[i], int(self.window[i]), int(self.edits[i])
        lo = max(0, p0 - d1 - m)
        hi = min(len(item) - m, p1 + Q - d0)
        if hi < lo:
            return
        starts = np.arange(lo, hi + 1)
        diagonals = np.arange(d0 - e, d1 + e + 1)
        slack = np.arange(len(diagonals))
        cost = np.zeros((len(starts), len(diagonals)), np.int32)
        cost[:] = np.where((starts[:, None] + diagonals >= begin) & (starts[:, None] + diagonals <= end), 0, m + 1)
        for r in range(m):
            at = starts[:, None] + r + diagonals
            inside = (at >= begin) & (at < end)
            differ = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)] != item[starts + r][:, None], m + 1)
            new = cost + differ
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(new - slack, axis=1) + slack
        best = cost.argmin(axis=1)
        for w in np.flatnonzero(cost[np.arange(len(starts)), best] <= e):
            d = int(diagonals[best[w]])
            last = min(int(starts[w]) + m + d, int(end))
            yield max(int(begin), last - m), last, int(cost[w, best[w]]), int(starts[w])


def dense(group: np.ndarray, at: np.ndarray, need: int, reach: int) -> np.ndarray:
    """Which places (sorted by group, then place) lie in some ``need`` of a group within ``reach``."""
    if len(at) < need:
        return np.zeros(len(at), bool)
    k = need - 1
    n = len(at) - k
    full = (group[:n] == group[k:]) & (at[k:] - at[:n] <= reach)
    edge = np.zeros(len(at) + 1, np.int64)
    edge[:n] += full
    edge[need : need + n] -= full
    return np.cumsum(edge[:-1]) > 0


def blocks(benchmark: DataFrame) -> list[str]:
    """Files of the indexes over the items, a block each, that tasks have written to the shared folder. Only
    their names come to the driver."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null and text <> ''")
    chars = items.agg(F.sum(F.length("text"))).first()[0]
    if not chars:
        return []
    folder = f"{shared_folder(spark)}/items"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path)

        def written(index: Index | None) -> Iterator[pa.RecordBatch]:
            if index:
                name = f"{uuid.uuid4().hex}.index"
                with fs.open_output_stream(f"{path}/{name}") as f:
                    pickle.dump(index, f)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        held, size = [], 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((item, text.as_py()))
                size += len(held[-1][1])
                if size >= BLOCK_CHARS:
                    yield from written(Index.of(held))
                    held, size = [], 0
        yield from written(Index.of(held))

    return sorted(r[0] for r in items.repartition(1 + chars // BLOCK_CHARS).mapInArrow(run, "path string").collect())


def _index(path: str) -> Index:
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as f:
        return pickle.load(f)


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_windows", pa.int64()), ("edits", pa.int32())])
LEAKS = "doc_id long, item_id long, start long, end long, n_windows long, edits int"


def _leaks(index: Index, column: pa.Array) -> Iterator[tuple]:
    texts = column.fill_null("")
    for lo, hi in slices(np.array([len(x.as_py()) for x in texts]), 1 << 19):
        for row in index.leaks(texts.slice(lo, hi - lo).to_pylist()):
            yield (lo + row[0], *row[1:])


def _groups(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[list[pa.RecordBatch]]:
    """Batches one by one or, so that several blocks are read less often, some at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if not several or sum(b.nbytes for b in held) >= HELD_BYTES:
            yield held
            held = []
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, start, end, n_windows, edits."""
    spark = docs.sparkSession
    ship(spark)
    paths = blocks(benchmark)
    if not paths:
        return docs.select("doc_id").where("false").selectExpr("doc_id", "doc_id as item_id", "doc_id as start", "doc_id as end", "doc_id as n_windows", "cast(doc_id as int) as edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(paths) > 1):
            for path in paths:
                index = resident(_index, path)
                for batch in group:
                    ids = batch.column(0)
                    yield from_lists(_LEAKS, [(ids[t].as_py(), index.ids[i], s, e, n, c) for t, i, s, e, n, c in _leaks(index, batch.column(1))])

    return docs.select("doc_id", "text").mapInArrow(run, LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that leak no item, all columns kept."""
    ship(docs.sparkSession)
    paths = blocks(benchmark)
    if not paths:
        return docs
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(paths) > 1):
            keep = [np.ones(batch.num_rows, bool) for batch in group]
            for path in paths:
                index = resident(_index, path)
                for batch, mine in zip(group, keep, strict=True):
                    mine[[t for t, *_ in _leaks(index, batch.column(place))]] = False
            for batch, mine in zip(group, keep, strict=True):
                yield batch.filter(pa.array(mine))

    return docs.mapInArrow(run, docs.schema)
