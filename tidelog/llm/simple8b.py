"""Token-id files in Simple-8b: 64-bit words whose selector says how many ids of which width they hold.

A word's top four bits are its selector, the other sixty hold ids, first id lowest. Selector 0 is the
escape: the next word is one raw 64-bit id, for ids wider than any layout. A file is

    magic | words | block table | document table | footer

Blocks hold ``BLOCK`` ids, the last one of a group of blocks what is left, and start at a word; the block
table has (first word, ids), so a reader seeks to any blocks and unpacks them with a few vector
operations. The document table has (doc_id, is
null, ids). The footer has the two tables' places and lengths.

Input columns ``doc_id`` and ``text``; others are ignored. A null or empty text is the end id alone;
repeated rows each take their place; ties of doc_id are ordered by text; a null doc_id comes first;
an empty table gives no rows. A task holds one group of blocks, one slice of texts and its shard's
document table (24 bytes a document). A shard is written under a name of its own attempt and counts
only if that attempt's row reaches the manifest, so lost executors leave nothing half read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._shared import filesystem, from_lists, resident, shared_folder, ship, slices, stored

#: Ids of a block; blocks packed or unpacked at a time; zeros that a block's last word may reach into.
MAGIC, BLOCK, GROUP, PADDING = b"TLS8B\0\0\1", 1024, 256, 60
#: (ids in a word, bits of each) by selector from 1 on.
LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
FOOTER = struct.Struct("<qqqq")
#: Remembered pieces of text (a bound on memory only).
CACHE = 1_200_000
#: Marks that are one pre-token behind letters; bytes of texts encoded at a time, a longer text alone.
MARKS, SLICE = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 1 << 23


def _below(x: np.ndarray, bits: int) -> np.ndarray:
    return np.ones(x.shape, bool) if bits >= 8 * x.itemsize else x < x.dtype.type(1 << bits)


def _steps(x: np.ndarray) -> np.ndarray:
    """For each place of each block (a row, zeros after its ids) the selector of a word that starts
    there: the one that holds most ids. Layouts of up to five ids are decided by running maxima, the
    denser ones, which few places fit, for those places alone."""
    n = x.shape[1] - PADDING
    two = np.maximum(x[:, :-1], x[:, 1:])
    four = np.maximum(two[:, :-2], two[:, 2:])
    most = {1: x, 2: two, 3: np.maximum(two[:, :-1], x[:, 2:]), 4: four, 5: np.maximum(four[:, :-1], x[:, 4:])}
    best = np.zeros((len(x), n), np.int8)
    row = col = np.zeros(0, np.int64)
    for sel in range(len(LAYOUTS), 0, -1):
        count, bits = LAYOUTS[sel - 1]
        if count <= 5:
            fits = _below(most[count][:, :n], bits)
            np.putmask(best, fits, sel)
            if count == 5:
                row, col = np.nonzero(fits)
            continue
        ok = _below(x[row[:, None], col[:, None] + np.arange(count)], bits).all(axis=1)
        row, col = row[ok], col[ok]
        if not len(row):
            break
        best[row, col] = sel
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as words, and the number of words of each block of BLOCK ids. All blocks are walked in step,
    one word of each at a time."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = np.min_scalar_type(max(1 << 15, int(ids.max())))  # narrow ids are quicker to look through
    x = np.zeros((blocks, BLOCK + PADDING), kind)
    flat = np.zeros(blocks * BLOCK, kind)
    flat[:n] = ids
    x[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    sel = _steps(x)
    counts = np.array([1, *(c for c, _ in LAYOUTS)])
    step = counts[sel].ravel()
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    live, at, starts = np.arange(blocks), np.zeros(blocks, np.int64), np.zeros(blocks * BLOCK, bool)
    while len(live):
        where = live * BLOCK + at
        starts[where] = True
        at = at + step[where]
        more = at < size[live]
        live, at = live[more], at[more]
    where = np.flatnonzero(starts)
    row, col = where // BLOCK, where % BLOCK
    chosen = sel[row, col]
    escapes = chosen == 0
    place = np.arange(len(where)) + np.cumsum(escapes) - escapes
    words = np.zeros(len(where) + int(escapes.sum()), np.uint64)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        r, c = row[here], col[here]
        if s == 0:
            words[place[here] + 1] = x[r, c]
            continue
        count, bits = LAYOUTS[s - 1]
        word = np.full(len(here), int(s) << 60, np.uint64)
        for k in range(count):
            word |= x[r, c + k].astype(np.uint64) << np.uint64(k * bits)
        words[place[here]] = word
    return words, np.bincount(row, 1 + escapes, blocks).astype(np.int64)


def unpack(words: np.ndarray, per_block: np.ndarray, n: int) -> np.ndarray:
    """The n ids of blocks in a row, given each one's words; every block but the last is full."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(len(per_block)), per_block)
    raw = np.zeros(0, np.int64)
    if (sel == 0).any():
        # What follows an escape is a raw id, which may look like any selector, an escape's included.
        is_raw = np.zeros(len(words), bool)
        for i in np.flatnonzero(sel == 0):
            if not is_raw[i]:
                is_raw[i + 1] = True
        raw = np.flatnonzero(is_raw)
        words, sel, block, raw = words[~is_raw], sel[~is_raw], block[~is_raw], words[raw]
    counts = np.array([1, *(c for c, _ in LAYOUTS), 0])[sel]
    before = np.cumsum(counts) - counts
    first = np.searchsorted(block, np.arange(len(per_block)))
    to = block * (BLOCK + PADDING) + before - before[first][block] if len(words) else before
    out = np.zeros(len(per_block) * (BLOCK + PADDING), np.uint64)
    for s in np.unique(sel):
        here = np.flatnonzero(sel == s)
        if s == 0:
            out[to[here]] = raw
            continue
        count, bits = LAYOUTS[s - 1]
        mask, w, t = np.uint64((1 << bits) - 1), words[here], to[here]
        for k in range(count):
            out[t + k] = w >> np.uint64(k * bits) & mask
    return out.reshape(-1, BLOCK + PADDING)[:, :BLOCK].ravel()[:n]


class Writer:
    """Writes one file; ids may come in any portions."""

    def __init__(self, out):
        self.out, self.held, self.n_held = out, [], 0
        self.blocks: list[tuple[int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.words = 0
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, int(doc is None), len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK * GROUP:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        at, size = 0, BLOCK * GROUP
        while len(ids) - at >= size or (all_of_it and at < len(ids)):
            part = ids[at : at + size]
            words, per_block = pack(part)
            self.out.write(words.tobytes())
            firsts = self.words + np.cumsum(per_block) - per_block
            sizes = np.diff(np.append(np.arange(0, len(part), BLOCK), len(part)))
            self.blocks += zip(firsts.tolist(), sizes.tolist(), strict=True)
            self.words += len(words)
            at += len(part)
        self.held, self.n_held = [ids[at:]], len(ids) - at

    def close(self) -> None:
        self._flush(True)
        start = len(MAGIC) + 8 * self.words
        self.out.write(np.array(self.blocks, np.int64).tobytes())
        self.out.write(np.array(self.docs, np.int64).tobytes())
        self.out.write(FOOTER.pack(start, len(self.blocks), start + 16 * len(self.blocks), len(self.docs)))


class Reader:
    """Reads a seekable file block by block."""

    def __init__(self, f):
        self.f = f
        size = f.seek(0, os.SEEK_END) or f.tell()
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a Simple-8b token file")
        f.seek(size - FOOTER.size)
        at, n_blocks, docs_at, n_docs = FOOTER.unpack(f.read(FOOTER.size))
        f.seek(at)
        self.blocks = np.frombuffer(f.read(16 * n_blocks), np.int64).reshape(-1, 2)
        self.docs = np.frombuffer(f.read(24 * n_docs), np.int64).reshape(-1, 3)
        self.words = (at - len(MAGIC)) // 8

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids of blocks lo to hi - 1."""
        firsts = np.append(self.blocks[lo:hi, 0], self.blocks[hi, 0] if hi < len(self.blocks) else self.words)
        self.f.seek(int(len(MAGIC) + 8 * firsts[0]))
        words = np.frombuffer(self.f.read(int(8 * (firsts[-1] - firsts[0]))), np.uint64)
        return unpack(words, np.diff(firsts), int(self.blocks[lo:hi, 1].sum()))

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first id's number, ids, crc32 of the ids as 32-bit integers) of each document."""
        k, held, start = 0, b"", 0
        for doc, null, n in self.docs.tolist():
            left, crc = 4 * n, 0
            while left:
                if not held:
                    held = memoryview(self.ids(k, min(k + GROUP, len(self.blocks))).astype("<u4").tobytes())
                    k += GROUP
                crc = zlib.crc32(held[:left], crc)
                left, held = left - min(left, len(held)), held[left:]
            yield (None if null else doc), start, n, crc
            start += n


class Encoder:
    """The tokenizers library behind a memory of pieces: a byte-level vocabulary with the usual pattern
    has a pre-token boundary wherever a single space follows other text, so the library need see each
    distinct piece between such spaces once. Texts with other white space beside a space, or with a
    special string, go to the library whole. A newline begins a piece too, and letters with marks behind
    them are two pre-tokens, so that the library sees words more than their combinations."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        letters = "".join(c for c in map(chr, range(0x530)) if c.isalpha())
        self.marked = f"^(?P<word>[{letters}]+)(?P<tail>[{re.escape(MARKS)}]+)$"
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(self.library.get_vocab_size(), bool)  # ids whose text begins with a space
        self.breaks = self.opens.copy()  # ids whose text begins with a newline
        for token, i in vocabulary.items():
            self.opens[i], self.breaks[i] = token[:1] == "\u0120", token[:1] == "\u010a"

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _pieces(self, pieces: list[str], first: np.ndarray) -> Iterator[bytes]:
        """Ids of pieces that each begin with a space, or each with a newline: of many at once, as only
        a piece's first id begins so."""
        for at in range(0, len(pieces), 1000):
            part = pieces[at : at + 1000]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [*np.flatnonzero(first[ids]).tolist(), len(ids)]
            if len(cuts) != len(part) + 1:
                yield from self._library(part)
                continue
            raw = ids.tobytes()
            yield from (raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:]))  # noqa: B905

    def _known(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of each of some distinct pieces after a space (one that begins with a newline: as it is);
        None for those with other white space at an end."""
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        asked = [k for k, ids in enumerate(out) if ids is None]
        lines, runs, words = [], [], []
        for k in asked:
            p = pieces[k]
            if p in old:
                young[p] = old[p]
            elif p and not p[-1].isspace():
                if p[0] == "\n":
                    (runs if "\n" in p[1:] else lines).append(p)
                elif not p[0].isspace():
                    words.append(p)
        young.update(zip(runs, self._library(runs), strict=True))
        young.update(zip(lines, self._pieces(lines, self.breaks), strict=True))
        young.update(zip(words, self._pieces([" " + q for q in words], self.opens), strict=True))
        for k in asked:
            out[k] = young.get(pieces[k])
        for q in (*runs, *lines, *words):
            if len(q) > 64:
                del young[q]
        if len(young) >= CACHE // 2:
            self.old, self.young = young, {}
        return out

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; a null is empty."""
        column = column.fill_null("")
        for lo, hi in slices(pc.binary_length(column).to_numpy(zero_copy_only=False), SLICE):
            yield from self._slice(column.slice(lo, hi - lo))

    def _slice(self, column: pa.Array) -> Iterator[np.ndarray]:
        # A newline begins a piece as a space does, unless it follows one; where it stands beside a
        # space, an empty piece or one that ends in white space comes about, and tells.
        spaced = pc.replace_substring(column, "\n", " \n")
        for _ in range(2):
            spaced = pc.replace_substring(spaced, "\n \n", "\n\n")
        split = pc.split_pattern(spaced, " ")
        at = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))
        coded = split.flatten().dictionary_encode()
        pieces, code = coded.dictionary, coded.indices.to_numpy()
        # Letters with marks behind them are looked up apart.
        pair = pc.extract_regex(pieces, self.marked)
        two = pc.is_valid(pair).to_numpy(zero_copy_only=False)
        word = pc.coalesce(pc.struct_field(pair, "word"), pieces).dictionary_encode()
        tail = pc.struct_field(pair, "tail").dictionary_encode()
        known = self._known(word.dictionary.to_numpy(zero_copy_only=False).tolist())
        tails = self._library(tail.dictionary.to_pylist())
        main, behind = word.indices.to_numpy(), len(known) + tail.indices.fill_null(0).to_numpy()
        # A text's first piece has no space before it, so it is an entry of its own behind the others.
        first = at[:-1]
        heads = pieces.take(pa.array(code[first])).to_pylist()
        second = two[code]
        second[first] = False
        place = np.arange(len(code)) + np.cumsum(second) - second
        entry = np.empty(len(code) + int(second.sum()), np.int64)
        entry[place] = main[code]
        entry[place[second] + 1] = behind[code[second]]
        entry[place[first]] = len(known) + len(tails) + np.arange(len(heads))
        begins = np.append(place[first], len(entry))
        bad = np.zeros(len(known) + len(tails) + len(heads), bool)
        bad[: len(known)] = [ids is None for ids in known]
        whole = np.logical_or.reduceat(bad[entry], begins[:-1]) | pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)
        whole |= np.array([h[-1:].isspace() for h in heads]) & (np.diff(at) > 1)
        # A text that begins with a newline has an empty first piece, not told from one with a space.
        whole |= pc.starts_with(column, "\n").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole).tolist():
            heads[i] = column[i].as_py()
        table = [ids or b"" for ids in known] + tails + self._library(heads)
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, begin = np.frombuffer(b"".join(table), "<u4"), np.cumsum(sizes) - sizes
        size = sizes[entry]
        for i in np.flatnonzero(whole).tolist():
            size[begins[i] + 1 : begins[i + 1]] = 0  # the text is all in its first entry
        ends = np.cumsum(size)
        ids = flat[np.repeat(begin[entry] - (ends - size), size) + np.arange(ends[-1])]
        cuts = np.append(0, ends)[begins].tolist()
        yield from (ids[i:j] for i, j in zip(cuts, cuts[1:]))  # noqa: B905


def encoder(path: str) -> Encoder:
    return resident(Encoder, path)


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int) -> DataFrame:
    """Encode texts in ascending doc_id order into one file a range partition; one manifest row a file:
    shard, path, n_ids, n_docs."""
    ship(docs.sparkSession)
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, ids, n = None, None, 0, 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            if out is None:
                enc = encoder(vocabulary)
                fs, base = filesystem(folder)
                fs.create_dir(base, recursive=True)
                shard = TaskContext.get().partitionId()
                path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.tls8b"
                out = fs.open_output_stream(path)
                w = Writer(out)
            for doc, got in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                w.add(doc, np.append(got, end))
                ids, n = ids + len(got) + 1, n + 1
        if out is not None:
            w.close()
            out.close()
            yield from_lists(schema, [(shard, path, ids, n)])

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id, or of none, are dealt by how their texts begin.
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "shard long, path string, n_ids long, n_docs long")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32. Starts go on over shards."""
    spark = manifest.sparkSession
    # One row a file: the window is over as many rows as there are files, never over documents.
    based = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["base"])
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as f:
                    rows = []
                    for doc, start, n, crc in Reader(f).documents():
                        rows.append((doc, base + start, n, crc))
                        if len(rows) == 10_000:
                            yield from_lists(schema, rows)
                            rows = []
                    yield from_lists(schema, rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.select("path", "base").repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the token files, keep their manifest, and read them back."""
    folder = shared_folder(docs.sparkSession)
    manifest = stored(write_shards(docs, vocabulary, f"{folder}/ids", end_id), "manifest")
    return read_shards(manifest, f"{folder}/ids")
