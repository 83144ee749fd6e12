"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of a text has a learned vector; filters ``WIDTH`` bytes wide slide over the whole text in
steps of ``STRIDE``, so chunks overlap and cover it all; each filter's largest response anywhere is
kept, and these are combined into one probability. The same code serves training (gradients go through
the winning chunks alone) and scoring.

Input columns ``doc_id`` and ``text`` (and ``quality`` to learn from); others are ignored. A null or
empty text is one chunk of padding and gets that chunk's score; repeated rows each give a row; a null
doc_id is scored too; without labelled rows, every score is 0.5; an empty table gives no rows. A task
holds one slice of texts, or ``LONG`` bytes of a longer text at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._shared import resident, ship, slices, utf8_columns

WIDTH, STRIDE, DEPTH, FILTERS = 16, 8, 8, 48
#: Bounded sample to learn from: labelled rows, and the code points of a text among them; of a longer text,
#: one of its windows of so many, which overlap by half.
SAMPLE, SAMPLE_TEXT = 4000, 16_384
THRESHOLD = 0.7
#: Bytes of text convolved at a time.
LONG = 1 << 17
PAD = 256


@dataclass
class Network:
    embed: np.ndarray  # 257 x DEPTH, the last row pads
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float

    @staticmethod
    def new(seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        return Network(f(257, DEPTH, by=0.5), f(WIDTH * DEPTH, FILTERS, by=(2 / (WIDTH * DEPTH)) ** 0.5), np.zeros(FILTERS, np.float32), f(FILTERS, by=FILTERS**-0.5), 0.0)

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Each filter at each chunk of padded codes."""
        v = self.embed[codes].reshape(-1)
        n = (len(codes) - WIDTH) // STRIDE + 1
        chunks = np.lib.stride_tricks.as_strided(v, (n, WIDTH * DEPTH), (STRIDE * DEPTH * 4, 4))
        return chunks @ self.filters

    def pool(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts data[at[i]:at[i+1]]: each filter's largest response, the chunk that has it, and
        the padded codes."""
        sizes = np.diff(at)
        chunks = np.maximum(1, -(-np.maximum(sizes - WIDTH, 0) // STRIDE) + 1)
        first = np.cumsum(chunks) - chunks
        # Texts lie apart by enough padding that a chunk which starts in a text ends before the next.
        starts = np.cumsum(chunks * STRIDE + WIDTH) - (chunks * STRIDE + WIDTH)
        codes = np.full(int(starts[-1] + chunks[-1] * STRIDE + WIDTH), PAD, np.int64)
        if len(data):
            codes[np.repeat(starts - (at[:-1] - at[0]), sizes) + np.arange(at[-1] - at[0])] = data[at[0] : at[-1]]
        every = self.responses(codes)
        rows = np.repeat(starts // STRIDE - first, chunks) + np.arange(int(chunks.sum()))
        mine = every[rows]
        best = np.maximum.reduceat(mine, first, axis=0)
        return best, (codes, rows, mine, first, chunks), sizes

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text."""
        out = np.zeros(len(at) - 1)
        for lo, hi in slices(np.diff(at), LONG):
            if at[hi] - at[lo] > LONG:  # one long text, in windows that overlap by a chunk
                cuts = range(int(at[lo]), int(at[hi]) - WIDTH, LONG)
                pooled = np.max([self.pool(data, np.array([c, min(c + LONG + WIDTH, at[hi])]))[0][0] for c in cuts], axis=0)[None]
            else:
                pooled = self.pool(data, at[lo : hi + 1])[0]
            z = self.logit(pooled).astype(np.float64)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def learn(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, rate: float = 4e-3, batch: int = 32) -> Network:
    """Fit by Adam on the logistic loss; the rarer label weighs as much in all as the other one.
    Few rows are gone over more often, so that about a thousand steps are taken (8 to 60 epochs)."""
    epochs = epochs or min(60, max(8, 1000 * batch // len(texts)))
    net, r = Network.new(), np.random.default_rng(1)
    params = ["embed", "filters", "bias", "out"]
    m = {p: np.zeros_like(getattr(net, p)) for p in params} | {"shift": 0.0}
    v = {p: np.zeros_like(getattr(net, p)) for p in params} | {"shift": 0.0}
    share = np.clip(labels.mean(), 0.02, 0.98)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), batch):
            mine = order[lo : lo + batch]
            data = np.frombuffer(b"".join(texts[i] for i in mine), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in mine])])
            best, (codes, rows, every, first, chunks), _ = net.pool(data, at)
            hidden = np.maximum(best + net.bias, 0)
            z = hidden @ net.out + net.shift
            d = ((1 / (1 + np.exp(-z)) - labels[mine]) * weight[mine] / len(mine)).astype(np.float32)
            dh = d[:, None] * net.out * (hidden > 0)
            grad = {"out": hidden.T @ d, "shift": float(d.sum()), "bias": dh.sum(0)}
            # The winning chunk of each text and filter, the first of equals.
            won = np.minimum.reduceat(np.where(every == np.repeat(best, chunks, axis=0), np.arange(len(every))[:, None], len(every)), first, axis=0)
            places = (rows[won] * STRIDE)[:, :, None] + np.arange(WIDTH)
            seen = codes[places]
            vectors = net.embed[seen].reshape(len(mine), FILTERS, -1)
            grad["filters"] = np.einsum("bk,bkw->wk", dh, vectors)
            back = (dh[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], seen.reshape(-1), back)
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.9 * step / total)
            for p in [*params, "shift"]:
                g = grad[p]
                m[p] = 0.9 * m[p] + 0.1 * g
                v[p] = 0.99 * v[p] + 0.01 * g * g
                setattr(net, p, getattr(net, p) - lr * (m[p] / (1 - 0.9**step)) / ((v[p] / (1 - 0.99**step)) ** 0.5 + 1e-7))
    net.shift = float(net.shift)
    for p in params:
        setattr(net, p, getattr(net, p).astype(np.float32))
    return net


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learn from at most ``sample`` labelled rows that are not held out, chosen by a hash of doc_id,
    and of a text longer than SAMPLE_TEXT code points from one of its windows, chosen by that hash too. Both
    bounds keep what the driver holds within 256 MB."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "quality")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    size, half = F.length("text"), SAMPLE_TEXT // 2
    windows = F.greatest(F.ceil((size - half) / half), F.lit(1))
    window = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id"), windows) * half + 1).cast("int"), F.lit(SAMPLE_TEXT))
    texts = docs.select("doc_id", F.when(size <= SAMPLE_TEXT, F.col("text")).when(size > SAMPLE_TEXT, window).otherwise("").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    if not rows:
        return None
    return learn([r["text"].encode("utf-8", "surrogatepass") for r in rows], np.array([r["quality"] for r in rows], np.float64))


def batch_scores(net: Network | None, column: pa.Array) -> np.ndarray:
    if net is None or not len(column):
        return np.full(len(column), 0.5)
    return net.scores(*utf8_columns(column))


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            s = batch_scores(net, batch.column(1))
            out = [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows that the classifier accepts, all columns kept; without a model, every row."""
    ship(docs.sparkSession)
    if net is None:
        return docs
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(net, batch.column(place)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
