"""op3, op5 and the pipeline against plain versions that share no code with them."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import distance, near, redacted
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import byte_cnn, lz_fingerprint, warc_normaliser

DATA = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_fingerprint(text):
    """LZ78 with a trie of numbers, the least 58-bit hash of each of 64 bins, empty bins from the next filled one."""
    trie, phrases, node, start = {}, set(), 0, 0
    for i, c in enumerate(text):
        if (node, c) in trie:
            node = trie[node, c]
        else:
            trie[node, c] = len(trie) + 1
            phrases.add(text[start : i + 1])
            node, start = 0, i + 1
    least = {}
    for p in phrases:
        h = mix((sum(mix(ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(p)) + len(p)) & M)
        least[h >> 58] = min(h & (1 << 58) - 1, least.get(h >> 58, M))
    if not least:
        return [0] * 64
    out = []
    for b in range(64):
        far = next(k for k in range(64) if (b + k) % 64 in least)
        out.append(mix(least[(b + far) % 64] + far) & 0xFFFF)
    return out


def test_fingerprints_equal_a_plain_parse(spark):
    odd = [(None, "null id"), (None, None), (70, ""), (71, None), (72, "a" * 3000), (73, "é日🙂" * 40), (74, "same same"), (74, "same same"), (74, "other of that id")]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({c: F.lit("x") for c in ("part", "head", "tail", "fingerprint")})
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, (x[1] or "").encode()))
    want = Counter()
    of = {t: plain_fingerprint(t) for t in {t or "" for _, t in rows}}
    share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 64
    told = lambda f: "".join(f"{x:04x}" for x in f)
    for (doc, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        b = plain_fingerprint(edited)
        want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), told(of[text]), told(b), share(of[text], b), share(of[text], of[following])] += 1
    assert Counter(map(tuple, lz_fingerprint.fingerprints(docs).collect())) == want


def plain_score(net, raw):
    """Every chunk of 16 bytes, 8 apart, up to the end of the text, by loops."""
    best = np.full(byte_cnn.FILTERS, -np.inf)
    start = 0
    while True:
        chunk = [raw[k] if k < len(raw) else 256 for k in range(start, start + 16)]
        best = np.maximum(best, sum(net.embed[c].astype(float) @ net.filters[8 * k : 8 * k + 8].astype(float) for k, c in enumerate(chunk)))
        if start + 16 >= len(raw):
            break
        start += 8
    z = sum(max(b + s, 0) * o for b, s, o in zip(best.tolist(), net.bias.tolist(), net.out.tolist(), strict=True)) + net.shift
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("long", [64, 1 << 17])
def test_network_equals_plain_loops(long, monkeypatch):
    monkeypatch.setattr(byte_cnn, "LONG", long)
    net = byte_cnn.Network.new(5)
    r = np.random.default_rng(1)
    net.bias, net.shift = r.standard_normal(byte_cnn.FILTERS).astype(np.float32), 0.3
    sizes = [0, 1, 7, 8, 15, 16, 17, 23, 24, 25, 63, 64, 65, 69, 79, 80, 81, 128, 129, 143, 145, 300, 1000] + ([(1 << 17) + 5, (1 << 17) + 30] if long > 64 else [])
    texts = [bytes(r.integers(97, 123, n, dtype=np.uint8)).decode() for n in sizes]
    got = byte_cnn.batch_scores(net, pa.array([*texts, None]))
    assert np.allclose(got, [plain_score(net, t.encode()) for t in [*texts, ""]], atol=1e-5)


def test_long_labelled_texts_are_learnt_from(spark, monkeypatch):
    """Windows of long texts, which overlap by half, have what tells the labels apart."""
    monkeypatch.setattr(byte_cnn, "SAMPLE_TEXT", 200)
    rows = [(k, ("good words here " if k % 2 else "BAD ## STUFF !! ") * 60, k % 2) for k in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    net = byte_cnn.fit(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in byte_cnn.score(docs, net).collect()}
    assert sum(got[k] == q for k, _, q in rows) >= 115
    assert byte_cnn.keep_good(docs.where("false"), net).count() == 0 and byte_cnn.keep_good(docs, None).count() == 120


ODD = [
    (None, None), (None, ""), (800001, None), (800002, ""), (800003, "  \n"), (800004, "password=abcdefgh12 " * 3000), (800004, "password=abcdefgh12 " * 3000),
    (None, "a text of no id that stands here once with some words"), (800005, "one two three"), (800006, "one two three"), (800006, "One  two\nthree"),
]


@pytest.fixture()
def odd_dir(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    every = docs.unionByName(odd).unionByName(docs.limit(20)).withColumns({c: F.lit("x") for c in ("node", "score", "__mine", "item_id", "spans", "n_tokens", "quality")})
    every.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    net = byte_cnn.fit(docs, spark.read.parquet(f"{odd_dir}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [x for x in rows if plain_score(net, (x[1] or "").encode()) >= 0.7]
    sets, root, _ = near(rows)
    first = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            first[root[i]] = min(first.get(root[i], (True, 0, 0)), (d is None, d or 0, i)) if root[i] in first else (d is None, d or 0, i)
    rows = [rows[i] for *_, i in first.values()] + [x for i, x in enumerate(rows) if not sets[i]]
    items = [" ".join(r["text"].split()).lower() for r in spark.read.parquet(f"{odd_dir}/benchmark.parquet").collect()]

    def leaks(text):
        """An item's window with three edits at most holds one of its four quarters unchanged."""
        low = " ".join(text.split()).lower()
        for item in items:
            for s in range(len(item) - 49):
                w = item[s : s + 50]
                for q in range(0, 48, 12):
                    at = low.find(w[q : q + 12])
                    while at >= 0:
                        if distance(w, low[max(0, at - q - 4) : at - q + 54]) <= 3:
                            return True
                        at = low.find(w[q : q + 12], at + 1)
        return False

    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for d, t in rows:
        if t is None or not leaks(t):
            ids = library.encode(redacted(t or ""), add_special_tokens=False).ids
            want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, odd_dir)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want


def test_stages_keep_columns_and_take_empty_tables(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for table in (docs.where("false"), docs.where("doc_id >= 800001 or doc_id is null")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, odd_dir)
            assert table.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, table, odd_dir).count() == table.count() <= len(ODD)


def test_very_long_page(spark):
    rows = [(1, "u", "é<p>" * 2_000_000), (2, "u", "é<p>" * 2_000_000), (3, "u", "x")]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_normaliser.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (10_000_000, "revisit", 2), 2: (10_000_000, "response", None), 3: (1, "response", None)}
