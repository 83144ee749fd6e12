"""The q-gram filter on repetition, odd rows, many blocks and empty tables."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tidelog.llm import qgram_filter
from tidelog.llm.qgram_filter import EDITS, WINDOW, Index, normal


def ends(pattern, text):
    """Least edits of the pattern in the text, and the first and last place where a match within the budget ends."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row


def brute(texts, index, items):
    out = {}
    for k, t in enumerate(texts):
        text = normal([t])[0].tolist()
        for i, (name, item) in enumerate(items):
            c = normal([item.strip()])[0].tolist()
            m, e = int(index.window[i]), int(index.edits[i])
            for s in range(len(c) - m + 1):
                row = ends(c[s : s + m], text)
                if min(row) <= e:
                    had = out.get((k, name), (99, 0))
                    out[k, name] = (min(had[0], min(row)), max(had[1], max(j for j, v in enumerate(row) if v <= e)))
    return out


def periodic(r):
    p = "".join(r.choice("ab-=|") for _ in range(r.choice([1, 1, 2, 3, 5, 9, 17])))
    return p * (r.choice([12, 30, 45, 70, 150, 300]) // len(p) + 1)


@pytest.mark.parametrize("pairs", [20, 1 << 19])
def test_periodic_texts_equal_brute_force(pairs, monkeypatch):
    monkeypatch.setattr(qgram_filter, "PAIRS", pairs)
    monkeypatch.setattr(qgram_filter, "MANY", 50)
    r = random.Random(pairs)
    word = lambda: "".join(r.choice("cdefgh") for _ in range(r.randint(3, 9)))
    items = [(k, word() + x + word() + " " + word() if k % 3 else "q" + x) for k, x in enumerate(periodic(r)[:90] for _ in range(5))]
    texts = []
    for _ in range(8):
        parts = [r.choice([periodic(r)[:200], r.choice(items)[1][r.randint(0, 5) :], word()]) for _ in range(3)]
        t = list("".join(parts))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("zx")
        texts.append("".join(t))
    index = Index.of(items)
    got = {(t, index.ids[i]): (c, e) for t, i, _, e, _, c in index.leaks(texts)}
    want = brute(texts, index, items)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and want
    # A match may be told to end a few edits before the last place where one can.
    for k, (_, end) in got.items():
        assert abs(len(normal([texts[k[0]][:end]])[0]) - want[k][1]) <= EDITS, k


def test_shortening_keeps_every_stretch():
    r = random.Random(2)
    for _ in range(60):
        codes = normal(["".join(r.choice([periodic(r), "xyz"]) for _ in range(4))])[0]
        stay = qgram_filter.shortened(codes)
        cut = codes[stay]
        span = WINDOW + EDITS
        of = lambda c: {c[k : k + span].tobytes() for k in range(max(1, len(c) - span + 1))}
        assert of(codes) == of(cut) and (stay[:1] == 0).all() and (stay[-1:] == len(codes) - 1).all()


@pytest.mark.parametrize(("item", "text"), [("x" + "-" * 120 + "y", "-" * 1_000_000), ("-" * 40 + "abcdefghijklmnopqrstu", "-" * 1_000_000), ("ab" * 2000, "ab" * 500_000), ("0123456789" * 30, "0123456789" * 100_000)])
def test_long_repetition_takes_seconds(item, text):
    index = Index.of([(1, item)])
    began = time.time()
    tracemalloc.start()
    got = index.leaks([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - began < 20 and peak < 500e6
    assert [(t, i, s, e, c) for t, i, s, e, _, c in got] == ([] if item.endswith("u") else [(0, 0, 0, len(text), 0)])


def test_odd_rows_and_many_blocks(spark, monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(500)]
    items = [(k, " ".join(r.choices(words, k=20))) for k in range(12)] + [(12, None), (13, ""), (None, " ".join(r.choices(words, k=20)))]
    items += [items[3], (99, items[3][1])]
    texts = [(k % 5 or None, " ".join([*r.choices(words, k=30), r.choice(items)[1] or "", *r.choices(words, k=30)])) for k in range(30)]
    texts += [texts[0], texts[0], (7, None), (8, ""), (9, "w " * 100_000 + items[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("item_id", "start", "path", "edits")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    monkeypatch.setattr(qgram_filter, "HELD_BYTES", 1000)
    told = {}
    for chars in (2_000_000, 150):
        monkeypatch.setattr(qgram_filter, "BLOCK_CHARS", chars)
        told[chars] = sorted(map(str, qgram_filter.leaks(docs, bench).collect()))
        kept = qgram_filter.without_leaks(docs, bench)
        assert kept.columns == docs.columns
        clean = [(d, t) for d, t in texts if not any(i and i in (t or "") for _, i in items)]
        assert sorted(map(str, ((x["doc_id"], x["text"]) for x in kept.collect()))) == sorted(map(str, clean))
    assert told[150] == told[2_000_000] and len(told[150]) > 20
    assert qgram_filter.leaks(docs.where("false"), bench).count() == 0 and qgram_filter.without_leaks(docs.where("false"), bench).count() == 0
    assert qgram_filter.without_leaks(docs, bench.where("false")).count() == len(texts)
    assert qgram_filter.leaks(docs, bench.where("false")).dtypes == qgram_filter.leaks(docs, bench).dtypes
