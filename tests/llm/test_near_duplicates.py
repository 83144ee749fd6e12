"""The n-gram join on repeated rows, null ids, chains, hubs, and pairs just above the threshold."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import near

from tidelog.llm import ngram_join

R = random.Random(4)
WORDS = [f"w{k}" for k in range(100_000)]


def edited(words, share):
    """Words with one of ``share`` put in the place of others, so that about 1 - 5 * share of n-grams stay."""
    return [R.choice(WORDS) if R.random() < share else w for w in words]


@pytest.fixture(scope="module")
def rows():
    base = R.choices(WORDS, k=120)
    out = [(7, " ".join(base))] * 3000 + [(None, " ".join(base))] * 500 + [(None, " ".join(edited(base, 0.01))) for _ in range(40)]
    out += [(8, " ".join(edited(base, 0.012))) for _ in range(150)]
    chain = R.choices(WORDS, k=1100)
    out += [(100 + k, " ".join(chain[4 * k : 4 * k + 100])) for k in range(250)]
    return out + [(9, None), (None, None), (9, "")]


def test_repeats_nulls_and_chains(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    times = Counter(t for _, t in rows)
    plain = [(None, t) for t in times]
    sets, root, _ = near(plain)
    members, least = Counter(), {}
    for i, (_, t) in enumerate(plain):
        members[root[i]] += times[t]
    of = {t: i for i, (_, t) in enumerate(plain)}
    for d, t in rows:
        if d is not None:
            least[root[of[t]]] = min(d, least.get(root[of[t]], d))
    links = [sum(times[plain[j][1]] for j in range(len(plain)) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) - bool(sets[i]) for i in range(len(plain))]
    alone = lambda i: not sets[i] or members[root[i]] == 1
    want = Counter((d, d if alone(of[t]) else least.get(root[of[t]]), links[of[t]], 1 if alone(of[t]) else members[root[of[t]]]) for d, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["class_rows"]) for r in got) == want
    chain = {r["class_id"] for r in got if r["doc_id"] and r["doc_id"] >= 100}
    assert chain == {100}


def test_kept_row_is_the_least(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()]
    plain = [(None, t) for t in dict.fromkeys(t for _, t in rows)]
    sets, root, _ = near(plain)
    of, least = {t: root[i] for i, (_, t) in enumerate(plain)}, {}
    for d, t in rows:
        if t:
            least[of[t]] = min(least.get(of[t], (True, 0)), (d is None, d or 0))
    assert sorted((of[t], d is None, d or 0) for d, t in kept if t) == sorted((c, *x) for c, x in least.items())
    assert sum(not t for _, t in kept) == 3 and (7, rows[0][1]) in kept


@pytest.mark.parametrize("shape", ["chain", "star", "both"])
def test_components_of_long_chains_and_hubs(spark, shape):
    chain = [(k, k + 1) for k in range(3000)]
    star = [(5000, 5001 + k) for k in range(3000)]
    edges = {"chain": chain, "star": star, "both": [*chain, *star, *[(9000 + 2 * k, 9001 + 2 * k) for k in range(50)], (4, 4)]}[shape]
    got = ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = Counter(r["root"] for r in got)
    nodes = {x for e in edges for x in e}
    assert len(got) == len(nodes) == len({r["node"] for r in got})
    assert sorted(groups.values(), reverse=True) == {"chain": [3001], "star": [3001], "both": [3001, 3001, *[2] * 50]}[shape]
    root = {r["node"]: r["root"] for r in got}
    assert all(root[a] == root[b] for a, b in edges)


def test_recall_just_above_the_threshold(spark):
    """Pairs of Jaccard 0.80 to 0.85: at least 99 of 100 are found."""
    rows, pairs = [], []
    while len(pairs) < 400:
        a = R.choices(WORDS, k=200)
        b = edited(a, 0.018)
        x, y = ({tuple(t[k : k + 5]) for k in range(196)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    of = {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(of[a] == of[b] for a, b in pairs) / len(pairs)
    print(f"recall at 0.80 to 0.85: {caught}")
    assert caught >= 0.99 and len(set(of.values())) >= len(pairs)
