"""N-gram Jaccard self-join by MinHash banding, and the near-duplicate classes that follow from it.

Words are runs without ASCII white space, in ASCII lower case; an n-gram is five words in a row; a text
of one to four words is one n-gram of all of them. Texts with equal n-gram sets are one node, however
many rows have them. ``BANDS`` bands of ``ROWS`` minimum hashes send a pair of Jaccard 0.8 to a common
bucket with probability 1 - (1 - 0.8**6)**32 = 0.99994. Bucket hashes are shuffled. A node's home is the
largest of its buckets; a home with many nodes is split into blocks, small ones near one another share some;
and two blocks meet in a task only where some bucket has nodes of both. There every pair with a common bucket is verified on its full n-gram
sets, each pair once, as each node has one block. So unlike texts that a chain of chance collisions
connects do not meet, and a hot bucket is dealt over pairs of its blocks. What leaves a task is each
node's number of links and a path through each group of linked nodes, never the pairs; classes are
components of these verified links. Texts travel, not their sets of n-grams: eight bytes a word are more
than a compressed word.

Input columns ``doc_id`` and ``text``; others are ignored. Null, empty and wordless texts have no
n-grams and link to nothing; repeated rows are copies of one node and link to each other, and one of them
travels; null ids are carried, and are the class id only where a class has no other; an empty table gives
no rows. A text longer than a slice is read alone, and blocks of very long texts hold fewer of them.
Executors may be lost at any time: each step's table lies in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm._shared import apart, discard, from_lists, resident, ship, slices, stored, utf8_columns

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
#: Nodes of a block, and bytes of their texts, on average (fewer nodes where texts are very long); two
#: blocks at most meet in a task.
BLOCK, BLOCK_BYTES = 192, 64 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_seed = np.random.default_rng(20240229)
_A = _seed.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _seed.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _seed.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        p = np.full((2, size), [[_B], [_INV]], np.uint64)
        p[:, 0] = 1
        _powers[size] = tuple(np.multiply.accumulate(p, axis=1))
    return _powers[size]


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts data[at[i]:at[i+1]] one after another, and the texts' borders."""
    n_docs = len(at) - 1
    mine = data[at[0] : at[-1]]
    base = at - at[0]
    space = _SPACE[mine]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    begins = base[:-1][np.diff(base) > 0]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= space[1:]
    ends_of = base[1:][np.diff(base) > 0] - 1
    last[ends_of] = word[ends_of]
    ends = np.flatnonzero(last) + 1
    up, down = _power(len(mine) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[mine].astype(np.uint64) + np.uint64(1)) * up[: len(mine)])])
    w = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    border = np.searchsorted(starts, base)
    counts = np.diff(border)
    grams = np.where(counts >= N, counts - N + 1, counts > 0)
    out = np.concatenate([[0], np.cumsum(grams)])
    doc = np.repeat(np.arange(n_docs), grams)
    pos = border[:-1][doc] + (np.arange(out[-1]) - out[:-1][doc])
    h = np.full(len(pos), 0, np.uint64)
    short = counts[doc] < N
    for k in range(N):
        there = ~short | (k < counts[doc])
        h = np.where(there, h * np.uint64(_B) + w[np.minimum(pos + k, max(len(w) - 1, 0))] if len(w) else h, h)
    return _mix(h + np.where(short, counts[doc], N).astype(np.uint64)), out


def signatures(h: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Band hashes of each text that has n-grams, zeros for the others."""
    out = np.zeros((len(border) - 1, BANDS), np.uint64)
    has = np.flatnonzero(np.diff(border))
    if not len(has):
        return out
    starts = border[:-1][has]
    for b in range(BANDS):
        key = np.full(len(has), b + 1, np.uint64)
        for r in range(ROWS):
            k = b * ROWS + r
            key = (key ^ (np.minimum.reduceat(h * _A[k] + _C[k], starts) >> np.uint64(20))) * _MIX[r]
        out[has, b] = _mix(key)
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("bands", pa.binary()), ("size", pa.int64())])
SKETCH = "doc_id long, text_hash long, node binary, bands binary, size long"


def nodes_of(column: pa.Array, bands: bool) -> tuple[list[bytes | None], list[bytes | None]]:
    """Each text's node (a digest of its n-gram set, None without n-grams) and, if asked for, its band
    hashes."""
    data, at = utf8_columns(column)
    nodes, keys = [], []
    for lo, hi in slices(np.diff(at), 1 << 19):
        h, border = shingles(data, at[lo : hi + 1])
        sig = signatures(h, border).astype("<u8") if bands else None
        for i in range(hi - lo):
            mine = h[border[i] : border[i + 1]]
            nodes.append(hashlib.blake2b(np.unique(mine).tobytes(), digest_size=16).digest() if len(mine) else None)
            keys.append(sig[i].tobytes() if bands and len(mine) else None)
    return nodes, keys


def sketch(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, node, bands, size (bytes of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            nodes, keys = nodes_of(batch.column(1), True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(keys, pa.binary()), pc.binary_length(batch.column(1)).cast(pa.int64())], schema=_SKETCH)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SKETCH)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), the root one of the component's nodes.

    Each round orders nodes by a hash of its own and sends each to the first of itself and its neighbours;
    edges are then drawn between where their ends went, and those within one place go. A chance order
    shortens chains of any shape by a share every round, so rounds grow with the logarithm of a component's
    width. Neighbours are reduced in part before they are shuffled, and labels are joined as they were written, so
    partitions of a hub's edges can be split. Each round lies in the shared folder.
    """
    edges = stored(_drawn(edges.select("a", "b")), "edges")
    steps: list[DataFrame] = []
    while not steps or not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("node"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = stored(first.select(F.col("a").alias("node"), F.least("m", order("a"))["node"].alias("root")), "labels")
        to = lambda of, at: step.select(F.col("node").alias(of), F.col("root").alias(at))  # noqa: B023, E731
        drawn = stored(_drawn(edges.join(to("a", "x"), "a").join(to("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
        discard(edges)
        edges = drawn
        steps.append(step)
    # Every node is in the first round; only ends of edges move on in the later ones, the others are at their root.
    found = steps[0]
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = stored(found, "found")
    discard(edges, *steps)
    return found


def _drawn(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


_LINKS = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])


def _sets(texts: pa.Array) -> list[np.ndarray]:
    data, at = utf8_columns(texts)
    out = []
    for lo, hi in slices(np.diff(at), 1 << 19):
        h, border = shingles(data, at[lo : hi + 1])
        out += [np.unique(h[border[i] : border[i + 1]]) for i in range(hi - lo)]
    return out


def verify_block(left: list[int], right: list[int] | None, bands: np.ndarray, sets: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of the nodes in rows ``left`` with those in ``right`` (or among ``left``): each node's
    number of linked rows, and a path through each group of linked nodes, so that no node is a hub."""
    links, tree = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def root(x: int) -> int:
        while tree[x] != x:
            tree[x] = tree[tree[x]]
            x = tree[x]
        return x

    other = np.array(left if right is None else right)
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate([sets[j] for j in other])
    bounds = np.concatenate([[0], np.cumsum(sizes[other])])
    for k, i in enumerate(left):
        meet = (bands[other] == bands[i]).any(axis=1)
        if right is None:
            meet[: k + 1] = False
        # A set can't reach the threshold with one too small or too large.
        meet &= (np.minimum(sizes[other], sizes[i]) >= THRESHOLD * np.maximum(sizes[other], sizes[i]) - 1e-9)
        near = np.flatnonzero(meet)
        if not len(near):
            continue
        if len(near) * 4 > len(other):
            at = np.minimum(np.searchsorted(sets[i], every), sizes[i] - 1)
            both = np.add.reduceat(sets[i][at] == every, bounds[:-1], dtype=np.int64)[near]
        else:
            both = np.array([np.isin(sets[other[j]], sets[i], assume_unique=True).sum() for j in near])
        # Jaccard >= 4/5, in whole numbers.
        linked = near[5 * both >= 4 * (sizes[i] + sizes[other[near]] - both)]
        for j in other[linked].tolist():
            links[i] += rows[j]
            links[j] += rows[i]
            a, b = root(i), root(j)
            tree[max(a, b)] = min(a, b)
    last: dict[int, int] = {}
    path: list[tuple[int, int]] = []
    for i in np.flatnonzero(links).tolist():
        r = root(i)
        if r in last:
            path.append((last[r], i))
        last[r] = i
    return links, path


def _verify(table: pa.Table) -> pa.Table:
    resident()
    node, block = table.column("node").to_pylist(), np.array(table.column("block").to_pylist())
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    texts = table.column("text").combine_chunks()
    # Rows that repeat a node, or whose text has another node (ids may repeat), go.
    own, _ = nodes_of(texts, False)
    keep, seen = [], set()
    for r, n in enumerate(node):
        if own[r] == n and n not in seen:
            seen.add(n)
            keep.append(r)
    if len(keep) < 2:
        return _LINKS.empty_table()
    node, block = [node[r] for r in keep], block[keep]
    bands = np.stack([np.frombuffer(table.column("bands")[r].as_py(), "<u8") for r in keep])
    rows = np.array([table.column("n_rows")[r].as_py() for r in keep])
    left = np.flatnonzero(block == i).tolist()
    right = None if i == j else np.flatnonzero(block == j).tolist()
    if not left or right == []:
        return _LINKS.empty_table()
    links, path = verify_block(left, right, bands, _sets(texts.take(pa.array(keep))), rows)
    out = [(node[k], None, int(n)) for k, n in enumerate(links) if n] + [(node[a], node[b], 0) for a, b in path]
    return pa.Table.from_batches([from_lists(_LINKS, out)])


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketch rows, nodes): nodes have node, class_node (one node of the class),
    n_links (other rows at the threshold, copies included), n_rows, rep (its least row: doc_id, text_hash)."""
    ship(docs.sparkSession)
    rows = stored(sketch(docs), "sketch")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = stored(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n_rows"), F.min(who).alias("rep"), F.min("bands").alias("bands"), F.max("size").alias("size")), "nodes")
    keys = _band_keys(nodes)
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    if shared.isEmpty():
        found = None
    else:
        placed, meets = _blocks(keys, shared)
        found = stored(_links(docs, nodes, placed.select("node", "block"), meets), "links")
        discard(placed)
    base = nodes.select("node", "n_rows", "rep")
    if found is None:
        full = base.select("node", F.col("node").alias("class_node"), (F.col("n_rows") - 1).alias("n_links"), "n_rows", "rep")
    else:
        links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
        full = base.join(links.join(roots.withColumnRenamed("root", "class_node"), "node"), "node", "left").select("node", F.coalesce("class_node", "node").alias("class_node"), (F.col("n_rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "n_rows", "rep")
    full = stored(full, "classes")
    discard(nodes, shared, found, None if found is None else roots)
    return rows, full


def _band_keys(nodes: DataFrame) -> DataFrame:
    """(node, size, key): a row for each band. Keys hold their band, and are bytes as they came."""
    places = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return nodes.select("node", "size", F.explode(F.transform(places, lambda b: F.substring(F.col("bands"), b * 8 + 1, F.lit(8)))).alias("key"))


def _blocks(keys: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of nodes (node, block), a stored table, and which blocks meet (block, i, j): a row for each of two blocks i and j
    with a common bucket, and for each block of several nodes by itself."""
    member = keys.join(shared.select("key", "n"), "key")
    # A node has as many keys as there are bands at most.
    home = F.struct((-F.col("n")).alias("n"), "key")
    of = stored(member.groupBy("node").agg(F.min(home).alias("home"), F.max("size").alias("size"), F.collect_list("key").alias("keys")), "homes")
    # Small homes near one another are put together, by the largest home that a home's bucket reaches.
    held = of.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    reach = of.select(F.explode("keys").alias("key"), "home").groupBy("key").agg(F.min("home").alias("near"))
    size = F.greatest(F.col("n") / F.lit(BLOCK), F.col("bytes") / F.lit(BLOCK_BYTES))
    near = held.select(F.col("home.key").alias("key"), "n", "bytes", (size >= 0.5).alias("large")).join(reach, "key")
    near = stored(near.select("key", "n", "bytes", "large", F.when(F.col("large"), F.col("key")).otherwise(F.col("near.key")).alias("place")), "near")
    parts = near.groupBy("place", "large").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("place", "large", F.ceil(size).cast("int").alias("parts"))
    parts = stored(parts, "parts")
    lots = stored(near.select("key", "place", "large").join(parts, ["place", "large"]), "lots")
    part = F.pmod(F.when(F.col("large"), F.xxhash64("node")).otherwise(F.xxhash64("key")), F.col("parts"))
    placed = stored(of.select("node", F.col("home.key").alias("key"), "keys").join(lots, "key").select("node", F.xxhash64("place", "large", part).alias("block"), "keys"), "placed")
    there = placed.select("block", F.explode("keys").alias("key")).distinct()
    a, b = there.select("key", F.col("block").alias("i")), there.select("key", F.col("block").alias("j"))
    met = a.join(b, "key").where("i < j").select("i", "j").distinct()
    discard(of, near, parts, lots)
    alone = placed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block", F.col("block").alias("i"), F.col("block").alias("j"))
    return placed, met.select(F.explode(F.array("i", "j")).alias("block"), "i", "j").unionByName(alone)


def _links(docs: DataFrame, nodes: DataFrame, placed: DataFrame, meets: DataFrame) -> DataFrame:
    """Verify all pairs with a common bucket: rows (node, null, links) and path edges (node, root, 0)."""
    picked = nodes.join(placed, "node").select("node", "n_rows", "bands", "block", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"))
    # Of repeated rows one travels: they are reduced in part before they are shuffled.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).groupBy("doc_id", "text_hash").agg(F.any_value("text").alias("text"))
    same = lambda a, b: a["text_hash"].eqNullSafe(b["text_hash"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    withtext = texts.alias("t").join(picked.alias("p"), same(texts, picked)).select("p.node", "p.n_rows", "p.bands", "p.block", "t.text")
    dealt = withtext.join(meets, "block")
    # A few rows bring much work, so their size must not decide how many tasks there are.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(_verify, "node binary, root binary, links long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id, n_links (other rows at Jaccard 0.8 or more), class_rows."""
    rows, nodes = classes(docs)
    summary = stored(nodes.groupBy("class_node").agg(F.min("rep.doc_id").alias("class_id"), F.sum("n_rows").alias("class_rows")), "summary")
    slim = nodes.where("n_links > 0").join(summary, "class_node").select("node", "class_id", "n_links", "class_rows")
    return rows.select("doc_id", "node").join(slim, "node", "left").select(
        "doc_id", F.when(F.col("class_rows").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the least doc_id; rows without n-grams all stay. All
    columns are kept."""
    ship(docs.sparkSession)
    _, nodes = classes(docs)
    place, names = docs.columns.index("text"), docs.columns
    tag = apart(names)
    mine, text = f"{tag}mine", f"{tag}text"
    keep = nodes.groupBy("class_node").agg(F.min(F.struct("rep", "node")).alias("best")).select(F.col("best.node").alias(f"{tag}node"), F.col("best.rep.doc_id").alias(f"{tag}id"), F.col("best.rep.text_hash").alias(f"{tag}hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            found, _ = nodes_of(batch.column(place), False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, mine])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(mine, T.BinaryType())])).withColumn(text, F.xxhash64("text"))
    same: Column = (F.col(mine) == F.col(f"{tag}node")) & F.col("doc_id").eqNullSafe(F.col(f"{tag}id")) & (F.col(text) == F.col(f"{tag}hash"))
    # The kept row may itself be repeated: of equal keys one row stays.
    kept = marked.where(F.col(mine).isNotNull()).join(keep, same, "left_semi").dropDuplicates([mine, "doc_id", text])
    return kept.select(*names).unionByName(marked.where(F.col(mine).isNull()).select(*names))
