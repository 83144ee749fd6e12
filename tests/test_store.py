"""The store against a dictionary over four levels; checkpoints, replies, deadlines, filters, streams."""

import logging
import random

import pytest
from pyspark.sql import functions as F

from tidelog import queries
from tidelog.operators import bloom, resolve, runs
from tidelog.plans.requests import DeadlineExceeded, LogApplyError, deadline
from tidelog.schema import ENTRY, STAGED, Options
from tidelog.sources import files
from tidelog.store import BATCH, Store
from tidelog.streaming.ingest import append_changes, keyed_changes, latest_view, newest_view


def rows(spark, pairs):
    return spark.createDataFrame([(bytearray(k), bytearray(v), i) for i, (k, v) in enumerate(pairs)], "key binary, value binary, ordinal long")


@pytest.fixture()
def one(spark):
    """One shuffle partition: a run is as wide as its keys."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_compaction_keeps_tombstones_of_keys_below(one, tmp_path):
    """A merged run of the next level reaches farther than the upper ones: what it deletes stays deleted."""
    s = Store.open(one, f"file://{tmp_path}/s", Options(level0_bytes=1))

    def flushed(pairs=(), gone=()):
        if pairs:
            s.put(rows(one, pairs))
        if gone:
            s.delete(rows(one, [(k, b"") for k in gone]))
        s.flush()
        s.compact_level(0)

    flushed([(b"z", b"1")])
    s.compact_level(1)
    assert {r["level"] for r in s.runs()} == {2}
    flushed([(b"a", b"1")], [b"z"])
    assert s.get(b"z") is None
    flushed([(b"a", b"2")])
    assert s.get(b"z") is None and s.get(b"a") == b"2"
    s.compact_level(1)
    assert s.get(b"z") is None and [bytes(r["key"]) for r in s.live().collect()] == [b"a"]


def test_compaction_moves_the_oldest_runs_in_one_step(one, tmp_path):
    """As many of the oldest runs as a level has too much go down by one commit, not by one each."""
    s = Store.open(one, f"file://{tmp_path}/o", Options(run_entries=2, level0_bytes=1, level_ratio=1))
    s.put(rows(one, [(bytes([k]), b"1") for k in range(40)]))
    s.flush()
    before = s.version()
    s.compact()
    assert s.version() - before == 3 and [r["level"] for r in s.runs()] == [3] * 20
    s.put(rows(one, [(bytes([k]), b"2") for k in range(1, 40, 3)]))
    s.flush()
    s.compact()
    assert s.version() - before == 8 and s.triggered() == []
    assert {bytes(r["key"])[0]: bytes(r["value"]) for r in s.live().collect()} == {k: b"2" if k % 3 == 1 else b"1" for k in range(40)}


def test_compaction_takes_no_more_than_the_level_has_too_much(one, tmp_path):
    s = Store.open(one, f"file://{tmp_path}/t", Options(run_entries=2))
    for k in range(6):
        s.put(rows(one, [(bytes([k]), b"")]))
        s.flush()
        s.compact_level(0)
    mine = sorted(s.runs(), key=lambda r: (r["created_on"], r["run_id"]))
    s.compact_level(1, sum(r["bytes"] for r in mine[3:]))
    assert [r["run_id"] for r in mine[:4]] == sorted((r["run_id"] for r in s.runs() if r["level"] == 2), key=[r["run_id"] for r in mine].index)
    s.compact_level(1)
    assert sum(r["level"] == 2 for r in s.runs()) == 5


@pytest.mark.parametrize("deep", [False, True])
def test_stretches_that_merge_leave_runs_between_alone(one, tmp_path, deep):
    """Runs merged in one step do not reach over a run between them that none of them meets; each keeps its
    tombstones only where a lower level may have their keys."""
    s = Store.open(one, f"file://{tmp_path}/b", Options(run_entries=2))

    def stored(pairs=(), gone=()):
        if pairs:
            s.put(rows(one, [(k.encode(), v) for k, v in pairs]))
        if gone:
            s.delete(rows(one, [(k.encode(), b"") for k in gone]))
        s.flush()
        s.compact_level(0)

    if deep:
        stored([("y", b"0")])
        s.compact_level(1)
        s.compact_level(2)
    stored([(k, b"1") for k in "abmnyz"])
    s.compact_level(1, 0)
    between = next(r for r in s.runs() if bytes.fromhex(r["first"]) == b"m")
    stored([("a", b"2")], ["b"])
    stored([("z", b"2")], ["y"])
    version = s.version()
    s.compact_level(1, 0)
    assert s.version() == version + 1
    low = sorted((r for r in s.runs() if r["level"] == 2), key=lambda r: r["first"])
    assert between["run_id"] in {r["run_id"] for r in low} and not [r for r in s.runs() if r["level"] == 1]
    assert [(bytes.fromhex(r["first"]), bytes.fromhex(r["last"])) for r in low] == [(b"a", b"a"), (b"m", b"n"), (b"y" if deep else b"z", b"z")]
    s.vacuum()
    assert {bytes(r["key"]): bytes(r["value"]) for r in s.live().collect()} == {b"a": b"2", b"m": b"1", b"n": b"1", b"z": b"2"}


@pytest.mark.parametrize("seed", [1, 2])
def test_model_of_four_levels(one, tmp_path, seed):
    """Random steps of every kind against a dictionary, the store reopened now and then."""
    r, model = random.Random(seed), {}
    path, options = f"file://{tmp_path}/m", Options(memtable_keys=25, run_entries=6, level0_bytes=1, level_ratio=2, checkpoint_every=5)
    s, levels = Store.open(one, path, options), set()
    key = lambda: bytes([r.randrange(40)])
    for step in range(45):
        what = r.choice(["put", "update", "delete", "delete", "flush", "level", "level", "level", "compact", "reopen", "close", "vacuum"])
        if what in ("put", "update"):
            pairs = [(key(), bytes([step, i])) for i in range(r.randint(1, 9))]
            getattr(s, what)(rows(one, pairs))
            model.update(pairs)
        elif what == "delete":
            keys = [key() for _ in range(r.randint(1, 6))]
            s.delete(rows(one, [(k, b"") for k in keys]))
            for k in keys:
                model.pop(k, None)
        elif what == "level":
            s.compact_level(r.randrange(3))
        elif what == "reopen":
            s = Store.open(one, path, options)
        elif what == "close":
            s.close()
            with pytest.raises(ValueError, match="closed"):
                s.put(rows(one, [(b"x", b"")]))
            assert not [x for x in s.runs() if x["level"] == STAGED]
            s = Store.open(one, path, options)
        else:
            getattr(s, what)()
        levels |= {x["level"] for x in s.runs()}
        if step % 6 == 5:
            assert {bytes(x["key"]): bytes(x["value"]) for x in s.live().collect()} == model, step
            asked = [key() for _ in range(5)]
            got = {bytes(x["key"]): (x["status"], x["value"] and bytes(x["value"])) for x in s.multi_get(rows(one, [(k, b"") for k in asked])).collect()}
            assert got == {k: ("OK", model[k]) if k in model else ("NOT_FOUND", None) for k in asked}
    for level in (1, 2, 3):
        mine = sorted((x["first"], x["last"]) for x in s.runs() if x["level"] == level)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
    assert {1, 2, 3} <= levels


def test_memtable_flushes_by_itself(spark, tmp_path):
    s = Store.open(spark, f"file://{tmp_path}/a", Options(memtable_keys=5))
    told = []
    s.flush_listeners.append(told.append)
    s.put(rows(spark, [(bytes([k]), b"") for k in (1, 2, 3, 1, 2)]))
    assert s.log_bytes() > 0 and s.staged_keys() == 3 and not told
    s.put(rows(spark, [(bytes([k]), b"") for k in (3, 4, 5)]))
    assert s.log_bytes() == 0 and sum(r["entries"] for r in told[0]) == 5 and {r["level"] for r in s.runs()} == {0}
    assert s.flush() == []


def test_checkpoints_stand_for_older_versions(spark, tmp_path):
    path, options = f"file://{tmp_path}/c", Options(checkpoint_every=4)
    s, late = Store.open(spark, path, options), Store.open(spark, path, options)
    s.apply(rows(spark, [(b"k", b"0")]), "b:0")
    assert late.get(b"k") == b"0"
    for k in range(1, 8):
        s.put(rows(spark, [(b"k", bytes([k]))]))
        s.flush()
    s.vacuum()
    left = files.names(spark, f"{path}/manifest")
    assert len(left) < 5 and len(files.names(spark, f"{path}/checkpoints")) == 1
    for again in (Store.open(spark, path, options), late):
        assert again.version() == s.version() and again.get(b"k") == bytes([7])
        again.apply(rows(spark, [(b"k", b"9")]), "b:0")
        assert again.version() == s.version()


def test_replies_and_refused_batches(spark, tmp_path, caplog):
    s = Store.open(spark, f"file://{tmp_path}/w")
    asked = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"), 0), (None, bytearray(b"2"), 1), (bytearray(b"b"), bytearray(b"3"), -1), (bytearray(b"c"), None, BATCH)], "key binary, value binary, ordinal long")
    with caplog.at_level(logging.INFO, "tidelog.requests"):
        assert [r["status"] for r in s.write(asked).collect()] == ["OK", *["INVALID_ARGUMENT"] * 3]
    assert any(r.message.startswith("write ok") for r in caplog.records)
    assert [bytes(r["key"]) for r in s.live().collect()] == [b"a"]
    before = s.version()
    for bad, why in ((asked.where("key is null"), "null key"), (asked.where("key is not null"), "ordinal"), (asked.where("ordinal = 0").withColumn("op", F.lit("UPSERT")), "op is neither")):
        with pytest.raises(LogApplyError, match=why):
            s.put(bad)
    assert s.version() == before and s.get(b"a") == b"1"


def test_deadline_cancels(spark):
    with pytest.raises(DeadlineExceeded), deadline(spark, 1.0):
        spark.range(10**13).selectExpr("sum(id * 3 % 7)").collect()
    with deadline(spark, 60):
        assert spark.range(5).count() == 5
    assert spark.range(5).count() == 5


def scanned(df):
    """Rows that the file scan of a collected table gave."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_filters_in_run_files_prune(spark, tmp_path):
    """A key between a run's bounds that it does not have: the file's filter skips it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        entries = spark.range(0, 200_000, 2).select(F.encode(F.sha2(F.col("id").cast("string"), 256), "UTF-8").alias("key"), F.col("id").alias("seq"), F.lit("INSERT").alias("op"), F.lit(bytearray(b"v")).alias("value"))
        made = files.write_runs(entries, f"file://{tmp_path}/runs", 1, 1_000_000, 0.01)
        there, absent = (bytearray(spark.sql(f"select sha2('{k}', 256) s").first()["s"].encode()) for k in (4, 5))
        assert made[0]["first"] < absent.hex().upper() < made[0]["last"]
        read = lambda on, key: spark.read.schema(ENTRY).option("parquet.filter.bloom.enabled", on).option("parquet.filter.dictionary.enabled", "false").option("parquet.filter.columnindex.enabled", "false").parquet(made[0]["path"]).where(F.col("key") == F.lit(key))
        assert scanned(read("true", absent)) == 0 < scanned(read("false", absent))
        assert scanned(read("true", there)) > 0 and read("true", there).count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_filter_needs_bits_and_has_whole_words(spark):
    keys = spark.createDataFrame([(bytearray([k]),) for k in (50, 70, 90)], "key binary")
    for bits in (0, -5):
        with pytest.raises(ValueError, match="bits"):
            bloom.build(keys, bits)
    got = {r["word"]: r["value"] for r in bloom.words(bloom.build(keys, 65), 65).collect()}
    assert set(got) == {0, 1} and sum(bin(v % (1 << 64)).count("1") for v in got.values()) == bloom.build(keys, 65).count()


def test_log_batches_go_by_place(spark):
    log = spark.createDataFrame([(k * 3, "x") for k in range(10)], "seq long, op string")
    assert sorted(map(tuple, runs.log_batches(log, 4).collect())) == [(0, 4, True), (1, 4, True), (2, 2, False)]
    assert runs.log_batches(log.where("false"), 4).count() == 0


@pytest.mark.parametrize("stretches", [1, 5, 256])
def test_ranges_meet_as_by_brute_force(spark, monkeypatch, stretches):
    monkeypatch.setattr(runs, "STRETCHES", stretches)
    r = random.Random(stretches)
    ranges = lambda n: [(k, *sorted((bytes([r.randrange(60)]), bytes([r.randrange(60), r.randrange(3)])))) for k in range(n)]
    for a, b in ((ranges(40), ranges(30)), (ranges(5), []), ([], ranges(5)), ([(0, b"a", b"a")], [(0, b"a", b"z")])):
        table = lambda x: spark.createDataFrame([(k, bytearray(f), bytearray(t)) for k, f, t in x], "run_id long, first binary, last binary")
        got = sorted(map(tuple, runs.overlapping(table(a), table(b)).collect()))
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])
        keys = [bytes([k]) for k in range(60)]
        found = runs.locate(table(b), spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")).collect()
        assert sorted((bytes(x["key"]), x["run_id"]) for x in found) == sorted((k, y[0]) for k in keys for y in b if y[1] <= k <= y[2])


def test_streams_over_several_batches(spark, tmp_path):
    schema = "key long, seq long, op string, value double"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    every = []
    for k in range(3):
        part = [(1, 10 - k, "INSERT", float(k)), (2, k, "DELETE" if k == 2 else "INSERT", None), (3 + k, 1, "INSERT", 1.0), (1, 10 - k, "INSERT", float(k))]
        every += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        latest_view(stream(), f"file://{tmp_path}/views", f"{tmp_path}/c1").awaitTermination()
        append_changes(keyed_changes(stream()), f"{tmp_path}/changes", f"{tmp_path}/c2").awaitTermination()
    want = sorted(map(tuple, resolve.latest(spark.createDataFrame(every, schema)).collect()))
    assert sorted(map(tuple, newest_view(spark, f"file://{tmp_path}/views").collect())) == want
    changes = spark.read.parquet(f"{tmp_path}/changes").collect()
    assert sorted((r["key"], r["seq"]) for r in changes) == [(1, 10), (2, 0), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1)]
    assert newest_view(spark, f"file://{tmp_path}/none") is None


@pytest.mark.parametrize("name", ["store_lifecycle", "store_compaction", "stream_view", "stream_state", "run_split", "wal_batches", "compact_l0", "compact_lower"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    for table in ("events", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
