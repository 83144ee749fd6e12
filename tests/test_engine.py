"""The engine against a dictionary, and its queries against DuckDB."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog import queries
from tidelog.operators import resolve, runs
from tidelog.schema import Options
from tidelog.store import Store
from tidelog.streaming.ingest import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def told(df):
    rows = [tuple(None if pd.isna(v) else (round(float(v), 6) if not isinstance(v, (str, bool)) else v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    assert told(queries.QUERIES[name](spark, DATA).toPandas()) == told(duck.sql(queries.ORACLE[name]).df())


def rows(spark, pairs):
    return spark.createDataFrame([(bytearray(k), bytearray(v), i) for i, (k, v) in enumerate(pairs)], "key binary, value binary, ordinal long")


def test_delete_hides_flushed_value_and_survives_reopen(spark, tmp_path):
    s = Store.open(spark, f"file://{tmp_path}/s", Options.small())
    s.put(rows(spark, [(b"a", b"1"), (b"b", b""), (b"a", b"2")]))
    s.flush()
    s.delete(rows(spark, [(b"a", b"")]))
    assert s.get(b"a") is None and s.get(b"b") == b""  # an empty value is not a tombstone
    again = Store.open(spark, f"file://{tmp_path}/s", Options.small())
    again.flush()
    assert again.get(b"a") is None and again.get(b"z") is None
    got = {bytes(r["key"]): r["status"] for r in again.multi_get(rows(spark, [(b"a", b""), (b"b", b""), (b"b", b"")])).collect()}
    assert got == {b"a": "NOT_FOUND", b"b": "OK"}


def test_model(spark, tmp_path):
    """Random writes, deletes, flushes and compactions against a dictionary; levels stay disjoint."""
    r, model = random.Random(5), {}
    s = Store.open(spark, f"file://{tmp_path}/m", Options(memtable_keys=1 << 30, run_entries=7, level0_bytes=1))
    for step in range(9):
        keys = [bytes([r.randrange(30)]) for _ in range(12)]
        if step % 3 == 2:
            s.delete(rows(spark, [(k, b"") for k in keys]))
            for k in keys:
                model.pop(k, None)
        else:
            pairs = [(k, bytes([step, i])) for i, k in enumerate(keys)]
            s.put(rows(spark, pairs))
            model.update(pairs)
        if step % 2:
            s.flush()
        if step in (3, 7):
            s.compact_level(0)
        if step == 7:
            s.compact_level(1)
    assert {bytes(x["key"]): bytes(x["value"]) for x in s.live().collect()} == model
    for level in (1, 2, 3):
        mine = sorted((x["first"], x["last"]) for x in s.runs() if x["level"] == level)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
    s.vacuum()
    low, high = bytes([5]), bytes([20])
    assert [bytes(x["key"]) for x in s.scan(low, high).collect()] == sorted(k for k in model if low <= k <= high)


def test_null_key_and_empty_path_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        Store.open(spark, "")
    s = Store.open(spark, f"file://{tmp_path}/n")
    with pytest.raises(Exception, match="null key"):
        s.put(spark.createDataFrame([(None, bytearray(b"x"))], "key binary, value binary"))


def test_batch_name_counts_once(spark, tmp_path):
    s = Store.open(spark, f"file://{tmp_path}/i")
    s.apply(rows(spark, [(b"k", b"1")]), "b:1")
    s.put(rows(spark, [(b"k", b"2")]))
    s.flush()
    s.apply(rows(spark, [(b"k", b"1")]), "b:1")
    assert s.get(b"k") == b"2"


def test_stream_restart(spark, tmp_path):
    s = Store.open(spark, f"file://{tmp_path}/t")
    schema = "key string, op string, value string, ordinal long"
    for k in range(2):
        spark.createDataFrame([("x", "INSERT", str(k), k), (f"y{k}", "INSERT", "v", k)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").select(F.col("key").cast("binary"), "op", F.col("value").cast("binary"), "ordinal")
        ingest(stream, s, f"{tmp_path}/cp").awaitTermination()
    assert {bytes(r["key"]): bytes(r["value"]) for r in s.live().collect()} == {b"x": b"1", b"y0": b"v", b"y1": b"v"}


def test_split_and_ties(spark):
    log = spark.createDataFrame([(k, 1, "INSERT", v) for k in (4, 5, 19, 29, 39, 49) for v in ("a", "b")], "key long, seq long, op string, value string")
    got = runs.bounds(runs.split(resolve.latest(log), 2), "run_no").orderBy("run_no").collect()
    assert [(r["first"], r["last"], r["entries"]) for r in got] == [(4, 5, 2), (19, 29, 2), (39, 49, 2)]
    assert {r["value"] for r in resolve.live(log).collect()} == {"b"}
