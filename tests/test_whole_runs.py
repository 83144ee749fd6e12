"""Queries over runs take every run and every key, against DuckDB over whole tables."""

import duckdb
import pytest

from tidelog import queries
from tidelog.operators import runs

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_takes_every_run(spark, duck):
    want = duck.sql("SELECT user_id, max(event_id), arg_max(CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INSERT' END, event_id), arg_max(value, event_id) FROM events GROUP BY 1").fetchall()
    got = rows(queries.run_merge(spark, DATA))
    assert got == sorted(want) and max(r[1] for r in got) >= 3000


def order_runs(duck):
    """Run i covers the keys from 1500 * i to 1500 * i + 2200: its id, first key, last key, entries."""
    return duck.sql("""SELECT i, min(o_orderkey), max(o_orderkey), count(*) FROM orders, range(0, (SELECT max(o_orderkey) // 1500 + 1 FROM orders)) r(i)
        WHERE o_orderkey BETWEEN 1500 * i AND 1500 * i + 2200 GROUP BY 1""").fetchall()


def test_every_order_is_in_a_run(spark, duck):
    held = queries._order_entries(spark, DATA)
    assert held.select("key").distinct().count() == duck.sql("SELECT count(DISTINCT o_orderkey) FROM orders").fetchall()[0][0]
    want = order_runs(duck)
    assert rows(queries._order_runs(spark, DATA).select("run_id", "first", "last", "entries")) == sorted(want)


def test_overlaps_of_all_orders(spark, duck):
    want = order_runs(duck)
    assert rows(queries.run_overlaps(spark, DATA)) == sorted((a[0], b[0]) for a in want for b in want if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2])


def test_locate_finds_all_order_keys(spark, duck):
    keys = [k for (k,) in duck.sql("SELECT o_orderkey FROM orders").fetchall()]
    want = order_runs(duck)
    got = rows(queries.level_locate(spark, DATA))
    assert got == sorted((k, i) for k in keys for i, first, last, _ in want if first <= k <= last) and {k for k, _ in got} == set(keys)
    runs_of, asked = queries._order_runs(spark, DATA), spark.range(0, 20000, 37).toDF("key")
    assert rows(runs.locate(runs_of, asked, 400).select("key", "run_id")) == rows(runs.locate(runs_of, asked).select("key", "run_id"))


def test_moved_runs_meet_none_of_the_lower_level(spark, duck):
    every = order_runs(duck)
    upper, lower = [r for r in every if r[0] % 4], [r for r in every if r[0] % 4 == 0]
    free = sorted((i, 1) for i, first, last, _ in upper if not any(first <= y[2] and y[1] <= last for y in lower))
    assert rows(queries.trivial_move(spark, DATA)) == free and 0 < len(free) < len(upper)


def test_lower_compaction_merges_entries(spark, duck):
    every = sorted(order_runs(duck), key=lambda r: (r[1], r[0]))
    taken = [r for r in every if r[1] <= every[0][2] and every[0][1] <= r[2]]
    keys = sorted({k for (k,) in duck.sql("SELECT o_orderkey FROM orders").fetchall() if any(a <= k <= b for _, a, b, _ in taken)})
    assert len(taken) > 1 and len(keys) < sum(r[3] for r in taken)
    want = [(n // 1000, *(lambda c: (c[0], c[-1], len(c)))(keys[n : n + 1000])) for n in range(0, len(keys), 1000)]
    assert rows(queries.compact_lower(spark, DATA).select("run_no", "first", "last", "entries")) == want
