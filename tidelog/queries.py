"""The engine's queries over the driver's tables, with DuckDB SQL for each.

``events`` is read as a change log: key user_id, seq event_id, an 'error' event a tombstone, a run for
every 1000 events. ``orders`` gives runs with key ranges that are worth pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import bloom_positions
from tidelog.operators import bloom, resolve, runs
from tidelog.plans import manifest
from tidelog.schema import Options
from tidelog.sources import files
from tidelog.store import Store
from tidelog.streaming.ingest import append_changes, ingest, keyed_changes, latest_view, newest_view

BITS = 1000
#: Keys from the start of a run of orders to that of the next, and to its own end.
STRIDE, REACH = 1500, 2200


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("INSERT")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value")


def _event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).withColumn("run_id", F.floor(F.col("seq") / 1000))


def _order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order in each run that covers its key: run i has the keys from 1500 * i to 1500 * i + 2200, so
    neighbours share 701 keys, of which the later run has the newer version."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    i = F.floor(F.col("key") / STRIDE)
    covers = F.when((i > 0) & (F.col("key") <= STRIDE * (i - 1) + REACH), F.array(i - 1, i)).otherwise(F.array(i))
    return o.withColumn("run_id", F.explode(covers)).select("run_id", "key", F.col("run_id").alias("seq"), F.lit("INSERT").alias("op"), "value")


def _order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staggered runs of all orders; their number grows with the largest key."""
    return runs.bounds(_order_entries(spark, sf_dir), "run_id").withColumn("bytes", F.col("entries") * 40)


def kv_live(spark, sf_dir):
    return resolve.live(_log(spark, sf_dir))


def kv_tombstones(spark, sf_dir):
    return resolve.tombstones(_log(spark, sf_dir))


def kv_get(spark, sf_dir):
    return resolve.get(_log(spark, sf_dir), 7)


def kv_multi_get(spark, sf_dir):
    asked = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return resolve.multi_get(_log(spark, sf_dir), asked)


def kv_as_of(spark, sf_dir):
    return resolve.as_of(_log(spark, sf_dir), 500)


def kv_range_scan(spark, sf_dir):
    return resolve.range_scan(_log(spark, sf_dir), 10, 60)


def kv_ordered_scan(spark, sf_dir):
    return resolve.ordered(_log(spark, sf_dir))


def kv_puts(spark, sf_dir):
    log = resolve.put(_log(spark, sf_dir))
    return log.groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


def kv_deletes(spark, sf_dir):
    """Deleting every key after the log leaves nothing alive."""
    log = _log(spark, sf_dir)
    gone = resolve.delete(log.groupBy("key").agg((F.max("seq") + 1).alias("seq"))).withColumn("value", F.col("value").cast("double"))
    return resolve.latest(log.unionByName(gone)).groupBy("op").agg(F.count("*").alias("n"), F.sum("seq").alias("sum_seq"))


def memtable_size(spark, sf_dir):
    return resolve.size(_log(spark, sf_dir))


def flush_trigger(spark, sf_dir):
    """Batches of 64 log entries, their distinct keys, and whether 40 keys make them flush."""
    batch = F.floor(F.col("seq") / 64).alias("batch")
    return _log(spark, sf_dir).groupBy(batch).agg(F.countDistinct("key").alias("n_keys")).withColumn("flushes", F.col("n_keys") >= 40)


def flush_runs(spark, sf_dir):
    versions = _event_runs(spark, sf_dir)
    newest = versions.groupBy("run_id", "key").agg(F.max(F.struct("seq", "op", "value")).alias("v"))
    return runs.bounds(newest, "run_id")


def wal_batches(spark, sf_dir):
    return runs.log_batches(_log(spark, sf_dir), 64)


def wal_replay(spark, sf_dir):
    return resolve.latest(_log(spark, sf_dir))


def run_merge(spark, sf_dir):
    """Every run of the log, however many there are."""
    return runs.merge(_event_runs(spark, sf_dir).drop("run_id"))


def run_split(spark, sf_dir):
    entries = resolve.latest(_log(spark, sf_dir))
    return runs.bounds(runs.split(entries, 20), "run_no")


def run_overlaps(spark, sf_dir):
    r = _order_runs(spark, sf_dir)
    return runs.overlapping(r, r).where("a < b")


def run_oldest(spark, sf_dir):
    e = _event_runs(spark, sf_dir).groupBy("run_id").agg(F.min("seq").alias("created_on"))
    return runs.oldest(e)


def _manifest_log(spark, sf_dir):
    """Events as manifest entries: users are runs, their remainder by 4 the level."""
    op = F.when(F.col("event_type") == "error", "REMOVE").when((F.col("event_type") == "signup") & (F.col("event_id") % 97 == 0), "CLEAR").otherwise("ADD")
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("at"), op.alias("op"), (F.col("user_id") % 4).cast("int").alias("level"), F.col("user_id").alias("run_id"), (F.col("event_id") + 1).alias("bytes"))


def manifest_replay(spark, sf_dir):
    return manifest.replay(_manifest_log(spark, sf_dir))


def level_sizes(spark, sf_dir):
    return manifest.level_sizes(manifest.replay(_manifest_log(spark, sf_dir)))


def level_trigger(spark, sf_dir):
    return manifest.triggered(manifest.replay(_manifest_log(spark, sf_dir)), Options(level0_bytes=50_000))


def level_locate(spark, sf_dir):
    """The runs whose bounds hold each order key, of all orders."""
    keys = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return runs.locate(_order_runs(spark, sf_dir), keys, STRIDE).select("key", "run_id")


def search_precedence(spark, sf_dir):
    e = _event_runs(spark, sf_dir).withColumn("level", F.least(F.floor((F.lit(9) - F.least("run_id", F.lit(9))) / 3), F.lit(3)).cast("int"))
    return manifest.search_order(e)


def search_first_hit(spark, sf_dir):
    """The last three runs of the log are level 0; what lies below is merged into one level for odd keys and
    another for even ones."""
    e = _event_runs(spark, sf_dir)
    top = (e.agg(F.max("run_id")).first()[0] or 0) - 2
    below = F.when(F.col("key") % 2 == 1, 1).otherwise(2)
    placed = e.select("key", "seq", F.when(F.col("run_id") >= top, 0).otherwise(below).alias("level"))
    lower = placed.where("level > 0").groupBy("key", "level").agg(F.max("seq").alias("seq"))
    return manifest.first_hit(placed.where("level = 0").unionByName(lower))


def compact_l0(spark, sf_dir):
    """All runs merged into runs of 30 keys of the bottom level: tombstones go."""
    merged = runs.merge(_event_runs(spark, sf_dir).drop("run_id")).where("op <> 'DELETE'")
    return runs.bounds(runs.split(merged, 30), "run_no")


def compact_lower(spark, sf_dir):
    """The oldest staggered run merges with those it overlaps, cut into runs of 1000 keys; the others stay."""
    entries = _order_entries(spark, sf_dir)
    r = _order_runs(spark, sf_dir).withColumn("created_on", F.col("first"))
    first = runs.oldest(r).select("run_id")
    upper, lower = r.join(first, "run_id", "left_semi"), r.join(first, "run_id", "left_anti")
    met = runs.overlapping(upper, lower).select(F.col("b").alias("run_id"))
    taken = first.unionByName(met)
    merged = runs.merge(entries.join(taken, "run_id", "left_semi").drop("run_id"))
    return runs.bounds(runs.split(merged, 1000), "run_no")


def trivial_move(spark, sf_dir):
    """Every fourth run makes up the lower level, the others the upper one. Those of the upper level that no
    run of the lower one overlaps may move down as they are."""
    r = _order_runs(spark, sf_dir)
    lower = F.col("run_id") % 4 == 0
    upper, lower = r.where(~lower), r.where(lower)
    return upper.join(runs.overlapping(upper, lower).select(F.col("a").alias("run_id")), "run_id", "left_anti").select("run_id", (F.lit(1)).alias("level"))


def _text_keys(spark, sf_dir):
    return _read(spark, sf_dir, "nation").select(F.encode("n_name", "UTF-8").alias("key"))


def bloom_bits(spark, sf_dir):
    return bloom.build(_text_keys(spark, sf_dir), BITS)


def bloom_probe(spark, sf_dir):
    asked = _read(spark, sf_dir, "supplier").select(F.encode("s_name", "UTF-8").alias("key")).unionByName(_text_keys(spark, sf_dir))
    return bloom.probe(bloom.build(_text_keys(spark, sf_dir), BITS), asked, BITS).select(F.decode("key", "UTF-8").alias("key"), "may_hold")


def bloom_positions_of(spark, sf_dir):
    at = bloom_positions(F.encode("r_name", "UTF-8"), BITS)
    return _read(spark, sf_dir, "region").select("r_name", F.get(at, F.lit(0)).alias("p1"), F.get(at, F.lit(1)).alias("p2"))


def _as_entries(log: DataFrame) -> DataFrame:
    return log.select(F.encode(F.lpad(F.col("key").cast("string"), 12, "0"), "UTF-8").alias("key"), "op", F.encode(F.col("value").cast("decimal(20,4)").cast("string"), "UTF-8").alias("value"), F.col("seq").alias("ordinal"))


def _as_told(live: DataFrame) -> DataFrame:
    return live.select(F.decode("key", "UTF-8").cast("long").alias("key"), F.round(F.decode("value", "UTF-8").cast("double"), 4).alias("value"))


def bloom_words(spark, sf_dir):
    return bloom.words(bloom.build(_text_keys(spark, sf_dir), BITS), BITS)


def store_lifecycle(spark, sf_dir):
    """Batches into a store, flushed and compacted so that versions and tombstones lie on three levels and in a
    staged batch, and read back live."""
    store = Store.open(spark, files.scratch(spark), Options(memtable_keys=1 << 40, run_entries=100_000, level0_bytes=1))
    log = _log(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0] or 0
    for k in range(4):
        part = log.where((F.col("seq") > last * k // 4 - (k == 0)) & (F.col("seq") <= last * (k + 1) // 4))
        store.apply(_as_entries(part), f"load:{k}")
        if k < 3:
            store.flush()
        # Of the first three, one goes to the third level and one to the second.
        for level in range(2 - k):
            store.compact_level(level)
    return _as_told(store.live())


def store_compaction(spark, sf_dir):
    """The log into a store by eight batches, each flushed, and compacted until no level is triggered."""
    store = Store.open(spark, files.scratch(spark), Options(memtable_keys=1, run_entries=1000, level0_bytes=4000, level_ratio=2))
    log = _log(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0] or 0
    for k in range(8):
        store.apply(_as_entries(log.where((F.col("seq") > last * k // 8 - (k == 0)) & (F.col("seq") <= last * (k + 1) // 8))), f"load:{k}")
        if k % 3 == 2:
            store.compact()
    store.compact()
    store.close()
    return _as_told(store.live())


def stream_latest(spark, sf_dir):
    """The change log as a stream into a store, each micro-batch one idempotent batch."""
    folder = files.scratch(spark)
    store = Store.open(spark, f"{folder}/store")
    ingest(_as_entries(_event_stream(spark, sf_dir)), store, f"{folder}/checkpoint").awaitTermination()
    return _as_told(store.live())


def _event_stream(spark, sf_dir):
    source = spark.readStream.schema(_read(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("INSERT")
    return source.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value")


def stream_view(spark, sf_dir):
    """The newest version of each key of the log as a stream, as the last micro-batch left it."""
    folder = files.scratch(spark)
    latest_view(_event_stream(spark, sf_dir), f"{folder}/views", f"{folder}/checkpoint").awaitTermination()
    view = newest_view(spark, f"{folder}/views")
    return (resolve.latest(_log(spark, sf_dir).where("false")) if view is None else view).select("key", "seq", "op", "value")


def stream_state(spark, sf_dir):
    """The newest of what a state for each key let through."""
    folder = files.scratch(spark)
    append_changes(keyed_changes(_event_stream(spark, sf_dir)), f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return resolve.live(spark.read.schema("key long, seq long, op string, value double").parquet(f"{folder}/changes"))


QUERIES = {f.__name__: f for f in (
    kv_live, kv_tombstones, kv_get, kv_multi_get, kv_as_of, kv_range_scan, kv_ordered_scan, kv_puts, kv_deletes, memtable_size, flush_trigger, flush_runs,
    wal_batches, wal_replay, run_merge, run_split, run_overlaps, run_oldest, manifest_replay, level_sizes, level_trigger, level_locate, search_precedence, search_first_hit,
    compact_l0, compact_lower, trivial_move, bloom_bits, bloom_words, bloom_probe, bloom_positions_of, store_lifecycle, store_compaction, stream_latest,
    stream_view, stream_state,
)}

_LOG = "log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INSERT' END AS op, value, event_id // 1000 AS run_id FROM events)"
_LAST = "last AS (SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) WHERE r = 1)"
_RUNS = "runs AS (SELECT i AS run_id, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS entries, count(*) * 40 AS bytes FROM orders, range(0, (SELECT max(o_orderkey) // 1500 + 1 FROM orders)) AS r(i) WHERE o_orderkey BETWEEN 1500 * i AND 1500 * i + 2200 GROUP BY 1)"
_MANIFEST = """m AS (SELECT event_id AS "at", CASE WHEN event_type = 'error' THEN 'REMOVE' WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'CLEAR' ELSE 'ADD' END AS op,
  (user_id % 4)::INT AS level, user_id AS run_id, event_id + 1 AS bytes FROM events),
c AS (SELECT level, max("at") AS cleared FROM m WHERE op = 'CLEAR' GROUP BY 1),
present AS (SELECT level, run_id, "at", bytes FROM (SELECT *, row_number() OVER (PARTITION BY level, run_id ORDER BY "at" DESC) AS r FROM m WHERE op <> 'CLEAR') LEFT JOIN c USING (level) WHERE r = 1 AND op = 'ADD' AND (cleared IS NULL OR "at" > cleared))"""
_FNV = "(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({x}) + 1), lambda i: ascii(substring({x}, i, 1))::HUGEINT)), lambda h, b: (((h * 1099511628211) % 18446744073709551616) // 256) * 256 + xor(((h * 1099511628211) % 256)::BIGINT, b::BIGINT)::HUGEINT))"
_BLOOM = f"h AS (SELECT n_name, {_FNV.format(x='n_name')} AS h FROM nation), bits AS (SELECT DISTINCT unnest([h % 1000, (h // 4294967296) % 1000])::BIGINT AS bit FROM h)"
_LIVE = f"WITH {_LOG}, {_LAST} SELECT key, round(value, 4) AS value FROM last WHERE op = 'INSERT'"

ORACLE = {
    "kv_live": f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE op = 'INSERT'",
    "kv_tombstones": f"WITH {_LOG}, {_LAST} SELECT key, seq FROM last WHERE op = 'DELETE'",
    "kv_get": f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE op = 'INSERT' AND key = 7",
    "kv_multi_get": f"WITH {_LOG}, {_LAST} SELECT c_custkey AS key, CASE WHEN op = 'INSERT' THEN 'OK' ELSE 'NOT_FOUND' END AS status, CASE WHEN op = 'INSERT' THEN value END AS value FROM customer LEFT JOIN last ON key = c_custkey",
    "kv_as_of": f"WITH {_LOG.replace('FROM events', 'FROM events WHERE event_id <= 500')}, {_LAST} SELECT key, seq, value FROM last WHERE op = 'INSERT'",
    "kv_range_scan": f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE op = 'INSERT' AND key BETWEEN 10 AND 60",
    "kv_ordered_scan": f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE op = 'INSERT' ORDER BY key",
    "kv_puts": f"WITH {_LOG} SELECT 'INSERT' AS op, count(*) AS n, count(DISTINCT key) AS n_keys FROM log",
    "kv_deletes": f"WITH {_LOG}, g AS (SELECT key, max(seq) + 1 AS seq FROM log GROUP BY 1) SELECT 'DELETE' AS op, count(*) AS n, sum(seq)::BIGINT AS sum_seq FROM g",
    "memtable_size": f"WITH {_LOG} SELECT count(DISTINCT key) AS n_keys FROM log",
    "flush_trigger": f"WITH {_LOG} SELECT seq // 64 AS batch, count(DISTINCT key) AS n_keys, count(DISTINCT key) >= 40 AS flushes FROM log GROUP BY 1",
    "flush_runs": f"WITH {_LOG} SELECT run_id, min(key) AS first, max(key) AS last, count(DISTINCT key) AS entries FROM log GROUP BY 1",
    "wal_batches": f"WITH {_LOG}, n AS (SELECT (row_number() OVER (ORDER BY seq) - 1) // 64 AS batch FROM log) SELECT batch, count(*) AS entries, count(*) = 64 AS \"full\" FROM n GROUP BY 1",
    "wal_replay": f"WITH {_LOG}, {_LAST} SELECT * FROM last",
    "run_merge": f"WITH {_LOG}, {_LAST} SELECT * FROM last",
    "run_split": f"WITH {_LOG}, {_LAST}, n AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 20 AS run_no FROM last) SELECT run_no, min(key) AS first, max(key) AS last, count(*) AS entries FROM n GROUP BY 1",
    "run_overlaps": f"WITH {_RUNS} SELECT x.run_id AS a, y.run_id AS b FROM runs x JOIN runs y ON x.run_id < y.run_id AND x.first <= y.last AND y.first <= x.last",
    "run_oldest": f"WITH {_LOG} SELECT arg_min(run_id, seq) AS run_id, min(seq) AS created_on FROM log",
    "manifest_replay": f"WITH {_MANIFEST} SELECT level, run_id, \"at\", bytes FROM present",
    "level_sizes": f"WITH {_MANIFEST} SELECT level, sum(bytes)::BIGINT AS bytes, count(*) AS runs FROM present GROUP BY 1",
    "level_trigger": f"WITH {_MANIFEST} SELECT level, sum(bytes)::BIGINT AS bytes, count(*) AS runs, sum(bytes) >= 50000 * 10 ** level AS over FROM present GROUP BY 1",
    "level_locate": f"WITH {_RUNS} SELECT o_orderkey AS key, run_id FROM orders JOIN runs ON o_orderkey BETWEEN first AND last",
    "search_precedence": f"WITH {_LOG}, l AS (SELECT *, least((9 - least(run_id, 9)) // 3, 3)::INT AS level, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) SELECT key, level, seq FROM l WHERE r = 1",
    "search_first_hit": f"WITH {_LOG}, t AS (SELECT max(run_id) - 2 AS top FROM log), l AS (SELECT key, seq, CASE WHEN run_id >= top THEN 0 WHEN key % 2 = 1 THEN 1 ELSE 2 END AS level FROM log, t), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, seq DESC) AS r FROM l) SELECT key, level, seq FROM r WHERE r = 1",
    "compact_l0": f"WITH {_LOG}, {_LAST}, n AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 30 AS run_no FROM last WHERE op = 'INSERT') SELECT run_no, min(key) AS first, max(key) AS last, count(*) AS entries FROM n GROUP BY 1",
    "compact_lower": f"WITH {_RUNS}, u AS (SELECT * FROM runs ORDER BY first, run_id LIMIT 1), t AS (SELECT r.* FROM runs r, u WHERE r.first <= u.last AND u.first <= r.last), k AS (SELECT DISTINCT o_orderkey AS key FROM orders JOIN t ON o_orderkey BETWEEN 1500 * run_id AND 1500 * run_id + 2200), n AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 1000 AS run_no FROM k) SELECT run_no, min(key) AS first, max(key) AS last, count(*) AS entries FROM n GROUP BY 1",
    "trivial_move": f"WITH {_RUNS} SELECT x.run_id, 1 AS level FROM runs x WHERE x.run_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM runs y WHERE y.run_id % 4 = 0 AND x.first <= y.last AND y.first <= x.last)",
    "bloom_bits": f"WITH {_BLOOM} SELECT bit FROM bits",
    "bloom_words": f"WITH {_BLOOM}, w AS (SELECT bit // 64 AS word, bit_or(1::UBIGINT << (bit % 64)::UBIGINT) AS v FROM bits GROUP BY 1) SELECT range AS word, CASE WHEN v >= 9223372036854775808 THEN (v::HUGEINT - 18446744073709551616)::BIGINT ELSE coalesce(v, 0)::BIGINT END AS value FROM range(0, 16) LEFT JOIN w ON word = range",
    "bloom_probe": f"WITH {_BLOOM}, q AS (SELECT s_name AS key FROM supplier UNION SELECT n_name FROM nation), p AS (SELECT key, {_FNV.format(x='key')} AS h FROM q) SELECT key, (h % 1000)::BIGINT IN (SELECT bit FROM bits) AND ((h // 4294967296) % 1000)::BIGINT IN (SELECT bit FROM bits) AS may_hold FROM p",
    "bloom_positions_of": f"WITH p AS (SELECT r_name, {_FNV.format(x='r_name')} AS h FROM region) SELECT r_name, (h % 1000)::BIGINT AS p1, ((h // 4294967296) % 1000)::BIGINT AS p2 FROM p",
    "store_lifecycle": _LIVE,
    "store_compaction": _LIVE,
    "stream_latest": _LIVE,
    "stream_view": f"WITH {_LOG}, {_LAST} SELECT * FROM last",
    "stream_state": f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE op = 'INSERT'",
}
