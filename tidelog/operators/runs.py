"""Sorted runs as DataFrames: bounds, merging, splitting, overlap, the oldest, log batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.resolve import latest
from tidelog.sources import files

#: Stretches of keys by which ranges are joined.
STRETCHES = 256


def bounds(entries: DataFrame, *run: str) -> DataFrame:
    """First and last key and number of entries of each run."""
    return entries.groupBy(*run).agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("entries"))


def merge(*logs: DataFrame) -> DataFrame:
    """One version a key over several runs, the newest; tombstones stay."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return latest(out)


def split(entries: DataFrame, size: int) -> DataFrame:
    """Number entries of distinct keys in key order and cut them into runs of exactly ``size``.

    The table is range-partitioned and sorted once and written with each row's partition and place in it; the
    partitions' counts, one row each, give where their numbers start. No task sees all rows, and they are
    shuffled once.
    """
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{files.scratch(spark)}/ranged"
    # The id has the partition above bit 33 and the row's place in the partition below.
    entries.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("__at", F.monotonically_increasing_id()).write.parquet(folder)
    ranged = spark.read.parquet(folder).withColumn("__p", F.shiftright("__at", 33))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")
    return ranged.join(F.broadcast(starts), "__p").withColumn("run_no", F.floor(place / size).cast("long")).drop("__p", "__at", "__start")


def _stretches(*runs: DataFrame) -> list:
    """Keys that cut the key space into stretches with about as many runs' first keys each: a sample of bounded
    size, chosen by hash."""
    firsts = reduce(DataFrame.union, [r.select("first") for r in runs]).where("first is not null").distinct()
    return sorted(r[0] for r in firsts.orderBy(F.xxhash64("first"), "first").limit(STRETCHES).collect())


def _stretch(key: Column, cuts: list) -> Column:
    """Number of the stretch that a key lies in."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= key)) if cuts else F.lit(0)


def overlapping(upper: DataFrame, lower: DataFrame, on: str = "run_id") -> DataFrame:
    """Pairs of runs whose closed key ranges meet; ranges that contain one another count. Runs are joined by
    stretches of keys that both reach, a pair once, in the first of these."""
    cuts = _stretches(upper, lower)
    reach = F.explode(F.sequence(_stretch(F.col("first"), cuts), _stretch(F.col("last"), cuts))).alias("at")
    a = upper.select(F.col(on).alias("a"), F.col("first").alias("a_first"), F.col("last").alias("a_last"), reach)
    b = lower.select(F.col(on).alias("b"), F.col("first").alias("b_first"), F.col("last").alias("b_last"), reach)
    met = (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
    return a.join(b, "at").where(met & (F.col("at") == _stretch(F.greatest("a_first", "b_first"), cuts))).select("a", "b")


def oldest(runs: DataFrame) -> DataFrame:
    """The run created first, of equals that with the least id."""
    return runs.agg(F.min(F.struct("created_on", "run_id")).alias("r")).select("r.run_id", "r.created_on")


def log_batches(log: DataFrame, size: int) -> DataFrame:
    """Batches of ``size`` entries of a log in the order of seq, whatever numbers are missing, the last one
    possibly smaller: batch, entries, full."""
    numbered = split(log.select(F.col("seq").alias("key")), size)
    return numbered.groupBy(F.col("run_no").alias("batch")).agg(F.count("*").alias("entries")).withColumn("full", F.col("entries") == size)


def locate(runs: DataFrame, keys: DataFrame, width: int | None = None) -> DataFrame:
    """The runs that may hold each key, by their bounds. A key meets only the runs that reach its own stretch
    of keys: with a ``width``, for integer keys, of so many; else between some of the runs' first keys."""
    cuts = _stretches(runs) if width is None else []
    stretch = (lambda c: _stretch(F.col(c), cuts)) if width is None else (lambda c: F.floor(F.col(c) / width))
    inside = (F.col("first") <= F.col("key")) & (F.col("key") <= F.col("last"))
    met = runs.withColumn("__stretch", F.explode(F.sequence(stretch("first"), stretch("last"))))
    return keys.withColumn("__stretch", stretch("key")).join(met, "__stretch").where(inside).drop("__stretch")
