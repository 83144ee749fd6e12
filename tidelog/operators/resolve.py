"""Reading a change log: the newest version of each key wins, and a tombstone hides its key.

A log has columns key, seq, op, value; keys may be of any orderable type. The newest version is the
largest seq; equal seqs of a key are ordered by (op, value), so the result never depends on row order.
All of it is one hash-partitioned aggregation with a partial step before the shuffle, so a hot key
costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import DELETE, INSERT


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included: key, seq, op, value."""
    newest = F.max(F.struct("seq", "op", "value")).alias("v")
    return log.groupBy("key").agg(newest).select("key", "v.seq", "v.op", "v.value")


def live(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == INSERT).drop("op")


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == DELETE).select("key", "seq")


def get(log: DataFrame, key) -> DataFrame:
    """The live version of one key: no row or one. The filter reaches the scan."""
    return live(log.where(F.col("key") == F.lit(key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each distinct asked key: key, status (OK or NOT_FOUND), value."""
    asked = keys.select("key").distinct()
    found = live(log.join(asked, "key", "left_semi")).select("key", "value", F.lit(True).alias("found"))
    status = F.when(F.col("found"), "OK").otherwise("NOT_FOUND")
    return asked.join(found, "key", "left").select("key", status.alias("status"), "value")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live view as it was after the change ``seq``."""
    return live(log.where(F.col("seq") <= seq))


def range_scan(log: DataFrame, low=None, high=None) -> DataFrame:
    """Live keys between low and high, both inclusive; None leaves an end open."""
    where: Column = F.lit(True)
    if low is not None:
        where = where & (F.col("key") >= F.lit(low))
    if high is not None:
        where = where & (F.col("key") <= F.lit(high))
    return live(log.where(where))


def ordered(log: DataFrame) -> DataFrame:
    """Live keys in ascending order."""
    return live(log).orderBy("key")


def size(log: DataFrame) -> DataFrame:
    """Distinct keys, tombstones counted."""
    return log.agg(F.countDistinct("key").alias("n_keys"))


def put(rows: DataFrame) -> DataFrame:
    return rows.select("key", "seq", F.lit(INSERT).alias("op"), "value")


def delete(rows: DataFrame) -> DataFrame:
    return rows.select("key", "seq", F.lit(DELETE).alias("op"), F.lit(None).alias("value"))
