"""Bloom filters as tables of set bits. Run files carry Parquet's own filter; these are for asking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import bloom_positions


def build(keys: DataFrame, bits: int, *run: str) -> DataFrame:
    """Set bits of the filter of each run."""
    return keys.select(*run, F.explode(bloom_positions(F.col("key"), bits)).alias("bit")).distinct()


def probe(filters: DataFrame, keys: DataFrame, bits: int) -> DataFrame:
    """Keys and whether a filter may hold them: both bits must be set. Never a false no."""
    asked = keys.select("key").distinct().withColumn("at", bloom_positions(F.col("key"), bits))
    each = asked.select("key", F.explode(F.array_distinct("at")).alias("bit"))
    hit = each.join(filters.select("bit", F.lit(1).alias("set")), "bit", "left")
    return hit.groupBy("key").agg((F.count("*") == F.count("set")).alias("may_hold"))


def words(filters: DataFrame, bits: int) -> DataFrame:
    """A filter as all its 64-bit words, as many as hold its bits: word, value (as a signed number)."""
    every = filters.sparkSession.range(-(-bits // 64)).withColumnRenamed("id", "word")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    held = filters.select(F.floor(F.col("bit") / 64).alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("value"))
    return every.join(held, "word", "left").select("word", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
