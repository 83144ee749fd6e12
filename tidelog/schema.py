"""Record types of the engine and its options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INSERT, DELETE = "INSERT", "DELETE"
ADD, REMOVE, CLEAR = "ADD", "REMOVE", "CLEAR"
#: Level of batches that are written but not yet flushed into sorted runs.
STAGED = -1

ENTRY = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("value", T.BinaryType()),
])
RUN = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("first", T.StringType()),  # keys as hex: the order is that of the bytes
    T.StructField("last", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("entries", T.LongType()),
    T.StructField("created_on", T.LongType()),  # microseconds
    T.StructField("source", T.StringType()),
])
MANIFEST = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("run", RUN),
])


@dataclass(frozen=True)
class Options:
    """Sizes that steer a store."""

    memtable_keys: int = 20_000_000  # distinct staged keys before a flush
    run_entries: int = 4_000_000  # entries of a run after compaction
    levels: int = 4
    level0_bytes: int = 30_000_000_000
    level_ratio: int = 10  # each level holds so many times the one above
    bloom_fpp: float = 0.01
    checkpoint_every: int = 64  # manifest versions that a reader goes through at most

    def max_bytes(self, level: int) -> int:
        return self.level0_bytes * self.level_ratio**level

    @staticmethod
    def small() -> Options:
        """For tests: flushes and compacts after a few thousand entries."""
        return Options(memtable_keys=1_000, run_entries=1_000, level0_bytes=100_000)
