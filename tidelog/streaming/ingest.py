"""Streams: into a store, each micro-batch one named, idempotent change batch; into a view of the newest
versions; and through a state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tidelog.operators.resolve import latest
from tidelog.sources import files
from tidelog.store import Store


def ingest(changes: DataFrame, store: Store, checkpoint: str, name: str = "stream", **trigger) -> StreamingQuery:
    """Write a stream of (key, op, value, ordinal) to a store. A batch that is replayed after a failure
    has the name of its first try, and the store takes a name once."""

    def batch(df: DataFrame, number: int) -> None:
        store.apply(df, f"{name}:{number:012d}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(changes: DataFrame) -> DataFrame:
    """The newest version of each key of a stream, for update or complete mode."""
    return latest(changes)


def latest_view(changes: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the newest version of each key of a stream (key, seq, op, value) as a table: every micro-batch
    writes the whole view anew, as folder/view=<batch>, and a batch that is replayed writes its own again."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/view={number:012d}")

    return latest_stream(changes).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest_view(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that latest_view() wrote last, or None before the first."""
    views = files.names(spark, folder)
    return spark.read.parquet(f"{folder}/{views[-1]}") if views else None


def keyed_changes(changes: DataFrame) -> DataFrame:
    """What a stream (key long, seq long, op string, value double) changes: a row (key, seq, op, value) each
    time a micro-batch has a newer version of a key than its state. The state of a key is one version, so it
    stays small however many changes a key has; versions at or behind it, late or repeated ones, change nothing."""
    fields = "seq long, op string, value double"

    def newer(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        was, best = state.getOption, None
        for part in parts:
            for row in zip(part["seq"].tolist(), part["op"].tolist(), part["value"].tolist(), strict=True):
                rank = (row[0], row[1], row[2] if row[2] is not None and row[2] == row[2] else float("-inf"))
                if best is None or rank > best[0]:
                    best = (rank, row)
        if best is not None and (was is None or best[0] > (was[0], was[1], was[2] if was[2] is not None and was[2] == was[2] else float("-inf"))):
            state.update(best[1])
            yield pd.DataFrame([(key[0], *best[1])], columns=["key", "seq", "op", "value"])

    return changes.groupBy("key").applyInPandasWithState(newer, f"key long, {fields}", fields, "append", GroupStateTimeout.NoTimeout)


def append_changes(changes: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write what keyed_changes() gives as files, each once."""
    return changes.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
