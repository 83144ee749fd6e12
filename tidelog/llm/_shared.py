"""Helpers that the training-data operators share: shared folder, code shipping, Arrow slices."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.files import remove, scratch

#: Text that one vectorised step holds at a time, in bytes; a longer document is a step of its own.
SLICE_BYTES = 1 << 20
#: How tables are stored: partitions are put together even if then not all cores have some, and shuffle files
#: go once the table is there.
STORING = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows of an Arrow batch.
BATCH_ROWS = 2000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so workers can import it, and keep
    the session's Arrow batches small: texts are wide, and workers and executors hold a few batches at a time."""
    sc = spark.sparkContext
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:  # 0 is no bound
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    out = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which goes with the session; a local one only where that is
    unset and the session local (tests)."""
    return scratch(spark)


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors.
    What a shuffle dealt out is put together to files of the advised size, rather than one for each core, and its
    own files are deleted after."""
    folder, conf = shared_folder(df.sparkSession), df.sparkSession.conf
    before = {key: conf.get(key) for key in STORING}
    for key, value in STORING.items():
        conf.set(key, value)
    try:
        df.write.parquet(f"{folder}/{name}")
    finally:
        for key, value in before.items():
            conf.set(key, value)
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._stored_in = folder
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that stored() gave, once what was made of them is stored too."""
    for t in tables:
        if t is not None:
            remove(t.sparkSession, t._stored_in)


_resident: dict[object, object] = {}


def resident(make=None, *args):
    """make(*args), kept by the worker until another one is asked for: a worker holds the tables and
    memories of one operator at a time. Without ``make``, what is kept goes."""
    key = (make, args)
    if key not in _resident:
        _resident.clear()
        pa.default_memory_pool().release_unused()
        if make is None:
            return None
        _resident[key] = make(*args)
    return _resident[key]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem and path of a folder that executors and driver share (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else os.path.abspath(uri))


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about limit, a larger row alone."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def utf8_columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, without copying; a null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def apart(names: list[str]) -> str:
    """A prefix for columns of one's own, that none of the names begins with."""
    tag = "__"
    while any(n.startswith(tag) for n in names):
        tag += "_"
    return tag


def from_lists(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """A record batch of tuples."""
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
