"""Run files and the manifest's files, through Spark's own file systems."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import MANIFEST


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir; it goes with the session.
    Only a local session, which has one machine, may leave that unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='tidelog')}"
    path = f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a file that must not exist yet: the second of two writers of one version fails."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_runs(entries: DataFrame, folder: str, parts: int, run_entries: int, fpp: float, source: str | None = None) -> list[dict]:
    """Write distinct keys as sorted Parquet files with bloom filters; a description of each file.

    Range partitioning makes the files' key ranges disjoint; bounds and counts are read back from the
    key column alone, at most one row a file. With a column ``stretch``, whose numbers ascend with the keys,
    no file reaches from one stretch into another.
    """
    spark = entries.sparkSession
    stretch = [c for c in entries.columns if c == "stretch"]
    columns = entries.select("key", "seq", "op", "value")
    spread = entries.select(*columns.columns, *stretch).repartitionByRange(parts, "key").sortWithinPartitions(*stretch, "key")
    spread.write.option("maxRecordsPerFile", run_entries).option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", run_entries).option("parquet.bloom.filter.fpp#key", fpp).parquet(folder, partitionBy=stretch or None)
    files = spark.read.schema(columns.schema).parquet(folder).select("key", "_metadata.file_path", "_metadata.file_size")
    rows = files.groupBy("file_path").agg(F.hex(F.min("key")).alias("first"), F.hex(F.max("key")).alias("last"), F.count("*").alias("entries"), F.max("file_size").alias("bytes")).collect()
    now = time.time_ns() // 1000
    return [{"run_id": uuid.uuid4().hex, "path": r["file_path"], "first": r["first"], "last": r["last"], "bytes": r["bytes"], "entries": r["entries"], "created_on": now, "source": source} for r in sorted(rows, key=lambda r: r["first"])]


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifest_log(spark: SparkSession, folder: str) -> DataFrame:
    """All manifest entries with their place in the log; whole files only ever appear."""
    if not names(spark, folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(folder)


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The entries of one manifest version or checkpoint."""
    return [json.loads(line) for line in read_text(spark, path).splitlines()]


def commit(spark: SparkSession, folder: str, version: int, ops: list[tuple[str, int, dict | None]]) -> None:
    """Write one version: all its entries or none."""
    lines = [json.dumps({"version": version, "ordinal": k, "op": op, "level": level, "run": run}) for k, (op, level, run) in enumerate(ops)]
    create_once(spark, f"{folder}/{version:020d}.json", "\n".join(lines) + "\n")
