"""A store: change log in, live view out, on any file system that Spark reads and writes.

A write becomes a batch at the staged level, visible and durable once its manifest version is there.
A flush turns the staged batches into sorted level-0 runs, compaction moves runs down. Every change of
the set of runs is one manifest version, created exclusively, after its data is written; replaced files
stay until vacuum(). A store reads each version once; every so many versions one is followed by a
checkpoint of the present runs, from which others start.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import resolve
from tidelog.plans import manifest
from tidelog.plans.requests import LogApplyError, logged
from tidelog.schema import ADD, CLEAR, DELETE, ENTRY, INSERT, REMOVE, STAGED, Options
from tidelog.sources import files

#: Changes of one batch that can be told apart by their ordinal.
BATCH = 1 << 40
#: Entries for which a task of a flush or compaction is worth its while, where a run may have as many.
TASK = 100_000


def _no_level(run: dict) -> dict:
    return {k: v for k, v in run.items() if k != "level"}


def _folder(run: dict) -> str:
    """The folder of a run's file: that of all that were written together."""
    return run["path"].rsplit("/runs/", 1)[1].split("/")[0]


def _entries_of(runs: Iterable[dict]) -> int:
    return sum(r["entries"] for r in runs)


def _stretches(runs: Iterable[dict]) -> list[list[dict]]:
    """Runs in groups whose key ranges are linked by meeting, in the order of keys."""
    out, last = [], None
    for r in sorted(runs, key=lambda r: r["first"]):
        if last is None or r["first"] > last:
            out.append([])
        out[-1].append(r)
        last = r["last"] if last is None else max(last, r["last"])
    return out


def _meets(runs: list[dict], first: str, last: str) -> bool:
    """Whether one of disjoint runs, in the order of keys, meets a range."""
    at = bisect_right(runs, last, key=lambda r: r["first"])
    return at > 0 and runs[at - 1]["last"] >= first


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        if not path:
            raise ValueError("a store needs a path")
        self.spark, self.path, self.options, self.closed = spark, path.rstrip("/"), options or Options(), False
        self._state = manifest.State()
        #: Called with the new level-0 runs of every flush, after it is committed.
        self.flush_listeners: list[Callable[[list[dict]], None]] = []

    @staticmethod
    def open(spark: SparkSession, path: str, options: Options | None = None) -> Store:
        return Store(spark, path, options)

    @logged
    def close(self) -> None:
        """Flush what is staged; the store takes no more writes."""
        self.flush()
        self.closed = True

    # --- runs -------------------------------------------------------------------------------------

    @property
    def _manifest(self) -> str:
        return f"{self.path}/manifest"

    @property
    def _checkpoints(self) -> str:
        return f"{self.path}/checkpoints"

    def state(self) -> manifest.State:
        """The state at the latest version; only versions not seen before are read."""
        there = [int(n.split(".")[0]) for n in files.names(self.spark, self._manifest)]
        if self._state.version + 1 not in there and (there and there[-1] > self._state.version or self._state.version == 0):
            # A first look, or vacuum() took versions that were not read: start from the checkpoint.
            self._state = manifest.State()
            if saved := files.names(self.spark, self._checkpoints):
                self._state.apply(int(saved[-1].split(".")[0]), files.entries(self.spark, f"{self._checkpoints}/{saved[-1]}"))
        for version in there:
            if version > self._state.version:
                self._state.apply(version, files.entries(self.spark, f"{self._manifest}/{version:020d}.json"))
        return self._state

    def version(self) -> int:
        return self.state().version

    def log(self) -> DataFrame:
        """Entries of the versions that vacuum() has left, for asking."""
        at = F.struct("version", "ordinal").alias("at")
        return files.manifest_log(self.spark, self._manifest).select(at, "op", "level", F.col("run.run_id").alias("run_id"), "run")

    def runs(self) -> list[dict]:
        """Present runs: metadata, a few hundred bytes for each run of millions of entries."""
        return list(self.state().runs.values())

    def _commit(self, ops: list[tuple[str, int, dict | None]]) -> None:
        version = self.version() + 1
        files.commit(self.spark, self._manifest, version, ops)
        if version % self.options.checkpoint_every == 0:
            files.commit(self.spark, self._checkpoints, version, self.state().entries())

    def entries(self, runs: Iterable[dict]) -> DataFrame:
        paths = [r["path"] for r in runs]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    # --- writes -----------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, op: str, source: str | None) -> None:
        if self.closed:
            raise ValueError("the store is closed")
        state = self.state()
        if source in state.names:
            return
        base = (state.version + 1) * BATCH
        ordinal = F.col("ordinal").cast("long") if "ordinal" in rows.columns else F.lit(0).cast("long")
        checked = F.when((ordinal >= 0) & (ordinal < BATCH), ordinal).otherwise(F.raise_error(F.lit(f"an ordinal is not from 0 to {BATCH - 1}")))
        value = F.col("value").cast("binary") if op == INSERT else F.lit(b"")
        kind = F.when(F.col("op").isin(INSERT, DELETE), F.col("op")).otherwise(F.raise_error(F.lit("an op is neither INSERT nor DELETE"))) if "op" in rows.columns else F.lit(op)
        key = F.when(F.col("key").isNull(), F.raise_error(F.lit("null key"))).otherwise(F.col("key").cast("binary"))
        batch = rows.select(key.alias("key"), (checked + F.lit(base)).alias("seq"), kind.alias("op"), value.alias("value"))
        try:
            new = self._runs_of(resolve.latest(batch), source)
        except PySparkException as e:
            raise LogApplyError(source, e) from e
        if new or source is not None:
            self._commit([(ADD, STAGED, r) for r in new] or manifest.named(source))
        # The keys of one batch are distinct; those of several need counting.
        most = self.options.memtable_keys
        if _entries_of(new) >= most or _entries_of(self._staged()) >= most and self.staged_keys() >= most:
            self.flush()

    @logged
    def put(self, rows: DataFrame, source: str | None = None) -> None:
        """Insert or replace: key, value and, if a key comes twice, ordinal to order its changes. One bad row
        refuses the batch."""
        self._write(rows, INSERT, source)

    @logged
    def update(self, rows: DataFrame, source: str | None = None) -> None:
        """The same as put: a key need not be there."""
        self._write(rows, INSERT, source)

    @logged
    def write(self, rows: DataFrame, source: str | None = None) -> DataFrame:
        """put() for the rows that can be taken, and a reply for every row: key, status (OK or
        INVALID_ARGUMENT), message."""
        good = F.col("key").isNotNull()
        if "ordinal" in rows.columns:
            good = good & F.coalesce(F.col("ordinal").between(0, BATCH - 1), F.lit(False))
        self._write(rows.where(good), INSERT, source)
        message = F.when(F.col("key").isNull(), "null key").when(~good, f"the ordinal is not from 0 to {BATCH - 1}").otherwise("")
        return rows.select("key", F.when(good, "OK").otherwise("INVALID_ARGUMENT").alias("status"), message.alias("message"))

    @logged
    def delete(self, keys: DataFrame) -> None:
        self._write(keys, DELETE, None)

    @logged
    def apply(self, changes: DataFrame, source: str) -> None:
        """A batch of changes (key, op, value, ordinal) under a name. The manifest keeps every name, so
        a repeated one does nothing, whatever was flushed or compacted since."""
        self._write(changes, INSERT, source)

    def _runs_of(self, entries: DataFrame, source: str | None = None, at_most: int | None = None) -> list[dict]:
        """Write runs; where at most so many entries are known to come, not in more parts than they need."""
        folder = f"{self.path}/runs/{files.uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if at_most is not None:
            parts = max(1, min(parts, -(-at_most // min(self.options.run_entries, TASK))))
        return files.write_runs(entries, folder, parts, self.options.run_entries, self.options.bloom_fpp, source)

    def _staged(self) -> list[dict]:
        return [r for r in self.runs() if r["level"] == STAGED]

    def staged_keys(self) -> int:
        return resolve.size(self.entries(self._staged())).first()["n_keys"]

    def log_bytes(self) -> int:
        """Bytes of the batches that are not flushed yet."""
        return sum(r["bytes"] for r in self._staged())

    @logged
    def flush(self) -> list[dict]:
        """Staged batches become level-0 runs, in one commit; these runs. The files of one batch alone are such
        runs already and just move."""
        staged, new = self._staged(), []
        if staged:
            if len({_folder(r) for r in staged}) == 1:
                new = [_no_level(r) | {"source": None} for r in staged]
            else:
                new = self._runs_of(resolve.latest(self.entries(staged)), at_most=_entries_of(staged))
            self._commit([(CLEAR, STAGED, None), *[(ADD, 0, r) for r in new]])
            for listener in self.flush_listeners:
                listener(new)
        return new

    # --- reads ------------------------------------------------------------------------------------

    def change_log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Entries of the runs whose bounds meet the range: others are never opened."""
        a, b = low.hex().upper() if low is not None else "", high.hex().upper() if high is not None else None
        return self.entries(r for r in self.runs() if r["last"] >= a and (b is None or r["first"] <= b))

    @logged
    def get(self, key: bytes) -> bytes | None:
        row = resolve.get(self.change_log(key, key), bytearray(key)).first()
        return None if row is None else bytes(row["value"])

    @logged
    def multi_get(self, keys: DataFrame) -> DataFrame:
        """key, status, value of each asked key, over the runs that the keys' range meets."""
        ends = keys.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
        if ends["a"] is None:
            return resolve.multi_get(self.entries([]), keys)
        return resolve.multi_get(self.change_log(bytes(ends["a"]), bytes(ends["b"])), keys)

    @logged
    def scan(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        return resolve.range_scan(self.change_log(low, high), None if low is None else bytearray(low), None if high is None else bytearray(high)).orderBy("key")

    @logged
    def live(self) -> DataFrame:
        return resolve.live(self.change_log())

    # --- compaction -------------------------------------------------------------------------------

    def triggered(self) -> list[int]:
        sizes: dict[int, int] = {}
        for r in self.runs():
            sizes[r["level"]] = sizes.get(r["level"], 0) + r["bytes"]
        return [n for n in range(self.options.levels - 1) if sizes.get(n, 0) >= self.options.max_bytes(n)]

    @logged
    def compact(self) -> None:
        """Compact triggered levels from the top until none is left or nothing moves."""
        while levels := self.triggered():
            self.compact_level(levels[0], self.options.max_bytes(levels[0]))

    def compact_level(self, level: int, under: int | None = None) -> None:
        """Level 0: all its runs; below: the oldest run or, to get ``under`` so many bytes, as many of the oldest
        as that takes. They merge with the runs of the next level that they overlap, or just move if there is
        none: all in one step and one commit, however many runs. Levels from 1 on stay disjoint."""
        runs = self.runs()
        mine = sorted((r for r in runs if r["level"] == level), key=lambda r: (r["created_on"], r["run_id"]))
        if not mine or level >= self.options.levels - 1:
            return
        upper, left = [], sum(r["bytes"] for r in mine)
        for r in mine:
            if level > 0 and upper and (under is None or left < under):
                break
            upper.append(r)
            left -= r["bytes"]
        lower = [r for r in runs if r["level"] == level + 1]
        if level == 0:
            first, last = min(r["first"] for r in upper), max(r["last"] for r in upper)
            stretches = [[*upper, *(r for r in lower if r["first"] <= last and first <= r["last"])]]
        else:
            stretches = [s for s in _stretches([*upper, *lower]) if any(r["level"] == level for r in s)]
        moved = [_no_level(s[0]) for s in stretches if level > 0 and len(s) == 1]
        merging = [s for s in stretches if level == 0 or len(s) > 1]
        ops = [(REMOVE, level, r) for r in moved] + [(ADD, level + 1, r) for r in moved]
        if merging:
            gone = [r for s in merging for r in s]
            new = self._runs_of(self._merged(merging, level), at_most=_entries_of(gone))
            ops += [(REMOVE, r["level"], _no_level(r)) for r in gone] + [(ADD, level + 1, r) for r in new]
        self._commit(ops)

    def _merged(self, stretches: list[list[dict]], level: int) -> DataFrame:
        """The newest version of each key of runs of a level and the next, by stretches of keys; where there
        are several, with the number of each."""
        # A tombstone may go once no older copy of its key can lie anywhere else: not below, where the runs
        # that are merged reach, and not in what stays behind on either level (level 0 goes whole, the others
        # are disjoint).
        below = [r for r in self.runs() if r["level"] > level + 1]
        deeper = [sorted((r for r in below if r["level"] == n), key=lambda r: r["first"]) for n in {r["level"] for r in below}]
        keep = [any(_meets(d, min(r["first"] for r in s), max(r["last"] for r in s)) for d in deeper) for s in stretches]
        entries = self.entries(r for s in stretches for r in s)
        if len(stretches) == 1:
            merged = resolve.latest(entries)
            return merged if keep[0] else merged.where(F.col("op") != DELETE)
        # Which stretch an entry is of, its file tells: a key lies in one stretch only, so that goes along in the key.
        place = self.spark.createDataFrame([(r["path"], n, keep[n]) for n, s in enumerate(stretches) for r in s], "path string, stretch int, keep boolean")
        placed = entries.select("*", F.col("_metadata.file_path").alias("path")).join(F.broadcast(place), "path", "left")
        known = F.when(F.col("stretch").isNull(), F.raise_error(F.lit("a run's file has another name than the manifest says"))).otherwise(F.struct("stretch", "keep", "key"))
        merged = resolve.latest(placed.select(known.alias("key"), "seq", "op", "value"))
        return merged.where(F.col("key.keep") | (F.col("op") != DELETE)).select("key.key", "seq", "op", "value", "key.stretch")

    @logged
    def vacuum(self) -> None:
        """Delete run folders that no present run lies in, and what the last checkpoint stands for."""
        kept = {_folder(r) for r in self.runs()}
        for name in files.names(self.spark, f"{self.path}/runs"):
            if name not in kept:
                files.remove(self.spark, f"{self.path}/runs/{name}")
        saved = files.names(self.spark, self._checkpoints)
        for folder in (self._manifest, self._checkpoints) if saved else ():
            for name in files.names(self.spark, folder):
                if name < saved[-1]:
                    files.remove(self.spark, f"{folder}/{name}")
