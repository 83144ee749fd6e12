"""The manifest log: which runs make up each level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.schema import ADD, CLEAR, REMOVE, STAGED, Options


def replay(log: DataFrame) -> DataFrame:
    """Fold a log (at, op, level, run_id, ...) into the present runs.

    The last entry of a (level, run) decides, and a CLEAR drops what its level had before. ``at`` is any
    orderable place in the log.
    """
    cleared = log.where(F.col("op") == CLEAR).groupBy("level").agg(F.max("at").alias("cleared"))
    rest = [c for c in log.columns if c not in ("level", "run_id", "at")]
    last = log.where(F.col("op") != CLEAR).groupBy("level", "run_id").agg(F.max(F.struct("at", *rest)).alias("e"))
    kept = last.join(cleared, "level", "left").where((F.col("e.op") == ADD) & (F.col("cleared").isNull() | (F.col("e.at") > F.col("cleared"))))
    return kept.select("level", "run_id", "e.at", *[f"e.{c}" for c in rest if c != "op"])


def level_sizes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("runs"))


def triggered(runs: DataFrame, options: Options) -> DataFrame:
    """Levels with as many bytes as they may hold or more."""
    most = F.lit(float(options.level0_bytes)) * F.pow(F.lit(float(options.level_ratio)), F.col("level"))
    return level_sizes(runs).withColumn("over", F.col("bytes") >= most)


def search_order(candidates: DataFrame) -> DataFrame:
    """Of each key's versions in any runs (key, level, seq, ...), the level of the newest."""
    return candidates.groupBy("key").agg(F.max(F.struct("seq", (-F.col("level")).alias("up"))).alias("v")).select("key", (-F.col("v.up")).alias("level"), "v.seq")


def first_hit(candidates: DataFrame) -> DataFrame:
    """Of each key's versions in any runs (key, level, seq, ...), that of the first level which has the key, level 0
    before the lower ones; on level 0, where runs overlap, the newest. Lower levels are disjoint, so each has
    one candidate at most."""
    order = F.struct("level", (-F.col("seq")).alias("older"))
    return candidates.groupBy("key").agg(F.min(order).alias("v")).select("key", "v.level", (-F.col("v.older")).alias("seq"))


def named(name: str) -> list[tuple[str, int, dict]]:
    """Entries that leave nothing of a batch but its name."""
    return [(ADD, STAGED, {"run_id": name, "source": name}), (REMOVE, STAGED, {"run_id": name})]


class State:
    """Present runs and the names of all batches, folded entry by entry as versions of the log appear."""

    def __init__(self) -> None:
        self.version = 0
        self.runs: dict[tuple[int, str], dict] = {}
        self.names: set[str] = set()

    def apply(self, version: int, entries: list[dict]) -> None:
        for e in entries:
            level, run = e["level"], e["run"] or {}
            if e["op"] == CLEAR:
                self.runs = {k: r for k, r in self.runs.items() if k[0] != level}
            elif e["op"] == REMOVE:
                self.runs.pop((level, run["run_id"]), None)
            elif e["op"] == ADD:
                self.runs[level, run["run_id"]] = run | {"level": level}
            if run.get("source") is not None and level == STAGED:
                self.names.add(run["source"])
        self.version = version

    def entries(self) -> list[tuple[str, int, dict | None]]:
        """Entries that make this state of an empty one: names first, as batches that are gone."""
        done = [e for n in sorted(self.names) for e in named(n)]
        return done + [(ADD, r["level"], {k: v for k, v in r.items() if k != "level"}) for r in self.runs.values()]
