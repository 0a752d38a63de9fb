"""Metric snapshots: an append-only table (key, ts, branch, total_nodes, total_edges, coverage), listed, compared and pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import upsert

METRICS = ("total_nodes", "total_edges", "coverage")


def save(held: DataFrame, new: DataFrame) -> DataFrame:
    """``held`` with ``new``, by key; snapshots without nodes are refused."""
    if not new.where("coalesce(total_nodes, 0) <= 0").isEmpty():
        raise ValueError("a snapshot without nodes is not saved")
    return upsert(held, new, ["key"])


def listing(snapshots: DataFrame, branch: str | None = None, limit: int = 0) -> DataFrame:
    found = (snapshots.where(F.col("branch") == branch) if branch else snapshots).orderBy(F.desc("ts"), "key")
    return found.limit(limit) if limit else found


def deltas(snapshots: DataFrame) -> DataFrame:
    """Differences of each snapshot to the previous one and to the oldest, of its branch."""
    w = Window.partitionBy("branch").orderBy("ts", "key")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = [F.round(F.col(m) - F.lag(m).over(w), 6).alias(f"{m}_step") for m in METRICS] + [F.round(F.col(m) - F.first(m).over(whole), 6).alias(f"{m}_since") for m in METRICS]
    return snapshots.select("key", "branch", *cols)


def prune(snapshots: DataFrame) -> DataFrame:
    """Without those that equal the one before in all metrics; the oldest and newest of a branch stay."""
    w = Window.partitionBy("branch").orderBy("ts", "key")
    same = F.lit(True)
    for m in METRICS:
        same = same & F.col(m).eqNullSafe(F.lag(m).over(w))
    marked = snapshots.withColumn("_same", same & F.lag("key").over(w).isNotNull() & F.lead("key").over(w).isNotNull())
    return marked.where(~F.col("_same")).drop("_same")


def load(snapshots: DataFrame, key: str) -> DataFrame:
    """The snapshot of a key with its differences to the one before and to the oldest of its branch; an unknown key is an error."""
    found = snapshots.join(deltas(snapshots), ["key", "branch"]).where(F.col("key") == key)
    if found.isEmpty():
        raise KeyError(key)
    return found


def diff(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, and each metric's difference b - a) of pairs (a, b) of keys; a key that isn't there is an error."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    missing = keys.join(snapshots, "key", "left_anti").orderBy("key").first()
    if missing is not None:
        raise KeyError(missing.key)
    side = lambda name: snapshots.select(F.col("key").alias(name), *[F.col(m).alias(f"{m}_{name}") for m in METRICS])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", *[F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 6).alias(m) for m in METRICS])


def capture(metrics: DataFrame, held: DataFrame | None, key: str, branch: str, ts: str) -> DataFrame:
    """A snapshot row of analyze.snapshot_metrics() with its differences to the newest and the oldest of ``held`` (null without any)."""
    row = metrics.select(F.lit(key).alias("key"), F.to_timestamp(F.lit(ts)).alias("ts"), F.lit(branch).alias("branch"), "total_nodes", "total_edges", F.col("coverage_score").alias("coverage"))
    if held is None:
        return row.select("*", *[F.lit(None).cast("double").alias(f"{m}_{x}") for x in ("step", "since") for m in METRICS])
    old = held.where((F.col("branch") == branch) & (F.col("key") != key))
    ends = old.agg(*[F.max_by(m, "ts").alias(f"new_{m}") for m in METRICS], *[F.min_by(m, "ts").alias(f"old_{m}") for m in METRICS])
    both = row.join(F.broadcast(ends))  # one row each
    return both.select(*row.columns, *[(F.col(m) - F.col(f"new_{m}")).cast("double").alias(f"{m}_step") for m in METRICS], *[(F.col(m) - F.col(f"old_{m}")).cast("double").alias(f"{m}_since") for m in METRICS])
