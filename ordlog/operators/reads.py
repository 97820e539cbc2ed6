"""Reads over a LOG frame. `visible` is the only place that picks the newest version of a key: the snapshot predicate stands below it, the
tombstone mask above it, and key predicates reach the scan through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.functions.coding import successor
from ordlog.model import PUT
from ordlog.plans.ordering import neighbours as _neighbours
from ordlog.plans.ordering import ranked


def at(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The versions that a snapshot sees; all of them if seq is None."""
    return log if seq is None else log.where(F.col("seq") <= seq)


def newest(log: DataFrame, seq: int | None = None) -> DataFrame:
    """One row per key: its newest version, tombstones included. max_by aggregates before the shuffle, so a hot key costs one row a task."""
    return at(log, seq).groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("_n"), F.max("seq").alias("seq")).select("k", "seq", "_n.op", "_n.v")


def visible(log: DataFrame, seq: int | None = None) -> DataFrame:
    """(k, v, seq) of the live keys."""
    return newest(log, seq).where(F.col("op") == PUT).select("k", "v", "seq")


def between(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Keys in [lo, hi); None is unbounded."""
    if lo is not None:
        df = df.where(F.col("k") >= F.lit(lo))
    return df if hi is None else df.where(F.col("k") < F.lit(hi))


def prefixed(df: DataFrame, prefix) -> DataFrame:
    """Keys that start with the prefix, as a range, so files and row groups are pruned."""
    return between(df, prefix, successor(prefix))


def get(log: DataFrame, key, seq: int | None = None) -> DataFrame:
    return visible(log.where(F.col("k") == key), seq)


def multi_get(log: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """One row per distinct wanted key (column k): its value and seq, or nulls if it is missing or deleted."""
    keys = keys.select("k").distinct()
    return keys.join(visible(log.join(keys, "k", "left_semi"), seq), "k", "left")


def scan(log: DataFrame, seq: int | None = None, descending: bool = False) -> DataFrame:
    """Live keys with their place in key order."""
    return ranked(visible(log, seq), "k", "rn", descending)


def seek(log: DataFrame, key, seq: int | None = None, n: int = 1, skip: int = 0) -> DataFrame:
    """The first n live keys at or above `key`."""
    return visible(between(log, key), seq).orderBy("k").offset(skip).limit(n) if skip else visible(between(log, key), seq).orderBy("k").limit(n)


def first_last(log: DataFrame, seq: int | None = None) -> DataFrame:
    return visible(log, seq).agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"))


def with_neighbours(log: DataFrame, seq: int | None = None) -> DataFrame:
    return _neighbours(visible(log, seq).select("k"), "k")


def history(log: DataFrame, key) -> DataFrame:
    """All versions of one key, newest first from rank 1. Reads one key's rows only."""
    w = Window.partitionBy("k").orderBy(F.desc("seq"))
    return log.where(F.col("k") == key).select("k", "seq", "op", "v", F.row_number().over(w).cast("bigint").alias("version_rank"))


def versions(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The bag of puts that no later tombstone hides."""
    seen = at(log, seq)
    dead = seen.where(F.col("op") != PUT).groupBy("k").agg(F.max("seq").alias("_dead"))
    return seen.where(F.col("op") == PUT).join(dead, "k", "left").where(F.col("seq") > F.coalesce("_dead", F.lit(0))).select("k", "v", "seq")


def diff(log: DataFrame, old: int, new: int | None = None) -> DataFrame:
    """Keys that were inserted (I), updated (U) or deleted (D) from one snapshot to another, in one pass over the log."""
    pick = lambda cond, name: F.max_by(F.when(cond, F.struct("seq", "op")), F.when(cond, F.col("seq"))).alias(name)
    both = at(log, new).groupBy("k").agg(pick(F.col("seq") <= old, "a"), pick(F.lit(True), "b"))
    live = lambda c: F.coalesce(F.col(f"{c}.op") == PUT, F.lit(False))
    change = F.when(~live("a") & live("b"), "I").when(live("a") & ~live("b"), "D").when(live("a") & live("b") & (F.col("a.seq") != F.col("b.seq")), "U")
    return both.select("k", change.alias("change"), F.when(live("a"), F.col("a.seq")).alias("old_seq"), F.when(live("b"), F.col("b.seq")).alias("new_seq")).where(F.col("change").isNotNull())


def by_precedence(sources: DataFrame, rank: Column | str = "source") -> DataFrame:
    """Newest source that knows a key wins, tombstones included; equal ranks are settled by seq."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    return sources.groupBy("k").agg(F.min_by(F.struct("op", "v", "seq"), F.struct(rank, -F.col("seq"))).alias("_n")).where(F.col("_n.op") == PUT).select("k", "_n.v", "_n.seq")


def merge(*runs: DataFrame) -> DataFrame:
    """Bag union of sorted runs in internal order: key up, newest first, earlier run first. Duplicates stay."""
    out = runs[0].withColumn("run", F.lit(0))
    for i, r in enumerate(runs[1:], 1):
        out = out.unionByName(r.withColumn("run", F.lit(i)))
    return out.orderBy("k", F.desc("seq"), F.desc("op"), "run")
