"""Compaction rules over LOG frames: what may be dropped, and where outputs are cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.model import DELETE, GRANDPARENT_BYTES, MAX_FILE, PUT
from ordlog.operators.cuts import greedy
from ordlog.operators.reads import newest
from ordlog.plans.ordering import key_range, prefix_sum
from ordlog.sources.scratch import free, saved


def interval(seq: Column, snapshots: Sequence[int]) -> Column:
    """How many snapshots lie below a version: versions of a key with equal numbers are seen by the same readers."""
    out = F.lit(0)
    for s in sorted(set(snapshots)):
        out = out + (seq > s).cast("int")
    return out


def keep(log: DataFrame, snapshots: Sequence[int] = ()) -> DataFrame:
    """For the head and for each snapshot, the newest version of each key that it sees; tombstones stay. Aggregates before the shuffle."""
    others = [c for c in log.columns if c not in ("k", "seq")]
    i, n = free(log, "_i"), free(log, "_n")
    g = log.groupBy("k", interval(F.col("seq"), snapshots).alias(i)).agg(F.max_by(F.struct(*others), "seq").alias(n), F.max("seq").alias("seq"))
    return g.select("k", "seq", f"{n}.*")


def covered(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows whose key k lies in a closed range (smallest, largest). Ranges that meet are merged first, so that a key has one place to look at:
    the range that begins last at or before it. That is found in key order, range by range of keys, and no row meets all files."""
    lo, hi, kind = free(keys, "_lo"), free(keys, "_hi"), free(keys, "_kind")
    keys = saved(keys)
    reach = Window.orderBy("smallest", "largest")
    fresh = ranges.select("smallest", "largest", F.max("largest").over(reach.rowsBetween(Window.unboundedPreceding, -1)).alias("_r"))
    fresh = fresh.withColumn("_g", F.sum(F.when(F.col("_r") >= F.col("smallest"), 0).otherwise(1)).over(reach.rowsBetween(Window.unboundedPreceding, 0)))
    merged = saved(fresh.groupBy("_g").agg(F.min("smallest").alias(lo), F.max("largest").alias(hi)).drop("_g"))  # metadata: a row for each file at most
    part, first = free(keys, "_part"), key_range(keys, "k")
    # A range stands at its start and, as it may go on there, at the start of each later part: the last one begun before is carried.
    marks = merged.withColumn("k", F.col(lo)).withColumn(part, first).withColumn(kind, F.lit(1))
    rows = keys.withColumn(part, first).withColumn(kind, F.lit(0)).unionByName(marks.select("k", hi, part, kind), allowMissingColumns=True)
    top = marks.groupBy(part).agg(F.max(hi).alias(lo))
    spans = rows.select(part).distinct().join(top, part, "left").withColumn(lo, F.max(lo).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
    begun = F.max(hi).over(Window.partitionBy(part).orderBy("k", F.desc(kind)).rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumn(hi, begun).join(spans, part).where((F.col(kind) == 0) & (F.col("k") <= F.greatest(hi, lo)))
    return held.select(*keys.columns)


def compact(log: DataFrame, snapshots: Sequence[int] = (), deeper: DataFrame | None = None, base_level: bool = True) -> DataFrame:
    """keep, then drop tombstones that hide nothing: those that are the oldest version kept of their key, seen by every snapshot, with no
    deeper file (smallest, largest) over the key. base_level False keeps all tombstones."""
    kept = keep(log, snapshots)
    if not base_level:
        return kept
    oldest, m, first = min(snapshots, default=None), free(kept, "_m"), free(kept, "_first")
    kept = kept.withColumn(first, F.lit(True)) if not snapshots else kept.join(kept.groupBy("k").agg(F.min("seq").alias(m)), "k").withColumn(first, F.col("seq") == F.col(m)).drop(m)
    dead = (F.col("op") == DELETE) & F.col(first) & (F.lit(True) if oldest is None else F.col("seq") <= oldest)
    if deeper is None:
        return kept.where(~dead).drop(first)
    kept = saved(kept)
    return kept.where(~dead).unionByName(covered(kept.where(dead), deeper)).drop(first)


def compact_range(log: DataFrame, lo: str | None, hi: str | None, snapshots: Sequence[int] = ()) -> DataFrame:
    """compact within the closed range [lo, hi], other keys as they are; None is unbounded."""
    inside = F.lit(True) if lo is None else F.col("k") >= lo
    inside = inside if hi is None else inside & (F.col("k") <= hi)
    return log.where(~inside).unionByName(compact(log.where(inside), snapshots).select(*log.columns))


def idle_tombstones(log: DataFrame) -> DataFrame:
    """Tombstones with no older version of their key."""
    return log.join(log.groupBy("k").agg(F.min("seq").alias("_m")), "k").where((F.col("op") == DELETE) & (F.col("seq") == F.col("_m"))).select("k", "seq")


def base_level_tombstones(log: DataFrame, deeper: DataFrame) -> DataFrame:
    """(k, seq) of tombstones whose key no deeper file (smallest, largest) covers."""
    dead = saved(log.where(F.col("op") == DELETE).select("k", "seq"))
    return dead.join(covered(dead, deeper), ["k", "seq"], "left_anti")


def passed_bytes(rows: DataFrame, grandparents: DataFrame, out: str) -> DataFrame:
    """Adds the bytes of the grandparent files (largest, bytes) that end before each key, by one pass in key order."""
    rows, kind, size = saved(rows), free(rows, "_kind"), free(rows, "_size")
    marks = grandparents.select(F.col("largest").alias("k"), F.col("bytes").cast("bigint").alias(size), F.lit(1).alias(kind))
    both = saved(rows.withColumn(size, F.lit(0).cast("bigint")).withColumn(kind, F.lit(0)).unionByName(marks, allowMissingColumns=True))
    # A file ends at its largest key, which the key itself doesn't pass.
    return prefix_sum(both, key_range(rows, "k"), [F.col("k"), F.col(kind)], F.col(size), out).where(F.col(kind) == 0).drop(kind, size)


def split_outputs(rows: DataFrame, size: Column, grandparents: DataFrame | None = None, max_file: int = MAX_FILE, max_overlap: int = GRANDPARENT_BYTES) -> DataFrame:
    """Numbers the output file of each key at fixed widths: a new one each max_file bytes, and each max_overlap bytes of grandparent files passed."""
    rows = saved(rows)
    n, b = free(rows, "_cum"), free(rows, "_passed")
    cum = prefix_sum(rows, key_range(rows, "k"), [F.col("k")], size, n)
    cum = cum.withColumn(b, F.lit(0)) if grandparents is None else passed_bytes(cum, grandparents, b)
    return cum.withColumn("part", F.floor(F.col(n) / max_file)).withColumn("passed", F.floor(F.col(b) / max_overlap)).drop(n, b)


def cut_outputs(rows: DataFrame, size: Column, grandparents: DataFrame | None = None, max_file: int = MAX_FILE, max_overlap: int = GRANDPARENT_BYTES) -> DataFrame:
    """Numbers the output file of each key by the exact rules, each counting anew at its own cuts: `part` begins once a file holds over max_file
    bytes, `passed` once over max_overlap bytes of grandparent files were passed. An output file is a pair of the two."""
    rows = saved(rows)
    n, s, b = free(rows, "_cum"), free(rows, "_size"), free(rows, "_passed")
    cut = greedy(prefix_sum(rows.withColumn(s, size), key_range(rows, "k"), [F.col("k")], F.col(s), n), n, s, "part", max_file).drop(n, s)
    if grandparents is None:
        return cut.withColumn("passed", F.lit(0).cast("bigint"))
    # Files that end before the first key were never passed.
    crossed = saved(passed_bytes(cut, grandparents, b))
    start = crossed.agg(F.coalesce(F.min(b), F.lit(0)).alias("x")).first()["x"]
    return greedy(crossed.withColumn(b, F.col(b) - start).withColumn(s, F.lit(0)), b, s, "passed", max_overlap).drop(b, s)


def live(log: DataFrame) -> DataFrame:
    """A full merge at the head."""
    return newest(log).where(F.col("op") == PUT)
