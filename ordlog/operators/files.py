"""Files and levels as rows of FILE_SCHEMA: statistics, candidates, overlap, scores. File tables are metadata, one row for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.functions.coding import level_capacity, shared_prefix, varint_length
from ordlog.model import BLOCK, GRANDPARENT_BYTES, L0_TRIGGER, NUM_LEVELS, RESTART_INTERVAL, SEEK_BYTES
from ordlog.plans.ordering import key_range, prefix_sum
from ordlog.sources.scratch import saved


def stats(entries: DataFrame, *by: str) -> DataFrame:
    """A row for each file of entries that carry their level and file_no."""
    return entries.groupBy(*by).agg(
        F.min("k").alias("smallest"), F.max("k").alias("largest"), F.count("*").alias("entries"), F.sum((1 - F.col("op")).cast("bigint")).alias("deletes"),
        F.sum(F.length("k").cast("bigint") + F.length("v") + 9).alias("bytes"), F.max("seq").alias("max_seq"),
    )


def candidates(files: DataFrame, key: str) -> DataFrame:
    """Files that may hold a key, in search order."""
    return files.where((F.col("smallest") <= key) & (F.col("largest") >= key)).orderBy("level", F.desc("file_no"))


def find(files: DataFrame, key: str) -> DataFrame:
    """In each level from 1 on, the first file whose largest key is at or above the key."""
    return files.where((F.col("level") > 0) & (F.col("largest") >= key)).groupBy("level").agg(F.min("largest").alias("largest"), F.min_by("file_no", "largest").alias("file_no"))


def overlaps(files: DataFrame) -> DataFrame:
    """Pairs of files whose closed key ranges meet, the lower file number first."""
    a = files.select(F.col("file_no").alias("a"), F.col("smallest").alias("_s"), F.col("largest").alias("_l"))
    b = files.select(F.col("file_no").alias("b"), "smallest", "largest")
    return a.join(b, (F.col("a") < F.col("b")) & (F.col("_s") <= F.col("largest")) & (F.col("smallest") <= F.col("_l"))).select("a", "b")


def overlapping(files: DataFrame, lo: str | None, hi: str | None, level: int | None = None) -> DataFrame:
    """Files that meet the closed range [lo, hi]; None is unbounded."""
    out = files if level is None else files.where(F.col("level") == level)
    out = out if lo is None else out.where(F.col("largest") >= lo)
    return out if hi is None else out.where(F.col("smallest") <= hi)


def islands(files: DataFrame) -> DataFrame:
    """Groups of files joined by chains of overlap, which must be compacted together."""
    order = Window.orderBy("smallest", "file_no")
    reach = F.max("largest").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = files.withColumn("_new", F.coalesce((F.col("smallest") > reach).cast("int"), F.lit(1)))
    own = fresh.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("island").agg(F.count("*").alias("files"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def closure(files: DataFrame, file_no: int) -> DataFrame:
    """The level-0 files that overlap a file, directly or through others."""
    return closure_of(files, files.where((F.col("level") == 0) & (F.col("file_no") == file_no)).limit(1))


def closure_of(files: DataFrame, one: DataFrame) -> DataFrame:
    """The level-0 files that overlap the file of a frame of one row, directly or through others."""
    zero = files.where(F.col("level") == 0)
    seed = one.select(F.col("smallest").alias("_k"))
    hit = islands(zero).join(seed, (F.col("smallest") <= F.col("_k")) & (F.col("largest") >= F.col("_k"))).select(F.col("smallest").alias("_lo"), F.col("largest").alias("_hi"))
    return zero.join(hit, (F.col("smallest") >= F.col("_lo")) & (F.col("largest") <= F.col("_hi"))).drop("_lo", "_hi")


def scores(files: DataFrame, trigger: int = L0_TRIGGER) -> DataFrame:
    """How full each level is, with the fullest first; ties go to the lower level."""
    g = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(float(trigger))).otherwise(F.col("bytes") / level_capacity(F.col("level")))
    return g.withColumn("score", score).withColumn("pick", F.row_number().over(Window.orderBy(F.desc("score"), "level")).cast("bigint"))


def level_stats(files: DataFrame) -> DataFrame:
    """Files and megabytes of every level, empty ones too."""
    spine = files.sparkSession.range(NUM_LEVELS).select(F.col("id").cast("int").alias("level"))
    g = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return spine.join(g, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("files"), F.round(F.coalesce("b", F.lit(0)) / F.lit(1048576.0), 1).alias("mb"))


def trivial_moves(files: DataFrame, level: int) -> DataFrame:
    """Files of a level that may sink one level by a change of the manifest alone: nothing overlaps them in the next two."""
    deep = files.where(F.col("level").isin(level + 1, level + 2)).select(F.col("smallest").alias("_s"), F.col("largest").alias("_l"))
    return files.where(F.col("level") == level).join(deep, (F.col("smallest") <= F.col("_l")) & (F.col("_s") <= F.col("largest")), "left_anti")


def located(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(k, level, file_no): for each key the file of each level from 1 on whose range holds it. Files of such a level are disjoint, so it is the one that
    begins last at or before the key: found in key order, within ranges of keys, with what is carried into a range from one row for each."""
    keys, deep = saved(keys.select("k")), files.where(F.col("level") > 0)
    part = key_range(keys, "k")
    spot = F.struct("largest", "file_no")
    marks = deep.select(F.col("smallest").alias("k"), "level", F.lit(1).alias("kind"), spot.alias("f")).withColumn("part", part)
    every = F.explode(F.sequence(F.lit(1), F.lit(NUM_LEVELS - 1))).alias("level")
    rows = keys.select("k", part.alias("part")).select("k", every, "part", F.lit(0).alias("kind"), F.lit(None).cast(marks.schema["f"].dataType).alias("f"))
    both = rows.unionByName(marks)
    ahead = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("level", "part").agg(F.max_by("f", F.when(F.col("kind") == 1, F.col("k"))).alias("f")).select("level", "part", F.last("f", True).over(ahead).alias("c"))
    here = Window.partitionBy("level", "part").orderBy("k", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("f", F.last("f", True).over(here)).where("kind = 0").join(carried, ["level", "part"]).withColumn("f", F.coalesce("f", "c"))
    return found.where(F.col("k") <= F.col("f.largest")).select("k", "level", "f.file_no")


def seek_budget(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Lookups that touch each file, against what its size allows before it is to be compacted. Level 0, where files overlap and are few, is met file by
    file."""
    files = files.withColumn("budget", F.greatest(F.lit(1), F.floor(F.col("bytes") / SEEK_BYTES)).cast("bigint"))
    zero = files.where(F.col("level") == 0).select("file_no", "smallest", "largest")
    top = keys.select("k").join(zero, (F.col("k") >= F.col("smallest")) & (F.col("k") <= F.col("largest"))).select("file_no")
    hit = top.unionByName(located(keys, files).select("file_no")).groupBy("file_no").agg(F.count("*").alias("seeks"))
    return files.join(hit, "file_no", "left").select("file_no", F.coalesce("seeks", F.lit(0)).alias("seeks"), "budget", (F.coalesce("seeks", F.lit(0)) > F.col("budget")).alias("over"))


def flush_level(files: DataFrame, lo: str, hi: str, deepest: int = 2, limit: int = GRANDPARENT_BYTES) -> int:
    """The level to which a run over [lo, hi] may go."""
    one = files.sparkSession.createDataFrame([(lo, hi)], "lo string, hi string")
    return flush_levels(files, one, deepest, limit).first()["level"]


def flush_levels(files: DataFrame, ranges: DataFrame, deepest: int = 2, limit: int = GRANDPARENT_BYTES) -> DataFrame:
    """(lo, hi, level): for each closed range the level to which a run over it may go: down while the next level doesn't meet it and the one after holds
    little that does; level 0 where a file of that level meets it."""
    met = ranges.select("lo", "hi").distinct().join(files.select("level", "bytes", "smallest", "largest"), (F.col("largest") >= F.col("lo")) & (F.col("smallest") <= F.col("hi")), "left")
    held = [F.coalesce(F.sum(F.when(F.col("level") == n, F.col("bytes"))), F.lit(0)).alias(f"_b{n}") for n in range(deepest + 3)]
    meets = [F.coalesce(F.max(F.when(F.col("level") == n, True)), F.lit(False)).alias(f"_m{n}") for n in range(deepest + 3)]
    level = F.lit(deepest)
    for n in reversed(range(deepest)):
        level = F.when(F.col(f"_m{n + 1}") | (F.col(f"_b{n + 2}") > limit), n).otherwise(level)
    return met.groupBy("lo", "hi").agg(*held, *meets).select("lo", "hi", F.when(F.col("_m0"), 0).otherwise(level).alias("level"))


def pick(files: DataFrame, level: int, after: str | None = None) -> DataFrame:
    """(role, file_no): the first file of a level that ends after a key (the first of all if none does), with all of level 0 that meet it directly
    or through others; the files of the next level that meet these; and those of the level after that meet either."""
    order = ["file_no"] if level == 0 else ["smallest"]
    own = files.where(F.col("level") == level)
    late = F.lit(False) if after is None else F.col("largest") > after
    first = own.orderBy(F.when(late, 0).otherwise(1), *order).limit(1)
    if level == 0:
        first = closure_of(files, first)
    first = saved(first)
    bound = lambda df: df.agg(F.min("smallest").alias("_lo"), F.max("largest").alias("_hi"))
    meeting = lambda n, df: files.where(F.col("level") == n).join(bound(df), (F.col("largest") >= F.col("_lo")) & (F.col("smallest") <= F.col("_hi"))).drop("_lo", "_hi")
    parents = saved(meeting(level + 1, first))
    grand = meeting(level + 2, first.unionByName(parents))
    part = lambda df, role: df.select(F.lit(role).alias("role"), "file_no")
    return part(first, "input").unionByName(part(parents, "parent")).unionByName(part(grand, "grandparent"))


def replay(edits: DataFrame) -> DataFrame:
    """Live files after a log of edits (action ADD or REMOVE), whatever their order within a version."""
    n = F.sum(F.when(F.col("action") == "ADD", 1).otherwise(-1)).alias("live")
    return edits.groupBy("level", "file_no").agg(n).where(F.col("live") > 0).select("level", "file_no")


def obsolete(present: DataFrame, live: DataFrame) -> DataFrame:
    """Files that no live version names."""
    return present.join(live.select("file_no").distinct(), "file_no", "left_anti")


def approximate_offset(rows: DataFrame, size, block: int = BLOCK) -> DataFrame:
    """Bytes and blocks before each key of a sorted run."""
    rows = saved(rows)
    cum = prefix_sum(rows, key_range(rows, "k"), [F.col("k")], size, "offset")
    return cum.select("k", F.col("offset").cast("bigint"), F.floor(F.col("offset") / block).alias("block"))


def prefix_compression(rows: DataFrame, interval: int = RESTART_INTERVAL) -> DataFrame:
    """What each key shares with the one before it in its block group of `interval` keys; column rn holds the place in key order from 1."""
    group = F.floor((F.col("rn") - 1) / interval)
    w = Window.partitionBy("grp").orderBy("rn")
    return rows.withColumn("grp", group).withColumn("shared", shared_prefix(F.lag("k").over(w), F.col("k"))).select("rn", "k", "grp", "shared", (F.length("k").cast("bigint") - F.col("shared")).alias("unshared"))


def block_size_estimate(rows: DataFrame, interval: int = RESTART_INTERVAL) -> DataFrame:
    """(entries, restarts, buffer, estimate) of one block of all rows (rn, k, v): each entry is three varints (shared, unshared, length of the value), the
    rest of the key and the value; the block ends with four bytes for each restart and four for their number."""
    size = F.octet_length("v").cast("bigint")
    told = prefix_compression(rows.withColumn("v", F.coalesce("v", F.lit(""))), interval).join(rows.select("rn", F.coalesce(size, F.lit(0)).alias("_n")), "rn")
    entry = varint_length(F.col("shared")) + varint_length(F.col("unshared")) + varint_length(F.col("_n")) + F.col("unshared") + F.col("_n")
    out = told.agg(F.count("*").alias("entries"), F.greatest(F.lit(1), F.count_distinct("grp")).alias("restarts"), F.coalesce(F.sum(entry), F.lit(0)).alias("buffer"))
    return out.select("*", (F.col("buffer") + 4 * F.col("restarts") + 4).alias("estimate"))
