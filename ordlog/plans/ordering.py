"""Global order without a global window: rows are dealt into ranges, and what lies before each range is added from one row per range.

The rows are saved once, as the sample, the ranges' totals and the rows themselves read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.sources.scratch import free, saved

#: Rows looked at to place range bounds, and ranges at most; both bound what reaches the driver.
SAMPLE, RANGES = 16_384, 1024


def key_range(df: DataFrame, key: str, ranges: int = RANGES) -> Column:
    """Number of the range that a key falls in; ranges ascend with the key. The bounds come from the SAMPLE rows of least key hash, and a row
    finds its range by halving."""
    got = sorted(r[0] for r in df.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key)).limit(SAMPLE).collect())
    bounds = sorted(set(got[max(1, len(got) // ranges) :: max(1, len(got) // ranges)]))
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    every = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: F.when(F.get(every, n + s - 1) <= F.col(key), n + s).otherwise(n))


def prefix_sum(df: DataFrame, bucket: Column, order: list[Column], value: Column, out: str, reverse: bool = False) -> DataFrame:
    """Adds the sum of `value` over all rows before each row (after it, with reverse). Buckets ascend with the order and none is large. Other
    columns stay, whatever their names."""
    b, t, before = free(df, "_b"), free(df, "_t"), free(df, "_before")
    df = df.withColumn(b, bucket)
    by = Window.orderBy(F.desc(b) if reverse else F.asc(b)).rowsBetween(Window.unboundedPreceding, -1)
    total = df.groupBy(b).agg(F.sum(value).alias(t)).select(b, F.coalesce(F.sum(t).over(by), F.lit(0)).alias(before))
    w = Window.partitionBy(b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = free(df, "_own")
    summed = df.withColumn(own, F.coalesce(F.sum(value).over(w), F.lit(0))).join(total, b)
    return summed.withColumn(out, F.col(before) + F.col(own)).drop(b, before, own)


def ranked(df: DataFrame, key: str, out: str = "rn", descending: bool = False) -> DataFrame:
    """Row numbers from 1 in key order, for a unique key."""
    df = saved(df)
    order = F.col(key).desc() if descending else F.col(key).asc()
    return prefix_sum(df, key_range(df, key) * (-1 if descending else 1), [order], F.lit(1), out).withColumn(out, (F.col(out) + 1).cast("bigint"))


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """Adds prev_k and next_k by a unique key: within ranges by window, at their edges from one row per range."""
    df = saved(df)
    b, lo, hi = free(df, "_b"), free(df, "_lo"), free(df, "_hi")
    df = df.withColumn(b, key_range(df, key))
    w = Window.orderBy(b)
    edge = df.groupBy(b).agg(F.min(key).alias(lo), F.max(key).alias(hi)).select(b, F.lag(hi).over(w).alias(lo), F.lead(lo).over(w).alias(hi))
    own = Window.partitionBy(b).orderBy(key)
    near = df.withColumn("prev_k", F.lag(key).over(own)).withColumn("next_k", F.lead(key).over(own)).join(edge, b)
    return near.withColumn("prev_k", F.coalesce("prev_k", lo)).withColumn("next_k", F.coalesce("next_k", hi)).drop(b, lo, hi)
