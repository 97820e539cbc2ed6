"""Exact greedy cuts of an ordered table: a new group begins where the one before it is full, and counts from nothing again.

Where a group ends depends on where it began, so this is a fold over all rows. It is done in three parts that are each distributed. Rows carry the
running size before them; from a row that begins a group, the next one is the first whose running size is far enough ahead. Rows are dealt into spans
of many groups' size. In each span, next to its neighbour, every row learns by halving where a group that began there leads to beyond the span.
Those jumps double from span to span until the spans' real first rows are known, in as many rounds as the number of spans has binary digits.
Then each span is folded from there. One span takes no round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.sources.scratch import free, saved

#: Groups in a span, about.
SPAN = 128


def _next(at: np.ndarray, end: np.ndarray, width: int, whole: bool) -> np.ndarray:
    """For each row that may begin a group, the place of the row that begins the one after it. at, end: running size before and after a row."""
    target = np.searchsorted(end if whole else at, at + width, "right")
    return np.maximum(target, np.arange(len(at)) + 1)


def greedy(df: DataFrame, cum: str, size: str, out: str, width: int, whole: bool = False, span: int = SPAN) -> DataFrame:
    """Adds `out`, the number from 0 of each row's group. cum: the sum of the column `size` over all rows before; the order of rows is by it and by size,
    which are not negative; rows of size 0 go with the row after them.

    A row begins a group if the rows of the group before it hold over `width`; with `whole`, if they would with the row itself, and a row over the width
    is a group of its own. An empty table gives no rows.
    """
    bucket, first = free(df, "_span"), free(df, "_first")
    df = saved(df.withColumn(bucket, F.expr(f"`{cum}` div {width * span}")))
    # One row for each span that has rows; numbers without gaps, and where the spans after it begin.
    order = Window.orderBy(bucket)
    spans = saved(df.groupBy(bucket).agg(F.min(cum).alias("lo")).select(bucket, F.row_number().over(order).cast("bigint").alias("s"), "lo", F.lead("lo", 2).over(order).alias("beyond")))
    n = spans.count()
    rows = df.select(bucket, F.col(cum).cast("bigint").alias("at"), (F.col(cum) + F.col(size)).cast("bigint").alias("end")).distinct().join(spans, bucket)
    if not n:
        return df.withColumn(out, F.lit(0).cast("bigint")).drop(bucket)

    def begins(at: np.ndarray, end: np.ndarray, own: int, beyond: float) -> np.ndarray:
        """The running size at which the next group begins, for each of the span's own rows; beyond the last span it is -1."""
        to, after = _next(at, end, width, whole)[:own], -1 if np.isnan(beyond) else int(beyond)
        return np.where(to < len(at), at[np.minimum(to, len(at) - 1)], after)

    def ordered(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, float]:
        g = g.sort_values(["home", "at", "end"], ascending=[False, True, True])
        # Of rows that begin at one place the last has the size.
        g = g.drop_duplicates("at", keep="last")
        return g["at"].to_numpy(), g["end"].to_numpy(), int(g["home"].sum()), float(g["beyond"].max())

    def exits(g: pd.DataFrame) -> pd.DataFrame:
        at, end, own, beyond = ordered(g)
        to = begins(at, end, own, beyond)
        while (inside := (to >= 0) & (to <= at[own - 1])).any():
            to = np.where(inside, to[np.minimum(np.searchsorted(at[:own], to), own - 1)], to)
        return pd.DataFrame({"at": at[:own], "to": to})

    both = rows.select("s", "at", "end", F.lit(True).alias("home"), "beyond").unionByName(rows.where("s > 1").select((F.col("s") - 1).alias("s"), "at", "end", F.lit(False).alias("home"), F.lit(None).cast("bigint").alias("beyond")))
    entries = spans.where("s = 1").select(F.col("lo").alias("at"))
    if n > 1:
        jump, reached = saved(both.groupBy("s").applyInPandas(exits, "at bigint, to bigint")), saved(entries)
        for _ in range((n - 1).bit_length()):
            reached = saved(reached.unionByName(reached.join(jump, "at").where("to >= 0").select(F.col("to").alias("at"))).distinct())
            jump = saved(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("on")), "to", "left").select("at", F.coalesce("on", F.lit(-1).cast("bigint")).alias("to")))
        entries = reached
    marked = both.join(entries.select(F.col("at"), F.lit(True).alias("entry")), "at", "left")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        s, real = int(g["s"].iloc[0]), g.loc[g["home"] & g["entry"].notna(), "at"]
        if not len(real):
            return pd.DataFrame({"s": [], "begin": [], "k": []})
        at, end, own, _ = ordered(g)
        to, out, i = _next(at, end, width, whole), [], int(np.searchsorted(at, real.min()))
        while i < own:
            out.append(at[i])
            i = int(to[i])
        return pd.DataFrame({"s": s, "begin": out, "k": range(len(out))})

    starts = saved(marked.groupBy("s").applyInPandas(fold, "s bigint, begin bigint, k bigint"))
    # One row for each span again: groups before it, and the last of them, which its first rows may go on with.
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    total = spans.join(starts.groupBy("s").agg(F.count("*").alias("n")), "s", "left").select(bucket, "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    begun = starts.join(total.select("s", "ahead"), "s").select("s", "begin", (F.col("ahead") + F.col("k")).alias(out))
    line = Window.partitionBy("s").orderBy("at", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    named = df.join(total, bucket)
    events = named.select("*", F.col(cum).cast("bigint").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias(first))
    marks = begun.select("s", F.col("begin").alias("at"), F.lit(1).alias("kind"), F.col(out).alias(first))
    got = events.unionByName(marks, allowMissingColumns=True).withColumn(out, F.last(first, ignorenulls=True).over(line)).where("kind = 0")
    return got.withColumn(out, F.coalesce(out, F.col("ahead") - 1).cast("bigint")).drop(bucket, "s", "ahead", "at", "kind", first)
