"""Approximate nearest neighbours by inner product, with collision-counting hashing.

Inner products become distances: each vector gets one coordinate more, so that all have the greatest norm, and a query's is zero; the nearest point is
then the largest product. Every hash is one random projection, kept as a sorted array. A query opens a window around its own projection in each array,
and a vector collides in an array if its place there lies in the window. Those that collide in THRESHOLD or more of the arrays are verified with
their exact product. While the k-th of them is too far for the window, it widens (virtual rehashing: no array is built anew). The first
width comes from the query's k-th distance to a few vectors of the shard, so most queries need one step; it depends on nothing but the
query and the shard, and a task that is run again gives the same rows.

Vectors are dealt into shards of a bounded size, queries into blocks, and a task handles one block against one shard; each returns its best k, and
these are merged. A shard's windows open until they hold k vectors of that shard, so a third of equal vectors in one place changes nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.llm.common import free, saved

PROJECTIONS, THRESHOLD = 64, 0.42
#: Vectors in a shard and queries in a block, about; a task holds one of each.
SHARD, QUERIES = 8192, 2048
SEED = 11
#: A search ends when its k-th distance is at most so many times the window's half width. A vector at that distance falls into a window with odds of
#: 0.48, and so into THRESHOLD of the PROJECTIONS in 83 of 100 cases; nearer ones more often. Each step widens windows by STEP at least.
NEAR, STEP = 1.55, 1.1
#: Vectors of a shard that set a query's first width.
FIRST = 1024


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with an id and a vector that is neither null nor zero and has only finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


class Shard:
    """Sorted projections of some vectors, and each vector's place in each of them."""

    def __init__(self, x: np.ndarray, top: float) -> None:
        """top: the greatest norm of all shards."""
        self.x, self.short, self.top = x, x.astype(np.float32), top
        self.a = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, PROJECTIONS))
        p = (x @ self.a[:-1] + np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None] * self.a[-1]).T
        order = np.argsort(p, 1, kind="stable")
        self.sorted = np.take_along_axis(p, order, 1)
        self.kind = np.uint16 if len(x) < 1 << 16 else np.uint32
        self.place = np.empty(p.shape, self.kind)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=self.kind)[None, :], 1)

    def first_widths(self, q: np.ndarray, k: int) -> np.ndarray:
        """Half widths that would do if the shard were its vectors looked at."""
        some = self.x[:: max(1, len(self.x) // FIRST)]
        score = np.sort(q @ some.T, 1)[:, ::-1][:, min(k, len(some)) - 1]
        return np.maximum(self.distance(q, score), 1e-3 * self.top) / NEAR

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(-1) + self.top**2 - 2 * score, 0))

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, products) of each query's best k, the nearest first but for ties. own: a query's own place, or -1."""
        n, need = len(self.x), math.ceil(THRESHOLD * PROJECTIONS)
        centre, width = q @ self.a[:-1], self.first_widths(q, k + 1)
        shifted, inside = np.empty_like(self.place), np.empty(self.place.shape, bool)
        out: list = [None] * len(q)
        left = np.arange(len(q))
        while len(left):
            ends = [(np.searchsorted(s, c - width[left]), np.searchsorted(s, c + width[left], "right")) for s, c in zip(self.sorted, centre[left].T)]
            lo, hi = (np.stack([e[i] for e in ends], 1) for i in (0, 1))
            again = []
            for i, a, b in zip(left.tolist(), lo, hi):
                whole = int((b - a).sum()) >= PROJECTIONS * n
                np.subtract(self.place, a.astype(self.kind)[:, None], out=shifted)  # wraps below the window, so that one comparison tells both ends
                np.less(shifted, (b - a).astype(self.kind)[:, None], out=inside)
                found = np.arange(n) if whole else np.flatnonzero(np.add.reduce(inside.view(np.uint8), 0, dtype=np.uint8) >= need)
                found = found[found != own[i]]
                if len(found) < k and not whole:
                    width[i] *= STEP
                    again.append(i)
                    continue
                if len(found) > k:
                    rough = self.short[found] @ q[i].astype(np.float32)
                    least = np.partition(rough, len(found) - k)[len(found) - k] - 1e-5 * self.top * np.linalg.norm(q[i])
                    found = found[rough >= least]  # none of the best k is lost by rounding
                score = np.einsum("ij,j->i", self.x[found], q[i])
                far = float(self.distance(q[i], np.partition(score, len(score) - k)[len(score) - k])) if len(score) >= k else math.inf
                if not whole and far > width[i] * NEAR:
                    # Vectors as near as the k-th found may yet lie outside of the windows.
                    width[i] = max(width[i] * STEP, far / NEAR)
                    again.append(i)
                else:
                    out[i] = found, score
            left = np.array(again, np.int64)
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k other rows of largest inner product; ties go to the smaller vec_id, fewer candidates
    give fewer rows.

    Null and zero vectors and those with null or non-finite components take no part, nor do rows without vec_id. Vectors are searched among
    those of their own length, as others have no product with them. Rows that share a vec_id are rows of their own, as queries (each with its own
    ranks) and as candidates. Other columns, of whatever name, are ignored. Empty tables give no rows.
    """
    is_q = free(vectors, "_q")
    x = usable(vectors, vector).withColumn(is_q, F.coalesce(is_query, F.lit(False)))
    x = x.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(vector, lambda c: c.cast("double")).alias("v"), F.col(is_q).alias("q"))
    x = saved(x.withColumn("d", F.size("v")))  # the numbers of rows hold from here on
    # One row for each length of vector.
    norm = F.aggregate("v", F.lit(0.0).cast("double"), lambda s, c: s + c * c)
    sizes = x.groupBy("d").agg(F.count("*").alias("n"), F.sqrt(F.max(norm)).alias("top"), F.sum(F.col("q").cast("int")).alias("qs")).where("qs > 0")
    parts = lambda n, size: F.ceil(n / size).cast("int")
    sizes = saved(sizes.select("d", (F.col("top") * (1 + 1e-12)).alias("top"), parts(F.col("n"), shard).alias("shards"), parts(F.col("qs"), block).alias("blocks")))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = x.join(sizes, "d")
    left = x.select("d", "top", "row", "vec_id", "v", deal("shards", 1).alias("s"), every("blocks").alias("b"))
    same = [F.col(c).alias(c) for c in ("d", "row", "vec_id", "v")]  # columns of their own, as both sides are read from one table
    right = x.where("q").select(*same, every("shards").alias("s"), deal("blocks", 2).alias("b"))

    def search(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
        a = a.sort_values("row")
        rows, ids = a.row.to_numpy(), a.vec_id.to_numpy()
        own = np.minimum(np.searchsorted(rows, b.row.to_numpy()), len(rows) - 1)
        own = np.where(rows[own] == b.row.to_numpy(), own, -1)
        got = Shard(np.stack(a.v.to_numpy()), float(a.top.iloc[0])).search(np.stack(b.v.to_numpy()), own, k)
        out = []
        for row, q_id, (found, score) in zip(b.row.to_numpy(), b.vec_id.to_numpy(), got):
            best = np.lexsort((ids[found], -score))[:k]
            out.append((np.full(len(best), row), np.full(len(best), q_id), ids[found[best]], score[best]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("row", "query_id", "vec_id", "score"))})

    by = ["d", "s", "b"]
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "row bigint, query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
