"""Connected components by repeated contraction.

Each round, a node points to its least neighbour if that is less than the node. Pointers jump to their targets' targets until they rest, which
takes the logarithm of the longest way, and the edges are rewritten between the nodes where they rest; an edge's ends stay connected because each
pointer follows an edge. A node that no other points to and that is less than all its neighbours has a lesser neighbour in the next round, so
two rounds halve the nodes at least: a chain in order takes one round, and no graph more than about the logarithm of its size. Each step is cut
in the shared folder, and tables that no later step reads go at once. Minima aggregate before the shuffle, and joins on a hot node are split by
AQE, so a hub costs no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlog.llm.common import discard, saved


def rested(pointers: DataFrame) -> DataFrame:
    """(node, parent) after jumping until no pointer moves."""
    while True:
        target = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = saved(pointers.join(target, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        discard(pointers)
        if not jumped.where("moved").limit(1).count():
            return jumped
        pointers = jumped


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root being the least node of its component. Null ends and loops link nothing; a node that
    has only these is absent. Repeated edges and either direction count once. No edges: no rows."""
    e = saved(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    assigned = None
    while e.limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent"))
        up = rested(saved(least))
        before, old = assigned, e
        if assigned is None:
            assigned = saved(up.select("node", F.col("parent").alias("root")))
        else:
            assigned = saved(assigned.join(up.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
            discard(before)
        a, b = up.select(F.col("node").alias("a"), F.col("parent").alias("pa")), up.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        e = saved(e.join(a, "a").join(b, "b").where(F.col("pa") != F.col("pb")).select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        discard(old)
        discard(up)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")) if assigned is None else assigned
