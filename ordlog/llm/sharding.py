"""Shard placement by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own: an offset and a step from its name. The shards take turns, each
claiming the first slot it prefers that is free, until all are taken. A key's shard is the table's entry at its hash: constant time, shares
equal to within one slot, and few keys that move when a shard comes or goes. The table has a fixed size and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlog.llm.common import free

#: A prime; the table's rows, and so the bound on what is broadcast.
SLOTS = 65_537


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the place in `shards` of the one that claimed it. The names must differ, and there may be no more than slots."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("give between one and `slots` shards, of different names")
    taken, out, left = [False] * slots, [0] * slots, slots
    at = [xxhash.xxh64_intdigest(s, 1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 if slots > 1 else 1 for s in shards]
    while left:
        for i in range(len(shards)):
            while taken[at[i]]:
                at[i] = (at[i] + step[i]) % slots
            taken[at[i]], out[at[i]] = True, i
            left -= 1
            if not left:
                break
    return out


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


def assign(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Adds slot and shard to every row. Equal keys go together; null keys have the slot of the hash's seed; keys are hashed as text, whole and whatever
    their length. Repeated rows stay. A column of either name, in any case, is replaced, also where it is the key itself; other columns
    stay. An empty table gives no rows. One broadcast join of `slots` rows, no shuffle."""
    names = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "_slot int, _shard string")
    at = free(df, "_at")
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.withColumn(at, slot_of(F.col(key), slots)).select(*kept, at)
    names = names.select(F.col("_slot").alias(at), F.col("_shard").alias("shard"))
    return placed.join(F.broadcast(names), at).select(*kept, F.col(at).alias("slot"), "shard")
