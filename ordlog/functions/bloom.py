"""An explicit Bloom filter: one binary value for a set of keys, built by an aggregate and tested as an expression.

Bit i is bit i mod 8 of byte i div 8, and the last byte holds the number of probes. Probes start at the key's 32-bit hash and go on by the hash
turned right by 17 bits, modulo 2^32.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlog.functions.coding import hash32

_U32 = 0xFFFFFFFF
#: Bytes of a filter that is tested by broadcast; beyond it, filters are joined.
SMALL = 8 << 20


def probes(bits_per_key: int) -> int:
    """The number of hash functions, 1 to 30."""
    return min(30, max(1, math.floor(bits_per_key * 0.69)))


def size_in_bytes(n_keys: Column, bits_per_key: int) -> Column:
    return F.floor((F.greatest(F.lit(64), n_keys * bits_per_key) + 7) / 8).cast("int")


def positions(key: Column, size: Column, k: Column) -> Column:
    """The bits that a key probes in a filter of `size` bytes."""
    h = hash32(key)
    delta = F.shiftrightunsigned(h, 17).bitwiseOR(F.shiftleft(h, 15)).bitwiseAND(F.lit(_U32))
    steps = F.sequence(F.lit(0), k - 1)
    return F.get(F.transform(F.array(F.struct(h.alias("h"), delta.alias("d"))), lambda x: F.transform(steps, lambda j: (x["h"] + j * x["d"]).bitwiseAND(F.lit(_U32)) % (size * 8))), F.lit(0))


def build(keys: DataFrame, key: str, n_keys: int | None = None, bits_per_key: int = 10, by: str | None = None) -> DataFrame:
    """(filter) of all keys, or (by, filter) for each value of a column, sized for n_keys or for as many as there are. Bits are merged by byte
    before and after the shuffle."""
    k, group = probes(bits_per_key), [] if by is None else [by]
    if by is None and n_keys is not None:
        sizes = keys.sparkSession.range(1).select(size_in_bytes(F.lit(n_keys), bits_per_key).alias("_size"))
    else:
        sizes = keys.groupBy(*group).agg(size_in_bytes(F.count("*") if n_keys is None else F.lit(n_keys), bits_per_key).alias("_size"))
    sized = keys.crossJoin(F.broadcast(sizes)) if by is None else keys.join(sizes, by)  # without `by`, one row
    bit = sized.select(*group, F.explode(positions(F.col(key), F.col("_size"), F.lit(k))).alias("_bit"))
    value = F.call_function("shiftleft", F.lit(1), F.expr("cast(_bit % 8 as int)"))
    some = bit.groupBy(*group, F.expr("cast(_bit div 8 as int)").alias("_at")).agg(F.bit_or(value).alias("_v"))
    empty = sizes.select(*group, F.explode(F.sequence(F.lit(0), F.col("_size") - 1)).alias("_at"), F.lit(0).alias("_v"))
    whole = some.unionByName(empty).groupBy(*group, "_at").agg(F.bit_or("_v").alias("_v"))
    listed = whole.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda b: F.lpad(F.hex(b["_v"]), 2, "0")), "")
    return listed.select(*group, F.unhex(F.concat(text, F.lit(f"{k:02X}"))).alias("filter"))


def might_contain(filter_: Column, key: Column) -> Column:
    """Whether a key may be in a filter: true for all that are. A filter without a bit holds nothing; one of over 30 probes tells nothing."""
    size = F.octet_length(filter_) - 1
    number = lambda i: F.conv(F.hex(F.substring(filter_, i, F.lit(1))), 16, 10).cast("bigint")
    k = number(size + 1).cast("int")
    set_ = lambda p: F.call_function("shiftrightunsigned", number(F.floor(p / 8).cast("int") + 1), (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return F.when(size < 1, False).when(k > 30, True).otherwise(F.forall(positions(key, size, F.greatest(F.lit(1), k)), set_))


def may_match(probe: DataFrame, key: str, bloom: DataFrame) -> DataFrame:
    """The rows of `probe` whose key may be in the filter of one row that `build` gave: never fewer than those that are. The filter is sent to
    every task, so it is for sets of up to SMALL bytes; larger sets are built by file or partition."""
    only = bloom.select(F.when(F.octet_length("filter") > SMALL, F.raise_error(F.lit("the filter is too large to be sent to every task; build it by a column")).cast("binary")).otherwise(F.col("filter")).alias("_filter"))
    return probe.crossJoin(F.broadcast(only)).where(might_contain(F.col("_filter"), F.col(key))).drop("_filter")
