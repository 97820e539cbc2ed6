"""Atomic batches: sequencing, codecs as rows, group commit and the write buffer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlog.functions.coding import entry_size
from ordlog.model import BATCH_SCHEMA, DELETE, ENTRY_OVERHEAD, GROUP_COMMIT, L0_SLOWDOWN, L0_STOP, PUT, WRITE_BUFFER
from ordlog.operators.cuts import greedy
from ordlog.plans.ordering import prefix_sum


class WriteBatch:
    """An ordered list of puts and deletes; later ones win."""

    def __init__(self) -> None:
        self.ops: list[tuple[int, str | bytes, str | bytes | None]] = []

    def put(self, key: str | bytes, value: str | bytes) -> WriteBatch:
        self.ops.append((PUT, key, value))
        return self

    def delete(self, key: str | bytes) -> WriteBatch:
        self.ops.append((DELETE, key, key[:0]))
        return self

    def clear(self) -> WriteBatch:
        self.ops.clear()
        return self

    def count(self) -> int:
        return len(self.ops)

    def frame(self, spark: SparkSession, batch_id: int = 0, binary: bool = False) -> DataFrame:
        """The operations as rows; with `binary`, keys and values as bytes."""
        as_ = _bytes if binary else _text
        return spark.createDataFrame([(batch_id, i, op, as_(k), as_(v)) for i, (op, k, v) in enumerate(self.ops)], BATCH_SCHEMA.replace("string", "binary") if binary else BATCH_SCHEMA)


def _text(x: str | bytes | None) -> str | None:
    return x.decode() if isinstance(x, bytes) else x


def _bytes(x: str | bytes | None) -> bytearray | None:
    return x if x is None else bytearray(x.encode() if isinstance(x, str) else x)


def sequence(batches: DataFrame, last: int = 0) -> DataFrame:
    """Gives the rows of (batch_id, ordinal, ...) consecutive seqs from last + 1, by batch and then ordinal. Batches are the ranges."""
    return prefix_sum(batches, F.col("batch_id"), [F.col("ordinal")], F.lit(1), "seq").withColumn("seq", (F.col("seq") + 1 + last).cast("bigint"))


def pack(log: DataFrame) -> DataFrame:
    """A row per batch, with its first seq, its count and its operations in order."""
    return log.groupBy("batch_id").agg(F.min("seq").alias("base_seq"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "op", "k", "v"))).alias("ops"))


def explode(packed: DataFrame) -> DataFrame:
    """The inverse of pack."""
    return packed.select("batch_id", "base_seq", F.posexplode("ops").alias("ordinal", "o")).select("batch_id", (F.col("base_seq") + F.col("ordinal")).alias("seq"), F.col("ordinal").cast("bigint"), "o.op", "o.k", "o.v")


def counts(log: DataFrame) -> DataFrame:
    return log.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum(F.col("op").cast("bigint")).alias("puts"), F.min("seq").alias("base_seq"))


def commit_groups(log: DataFrame, width: int = GROUP_COMMIT) -> DataFrame:
    """Batches by the `width` bytes of the log in which they begin."""
    size = log.groupBy("batch_id").agg(F.sum(F.length("k").cast("bigint") + F.length("v")).alias("bytes"))
    cum = prefix_sum(size, F.expr("batch_id div 1024"), [F.col("batch_id")], F.col("bytes"), "cum")
    return cum.groupBy(F.floor(F.col("cum") / width).alias("grp")).agg(F.count("*").alias("batches"), F.sum("bytes").alias("bytes"))


def greedy_groups(sizes: Iterable[int], cap: int = GROUP_COMMIT) -> list[int]:
    """Group number of each queued batch: a batch joins its leader's group while the sum stays within cap; the first is always let in. For a
    writer's queue on the driver, which is short."""
    out, group, held = [], -1, 0
    for n in sizes:
        if group < 0 or held + n > cap:
            group, held = group + 1, 0
        held += n
        out.append(group)
    return out


def exact_groups(log: DataFrame, cap: int = GROUP_COMMIT) -> DataFrame:
    """(batch_id, bytes, grp): a batch joins the group of those before it while their sum stays within cap; the first is always let in. The rule of
    greedy_groups, for a log of any length."""
    size = log.groupBy("batch_id").agg(F.sum(F.octet_length("k").cast("bigint") + F.octet_length("v")).alias("bytes"))
    cum = prefix_sum(size, F.expr("batch_id div 1024"), [F.col("batch_id")], F.col("bytes"), "_cum")
    return greedy(cum, "_cum", "bytes", "grp", cap, whole=True).drop("_cum")


def exact_buffers(log: DataFrame, width: int = WRITE_BUFFER) -> DataFrame:
    """The write buffer each entry goes to: a new one once those in the buffer hold over `width`, counted as entry_size and its overhead."""
    sized = log.withColumn("_size", entry_size(F.col("k"), F.col("v")) + ENTRY_OVERHEAD)
    cum = prefix_sum(sized, F.expr("seq div 65536"), [F.col("seq")], F.col("_size"), "_cum")
    return greedy(cum, "_cum", "_size", "buffer", width).drop("_cum", "_size")


def buffers(log: DataFrame, width: int = WRITE_BUFFER) -> DataFrame:
    """Which write buffer each entry falls into, by the running size of the entries before it."""
    cum = prefix_sum(log, F.expr("seq div 65536"), [F.col("seq")], entry_size(F.col("k"), F.col("v")) + ENTRY_OVERHEAD, "cum")
    return cum.withColumn("buffer", F.floor(F.col("cum") / width))


def pressure(level0_files: int) -> str:
    """What a writer has to do."""
    return "stop" if level0_files >= L0_STOP else "slow" if level0_files >= L0_SLOWDOWN else "go"
