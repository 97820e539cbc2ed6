"""Schemas and key encoders.

A LOG frame has k (string or binary), seq (bigint, unique), op (0 delete, 1 put) and v; binary keys order
unsigned-lexicographically in Spark, so every operator takes either type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELETE, PUT = 0, 1
#: Levels of a store; level 0 may hold overlapping files.
NUM_LEVELS = 7
LOG_SCHEMA = "k string not null, seq bigint not null, op int not null, v string"
BATCH_SCHEMA = "batch_id bigint, ordinal int, op int, k string, v string"
FILE_SCHEMA = "level int, file_no bigint, smallest string, largest string, entries bigint, deletes bigint, bytes bigint, max_seq bigint"

# Fixed values of the storage format that this engine's figures must equal.
WRITE_BUFFER = 4 * 1024 * 1024
MAX_FILE = 2 * 1024 * 1024
BLOCK = 4 * 1024
RESTART_INTERVAL = 16
L0_TRIGGER, L0_SLOWDOWN, L0_STOP = 4, 8, 12
GROUP_COMMIT = 1024 * 1024
LEVEL1_BYTES = 10 * 1024 * 1024
GRANDPARENT_BYTES = 10 * MAX_FILE
ENTRY_OVERHEAD = 50
SEEK_BYTES = 16 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(column: Column | str, width: int = 8) -> Column:
    """Zero-padded decimal: text order is numeric order for non-negative values of up to `width` digits."""
    return F.lpad((F.col(column) if isinstance(column, str) else column).cast("string"), width, "0")


def composite_key(*parts: tuple[str, int], sep: str = "/") -> Column:
    return F.concat_ws(sep, *[key_of(c, w) for c, w in parts])


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log that the event table stands for: errors are deletes, anything else a put of its JSON."""
    e = table(spark, sf_dir, "events")
    return e.select(
        key_of("user_id").alias("k"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("op"),
        F.col("props").alias("v"),
        F.expr("event_id div 100").alias("batch_id"),
    )


def conversation_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(composite_key(("conv_id", 8), ("turn", 4)).alias("k"), F.col("text").alias("v"))


def head(log: DataFrame) -> int:
    """The last sequence number; 0 for an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
