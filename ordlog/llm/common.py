"""What the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordlog.sources.scratch import discard, free, saved, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "discard", "free", "saved", "shared_dir", "table", "to_python"]

#: Rows and bytes in an Arrow batch that goes to Python; a longer text is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_python(spark: SparkSession) -> None:
    """Bounds the memory of Arrow batches, unless the session has a lower bound already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
