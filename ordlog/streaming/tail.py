"""The write-ahead log as a stream: newest version per key, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlog.model import LOG_SCHEMA


def tail(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream over the logs below a path (a glob may name sub-folders)."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def latest(stream: DataFrame) -> DataFrame:
    """Newest version per key as a streaming aggregate; its state is a row for each key. Write it in update or complete mode. Tombstones stay, so
    that a consumer can delete."""
    return stream.groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("_n"), F.max("seq").alias("seq")).select("k", "seq", "_n.op", "_n.v")


def follow(stream: DataFrame, sink, checkpoint: str):
    """Calls sink(frame, epoch) with each micro-batch in seq order; replays after a failure are told by the epoch."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(df.orderBy("seq"), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
