"""Sorted runs and the write-ahead log as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlog.model import LOG_SCHEMA

COLUMNS = ("k", "seq", "op", "v")


def schema(binary: bool = False) -> str:
    """The log's schema; binary keys and values are bytes."""
    return LOG_SCHEMA.replace("string", "binary") if binary else LOG_SCHEMA


def write_wal(df: DataFrame, path: str) -> None:
    df.select(*COLUMNS).write.parquet(path)


def scan_wal(spark: SparkSession, paths: list[str], from_seq: int | None = None, binary: bool = False) -> DataFrame:
    """Rows of the given logs, from a sequence number on."""
    out = scan(spark, paths, binary)
    return out if from_seq is None else out.where(F.col("seq") >= from_seq)


def flush(df: DataFrame, path: str, part: Column | None = None, partitions: int | None = None, bloom: bool = True) -> None:
    """Writes a sorted run: ranges of keys, each sorted by key and newest first, with min/max per row group and a Bloom filter on the key. With
    `part`, rows go to a folder for each value of it."""
    keys = [F.col("k").asc(), F.col("seq").desc(), F.col("op").desc()]
    out = df.select(*COLUMNS) if part is None else df.select(*COLUMNS, part.alias("part"))
    out = out.repartitionByRange(partitions, "k") if partitions else out.repartitionByRange("k")
    w = out.sortWithinPartitions(*([F.col("part")] if part is not None else []), *keys).write
    if bloom:
        w = w.option("parquet.bloom.filter.enabled#k", "true")
    (w.partitionBy("part") if part is not None else w).parquet(path)


def scan(spark: SparkSession, paths: list[str], binary: bool = False) -> DataFrame:
    return spark.read.schema(schema(binary)).parquet(*paths) if paths else spark.createDataFrame([], schema(binary))
