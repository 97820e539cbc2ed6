"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset and Spark runs in one process, a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="ordlog-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def saved(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: later stages don't recompute them and survive lost executors. It goes when the
    driver's JVM ends, or by discard."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ordlog/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a saved table that nothing will read again."""
    fs, p = _at(df.sparkSession, df.saved_at)
    fs.delete(p, True)


def free(df: DataFrame, name: str) -> str:
    """The name, or it with underscores before it, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
