"""Intermediate tables in the folder that the cluster shares, and joins on hot keys."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list = []


def _forget() -> None:
    for spark, path in _written:
        try:
            fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)
        except Exception:  # the session may have ended before
            pass


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of our own
    serves a local master only; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
    return (top or "/tmp/checkpoints").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path there; it goes when the driver exits."""
    path = f"{shared_folder(spark)}/larkspool-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written under spark.checkpoint.dir and read back: cuts the lineage and
    outlives executors."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: a small table
    is often one file, which would keep one core busy. A large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def spread_lookup(rows: DataFrame, table: DataFrame, keys: list[str], salt: Column, parts: int = 512) -> DataFrame:
    """rows left-joined with table, which has one row for each key. A key may have any
    share of the rows: the pairs of key and salt that occur meet the table first."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    pairs = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(pairs, [*keys, "_salt"], "left").drop("_salt")
