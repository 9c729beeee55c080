"""Resumable ingestion: a file stream that runs over what is there and stops.

The checkpoint takes the place of done-markers: a shard that was committed isn't
read again, and a run that broke off goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def available(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is available to a Parquet table, exactly once."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def first_of_key(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the delay; state older than that goes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def distinct_keys(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key over the whole stream; the state has all keys."""
    return stream.dropDuplicates(keys)
