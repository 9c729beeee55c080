"""Prosody buckets: equal-occupancy edges of speaking rate and loudness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.functions.text import char_rate
from larkspool.functions.tokens import bucket_of
from larkspool.schema import number

RATE_BUCKETS, LOUD_BUCKETS = 5, 3
# The edges used where none have been computed.
DEFAULT_RATE = [12.216, 13.136, 13.882, 14.735]
DEFAULT_LOUD = [-24.411, -20.800]


def edges(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row: rate_edges, loud_edges (4 decimals, linear interpolation); null
    where no row has a value. exact=False takes the mergeable sketch instead,
    whose state is bounded at any size."""
    fn = F.percentile if exact else (lambda c, p: F.percentile_approx(c, p, 10000))

    def of(value, n):
        cuts = fn(value, F.array(*(F.lit(i / n) for i in range(1, n))))
        return F.transform(cuts, lambda x: F.round(x, 4))

    rate = char_rate("text", number("duration"))
    return df.agg(of(rate, RATE_BUCKETS).alias("rate_edges"), of(number("quality_lufs"), LOUD_BUCKETS).alias("loud_edges"))


def bucketed(df: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """df with rate_bucket and loud_bucket; found: edges(), else the defaults."""
    if found is None:
        found = df.sparkSession.range(1).select(F.array(*map(F.lit, DEFAULT_RATE)).alias("rate_edges"), F.array(*map(F.lit, DEFAULT_LOUD)).alias("loud_edges"))
    rate = char_rate("text", number("duration"))
    joined = df.crossJoin(F.broadcast(found))  # one row
    return joined.withColumns({"rate_bucket": bucket_of(rate, F.col("rate_edges")), "loud_bucket": bucket_of(number("quality_lufs"), F.col("loud_edges"))}).drop("rate_edges", "loud_edges")


def save(found: DataFrame, path: str) -> None:
    found.withColumns({"rate_buckets": F.lit(RATE_BUCKETS), "loud_buckets": F.lit(LOUD_BUCKETS)}).coalesce(1).write.mode("overwrite").json(path)


def load(spark, path: str) -> DataFrame:
    """The edges that save() wrote; the defaults where there are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.range(1).select(F.array(*map(F.lit, DEFAULT_RATE)).alias("rate_edges"), F.array(*map(F.lit, DEFAULT_LOUD)).alias("loud_edges"))
    return spark.read.schema("rate_edges array<double>, loud_edges array<double>").json(path)
