"""Global shuffle into shards: a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash. Pass two Fisher-Yates shuffles each bucket in memory (the built-in
shuffle() function). Bucket after bucket, the records then are one uniformly
random permutation of the table; position p goes to shard p mod n, slot
p div n, so shards hold equally many rows, give or take one, and copies of a
text are spread like any other rows. DataFrame functions only.

The result depends on the rows, the seed and the sizes alone: bucket b is
partition b, from whose number and the seed shuffle() draws its swaps, and a
bucket's rows are first put in the order of two hashes of all their columns. So
neither the number of shuffle partitions nor the order of arrival matters, and a
task that is run again places its rows as before.

Rows that are alike in every column share a hash. Where more than `alike` of them
do, they are counted, not moved, and numbered when they are dealt, so that they
spread over all buckets.

Defined cases: an empty table gives no rows; null ids and texts are ordinary
values; repeated rows are placed one by one; all columns of the input are kept,
maps included, except that one named like an output column (shard, slot) is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import blocks_for, exclusive_prefix

BUCKET_BYTES = 16 << 20
SHARDS = 40
ALIKE = 1000


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _hashable(df: DataFrame, name: str) -> Column:
    """The column as a value that xxhash64 takes; a map's entries are sorted."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.MapType) and not _has_map(kind.keyType) and not _has_map(kind.valueType):
        return F.array_sort(F.map_entries(df[name]))
    return F.to_json(F.struct(df[name])) if _has_map(kind) else df[name]


def _numbered(rows: DataFrame, alike: int) -> DataFrame:
    """rows (_h1, _h2, _row) with _copy: 0, or the number of one of many alike."""
    key = ["_h1", "_h2"]
    many = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > alike).select(*key)
    if many.limit(1).count() == 0:
        return rows.withColumn("_copy", F.lit(0))
    few = rows.join(many, key, "left_anti").withColumn("_copy", F.lit(0))
    counted = rows.join(many, key, "left_semi").groupBy(*key).agg(F.first("_row").alias("_row"), F.count("*").cast("int").alias("_n"))
    return few.unionByName(counted.select(*key, "_row", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy")))


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, alike: int = ALIKE) -> DataFrame:
    """docs in random order over shards: its columns plus shard and slot."""
    docs = docs.drop("shard", "slot")
    cols = docs.columns
    row_bytes = F.coalesce(F.octet_length(docs["text"]), F.lit(0)) + 16
    buckets = blocks_for(docs.agg(F.sum(row_bytes)).first()[0], bucket_bytes)
    own = [_hashable(docs, c) for c in cols]
    rows = docs.select(F.xxhash64(F.lit(seed), *own).alias("_h1"), F.xxhash64(F.lit(~seed), *own).alias("_h2"), F.struct(*(docs[c] for c in cols)).alias("_row"))
    rows = _numbered(rows, alike).withColumn("_bucket", F.pmod(F.xxhash64("_h2", "_copy"), F.lit(buckets)).cast("int"))
    offsets = exclusive_prefix(rows.select("_bucket", F.lit(1).alias("_one")), "_bucket", "_one", "_offset")
    packed = rows.repartitionById(buckets, F.col("_bucket")).sortWithinPartitions("_h1", "_h2").groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    mixed = packed.select("_bucket", F.shuffle("_rows", seed).alias("_rows"))
    placed = mixed.join(F.broadcast(offsets), "_bucket")  # a row for each bucket
    at = F.col("_offset") + F.col("_i")
    placed = placed.select("_offset", F.posexplode("_rows").alias("_i", "_r"))
    return placed.select(*(F.col("_r")[c].alias(c) for c in cols), F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 17) -> None:
    """Shuffle and write one folder per shard. A shard's files, in the order of
    their names, have its rows in slot order; several tasks write a large shard."""
    out = shuffle_shards(docs, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_global_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return out.select(
        "doc_id",
        (F.length(data) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
