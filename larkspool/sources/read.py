"""Sources as DataFrames. Paths go to Spark only, so any file system works."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspool.schema import MANIFEST

# Column names and file names of the corpus.
AUDIO_COLUMNS = ("audio", "wav", "speech")
ID_COLUMNS = ("id", "clip_id", "utt_id")
SPLIT_FILE = r"^([a-z_]+)-\d+-of-\d+\.parquet$"


def _children(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def split_base(spark: SparkSession, root: str, split: str) -> str | None:
    """root/data or root, whichever first has files of the split."""
    for base in (f"{root}/data", root):
        if any(n.startswith(f"{split}-") and n.endswith(".parquet") for n in _children(spark, base)):
            return base
    return None


def available_splits(spark: SparkSession, root: str) -> list[str]:
    import re

    names = {m[1] for base in (f"{root}/data", root) for n in _children(spark, base) if (m := re.match(SPLIT_FILE, n))}
    return sorted(names)


def read_split(spark: SparkSession, root: str, split: str, audio: bool = False) -> DataFrame:
    """Rows of a split with _shard, _split and _row (their place in the file). The
    first audio column is left out of the scan unless asked for."""
    base = split_base(spark, root, split)
    if base is None:
        raise ValueError(f"no files of split {split} under {root}")
    df = spark.read.option("pathGlobFilter", f"{split}-*.parquet").parquet(base)
    skip = next((c for c in AUDIO_COLUMNS if c in df.columns), None)
    cols = [c for c in df.columns if audio or c != skip]
    return df.select(*cols, F.col("_metadata.file_name").alias("_shard"), F.lit(split).alias("_split"), F.col("_metadata.row_index").alias("_row"))


def read_audio(spark: SparkSession, root: str, split: str, keep: DataFrame | None = None) -> DataFrame:
    """id and audio of the split, of the kept ids only if given."""
    df = read_split(spark, root, split, audio=True)
    i = next((c for c in ID_COLUMNS if c in df.columns), None)
    a = next((c for c in AUDIO_COLUMNS if c in df.columns), None)
    if i is None or a is None:
        raise ValueError("no id or audio column")
    df = df.select(F.col(i).alias("id"), F.col(a).alias("audio"))
    return df if keep is None else df.join(keep.select("id").distinct(), "id", "left_semi")


def read_jsonl(spark: SparkSession, *paths: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """Manifest lines; blank lines are skipped."""
    return spark.read.schema(schema).json(list(paths))


def load_rows(spark: SparkSession, source: str, split: str | None = None) -> DataFrame:
    """A folder of Parquet splits (the split is needed) or a JSON-lines file."""
    if source.endswith((".json", ".jsonl")) or not _children(spark, source) or _children(spark, source) == [source.rsplit("/", 1)[-1]]:
        return read_jsonl(spark, source)
    if not split:
        raise ValueError("a folder needs a split")
    return read_split(spark, source, split)


def union_splits(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows with source_split and source_ord, in the order given."""
    out = None
    for k, (name, df) in enumerate(frames.items()):
        one = df.withColumns({"source_split": F.lit(name), "source_ord": F.lit(k)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def last_by_id(df: DataFrame, *order: str) -> DataFrame:
    """One row per id: the last by the order columns."""
    row = F.struct(*(c for c in df.columns))
    return df.groupBy("id").agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def clip_vectors(clips: DataFrame, vectors: DataFrame, decision: str) -> DataFrame:
    """Clips of a decision beside their vectors; vectors of another size than
    `dimensions` says are left out."""
    v = vectors.where(F.size("vector") == F.col("dimensions")).select("clip_id", F.col("vector").alias("embedding"))
    c = clips.where(F.col("decision") == decision)
    ms = {"start_ms": F.round(F.col("start_sec") * 1000).cast("long"), "end_ms": F.round(F.col("end_sec") * 1000).cast("long")}
    return c.join(v, c["id"] == v["clip_id"]).select("clip_id", "channel", "source_id", "embedding", *(e.alias(k) for k, e in ms.items()))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def audio_bytes(df: DataFrame, folder: str | None = None) -> DataFrame:
    """audio (struct of bytes and path, binary, or a path) as binary: the bytes, or
    else the content of the path's file, read by Spark's binary source from folder
    (files are known by their name); null where there is neither."""
    kind = df.schema["audio"].dataType
    if isinstance(kind, T.BinaryType):
        return df
    cell = F.col("audio.bytes") if isinstance(kind, T.StructType) else F.lit(None).cast("binary")
    path = F.col("audio.path") if isinstance(kind, T.StructType) else F.col("audio")
    df = df.withColumns({"_bytes": cell, "_file": F.when(cell.isNull(), F.regexp_extract(path, r"([^/]+)$", 1))})
    if folder is None:
        return df.withColumn("audio", F.col("_bytes")).drop("_bytes", "_file")
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_file"), "content").dropDuplicates(["_file"])
    asked = df.where("_file is not null").join(files, "_file", "left")
    held = df.where("_file is null").withColumn("content", F.lit(None).cast("binary"))
    return held.unionByName(asked).withColumn("audio", F.coalesce("_bytes", "content")).drop("_bytes", "_file", "content").select(*df.drop("_bytes", "_file").columns)


def code_shards(spark: SparkSession, folder: str) -> DataFrame:
    """id, codes, ordinal of all code shards under the folder, at any depth; ordinal
    follows file name and row, so that the last of an id counts (last_codes)."""
    try:
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    except Exception as e:
        raise ValueError(f"no code shards under {folder}") from e
    return df.select("id", "codes", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("ordinal"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.flac") -> DataFrame:
    """id (the file's stem) and audio of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("id"), F.col("content").alias("audio"))


def with_model(df: DataFrame, load, call, schema: str) -> DataFrame:
    """Rows through a model hook: load() once a task, call(model, batch) -> batch.
    For codecs, quality scores, speaker vectors and recognisers, none of which is
    part of this library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            yield call(model, batch)

    return df.mapInArrow(run, schema)


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """checkpoint, step: checkpoint-N folders by number, `final` last."""
    names = [n for n in _children(spark, folder)]
    df = spark.createDataFrame([(n,) for n in names], "checkpoint string")
    step = F.when(F.col("checkpoint") == "final", F.lit(2**62)).otherwise(F.regexp_extract("checkpoint", r"^checkpoint-(\d+)$", 1).try_cast("long"))
    return df.withColumn("step", step).where("step is not null").orderBy("step")
