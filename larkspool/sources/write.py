"""Sinks. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(df: DataFrame, path: str) -> None:
    """JSON lines; characters stay as they are, nulls are left out."""
    df.write.mode("overwrite").json(path)


def codes(df: DataFrame, path: str, per_file: int = 4096) -> None:
    """id, codes as Parquet, so many rows a file."""
    df.select("id", "codes").write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)


def packed(sequences: DataFrame, index: DataFrame, stats: DataFrame, path: str) -> None:
    """Each sequence once, the index with its repetitions apart, one row of stats."""
    sequences.where("status = 'ok'").select("id", "kind", "tokens").write.mode("overwrite").parquet(f"{path}/tokens")
    index.write.mode("overwrite").parquet(f"{path}/index")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def fine_tuning(df: DataFrame, files: DataFrame, path: str) -> None:
    """audio, text, ref_audio of the rows whose two files are there."""
    have = files.select(F.col("path").alias("_f"))
    out = df.join(have, df["audio"] == F.col("_f"), "left_semi").join(have, F.col("ref_audio") == F.col("_f"), "left_semi")
    out.select("audio", "text", "ref_audio").write.mode("overwrite").json(path)


def audit_markdown(summary: DataFrame, rows: int) -> str:
    """The findings (one row per rule, so few) as a table."""
    from larkspool.operators.audit import report_order

    lines = [f"{rows:,} rows", "", "| severity | rule | n | percent |", "|---|---|---:|---:|"]
    lines += [f"| {r.severity} | {r.rule} | {r.n:,} | {r.percent:.2f} |" for r in report_order(summary).collect()]
    return "\n".join(lines)


def files(df: DataFrame, folder: str) -> DataFrame:
    """df: name, content. One file a row in a folder that all executors reach; runs
    when an action is called. A file that is there is left as it is; one is written
    beside its place and moved there, so a lost task leaves no half file. Returns
    name, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            names, new = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content"), strict=True):
                path = f"{root}/{name}"
                new.append(content.is_valid and fs.get_file_info(path).type == FileType.NotFound)
                if new[-1]:
                    part = f"{root}/.{name}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(part) as out:
                        out.write(content.as_py())
                    fs.move(part, path)
            yield pa.RecordBatch.from_pydict({"name": names, "written": new}, pa.schema([("name", pa.string()), ("written", pa.bool_())]))

    return df.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, written boolean")


def clips(audio: DataFrame, needed: DataFrame, folder: str, suffix: str = ".flac") -> DataFrame:
    """The files of the clips that are needed (id): their audio bytes under their id."""
    want = audio.join(needed.select("id").distinct(), "id", "left_semi").where("audio is not null")
    return files(want.select(F.concat(F.col("id").cast("string"), F.lit(suffix)).alias("name"), F.col("audio").alias("content")), folder)


def evaluation(results: DataFrame, summary: DataFrame, path: str, checkpoint: str) -> None:
    """Summary and results of a checkpoint as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/{checkpoint}/summary")
    results.write.mode("overwrite").json(f"{path}/{checkpoint}/results")


def audits(by_split: dict[str, DataFrame], cross: DataFrame, path: str) -> None:
    """Findings of each split, and the leakage between splits, as JSON lines."""
    for split, summary in by_split.items():
        summary.coalesce(1).write.mode("overwrite").json(f"{path}/{split}")
    cross.coalesce(1).write.mode("overwrite").json(f"{path}/cross")
