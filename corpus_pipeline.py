"""The corpus pipeline: five stages over documents, each one of the operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspool.llm import decontam, nearcopies, packing, suffixdedup, toxicity

#: Bytes that a Python worker gets or returns at a time, in this session's later
#: queries, too: with long texts, Spark's own 64 MB would be most of its memory.
BATCH = 4 << 20

#: SQL can't express the trained, the hashed and the packing stages.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """Texts go to the workers in batches of BATCH bytes at most; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH:
        spark.conf.set(key, f"{BATCH}b")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold; the classifier learns from labels."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = "_toxicity"
    scored = toxicity.score(docs, toxicity.train(docs, labels), name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash tables over five-word
    shingles, links confirmed by a Jaccard similarity of 0.8."""
    small_batches(spark)
    return nearcopies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that occur elsewhere, too."""
    small_batches(spark)
    return suffixdedup.without_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    small_batches(spark)
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    from larkspool.llm.textops import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
