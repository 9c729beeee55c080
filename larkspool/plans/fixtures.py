"""Views over the driver's tables on which the operators run: the same SQL in
Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from larkspool.plans.storage import widened

TABLES = ("documents", "labels", "embeddings", "benchmark", "events", "conversations", "pages")

MANIFEST = """
select d.doc_id as id, d.text, d.lang as source_split, d.source as channel,
  cast(d.n_chars as double)/(4.0e0 + d.n_chars % 23) as duration,
  case when d.n_chars % 7 = 0 then null when d.n_chars % 7 = 1 then 'None'
       else concat('spk', cast(d.n_chars % 50 as string)) end as speaker_id,
  concat('rec', cast(d.doc_id % 40 as string)) as source_id,
  case when l.toxic = 1 then 'speaker_mismatch'
       when l.quality = 0 then 'synthetic_suspect' end as review_reasons,
  (d.doc_id % 50)/2000.0e0 as quality_clip_ratio,
  (d.doc_id % 31)/40.0e0 as quality_music_score,
  0.65e0 + (d.doc_id % 29)/80.0e0 as quality_speech_ratio,
  case when d.doc_id % 13 = 0 then null else 2.4e0 + (d.doc_id % 17)/14.0e0 end as quality_dnsmos_ovrl,
  0.5e0 + (d.doc_id % 23)/50.0e0 as quality_speaker_cosine,
  (d.doc_id % 5)/100.0e0 as quality_asr_cer,
  case when d.doc_id % 11 = 0 then null else -32.0e0 + (d.doc_id % 37)/2.0e0 end as quality_lufs,
  case when d.doc_id % 3 = 0 then d.doc_id + 6 end as ref_id
from documents d left join labels l on d.doc_id = l.doc_id
"""

PAIRING = "select vec_id as id, label as channel, vec_id % 7 as source_id, embedding from embeddings"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widened(df) if name in ("documents", "conversations") else df


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view over the tables that it names; nothing is registered."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)}
    return spark.sql(re.sub(rf"\b(from|join) ({'|'.join(used)})\b", r"\1 {\2}", sql), **used)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MANIFEST)
