"""Rows of a foreign corpus on their way in: defaults, quality gate, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspool.functions import signal
from larkspool.schema import col


def given(c: Column | str) -> Column:
    """As a string; "" counts as null."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def with_defaults(df: DataFrame, id_: str = "id", speaker: str | None = None, source: str | None = None, constant: str = "") -> DataFrame:
    """speaker_id: the constant, or else the column, or else ""; src: the trimmed
    column, or else the row's own id, so that it blocks no reference."""
    who = F.lit(constant) if constant else F.coalesce(given(speaker), F.lit("")) if speaker else F.lit("")
    where = F.coalesce(given(F.trim(col(source).cast("string"))), col(id_).cast("string")) if source else col(id_).cast("string")
    return df.withColumns({"speaker_id": who, "src": where})


def for_pairing(df: DataFrame) -> DataFrame:
    """Defaults of rows that get references by vectors: channel "", source the id,
    speaker emb-<channel>."""
    channel = F.coalesce(F.col("channel").cast("string"), F.lit(""))
    return df.withColumns(
        {
            "channel": channel,
            "source_id": F.coalesce(given("src"), F.col("id").cast("string")),
            "speaker_id": F.coalesce(given("speaker_id"), F.concat(F.lit("emb-"), channel)),
        }
    )


def gate_status(kept: Column, score: Column | str, least: float) -> Column:
    """hygiene, dnsmos or kept: what the row stopped at. The score is asked after
    hygiene; a row without one passes."""
    return F.when(~F.coalesce(kept, F.lit(False)), "hygiene").when(F.coalesce(col(score) < least, F.lit(False)), "dnsmos").otherwise("kept")


def clip_path(folder: str, id_: Column | str, old: Column | str, suffix: str = ".flac") -> Column:
    """The clip's file in the folder; a row without an id keeps the path it has."""
    i = given(id_)
    return F.when(i.isNull(), col(old)).otherwise(F.concat(F.lit(f"{folder.rstrip('/')}/"), i, F.lit(suffix)))


def with_new_paths(df: DataFrame, folder: str) -> DataFrame:
    """audio and ref_audio in the folder, by id and ref_id."""
    return df.withColumns({"audio": clip_path(folder, "id", "audio"), "ref_audio": clip_path(folder, "ref_id", "ref_audio")})


def checked_samples(df: DataFrame, rate: int = signal.SPEECH_RATE) -> DataFrame:
    """id, duration, samples of WAV audio (binary); fails on a row of another rate
    or format."""
    df = df.withColumn("_w", signal.decoded("audio"))
    wrong = F.raise_error(F.format_string(f"clip %s isn't WAV at {rate} Hz", F.col("id").cast("string"))).cast("array<double>")
    return df.select("id", "duration", F.when(F.coalesce(F.col("_w.rate") == rate, F.lit(False)), F.col("_w.samples")).otherwise(wrong).alias("samples"))


def telephony(df: DataFrame, laws: tuple[str, ...] = ("u", "a")) -> tuple[DataFrame, DataFrame]:
    """df: id, rate, samples. The files (name, content): one WAV at 8 kHz for each
    law, and a 16 kHz copy of what the first law gives back; and the figures (id,
    seconds, above_band, snr)."""
    for law in laws:
        if law not in ("u", "a"):
            raise ValueError(f"unknown law {law}")
    low = F.transform(signal.at_rate("samples", "rate", signal.TELEPHONE_RATE), lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    rows = df.withColumn("low", low)
    tags = {"u": signal.MU_LAW, "a": signal.A_LAW}
    name = F.concat(F.col("id").cast("string"), F.lit("_g711"))
    made = [F.struct(F.concat(name, F.lit(f"{law}.wav")).alias("name"), signal.wav("low", signal.TELEPHONE_RATE, tags[law]).alias("content")) for law in laws]
    back = signal.at_rate(signal.through_law("low", laws[0]), F.lit(signal.TELEPHONE_RATE), signal.SPEECH_RATE)
    made.append(F.struct(F.concat(name, F.lit(f"{laws[0]}_16k.wav")).alias("name"), signal.wav(back, signal.SPEECH_RATE).alias("content")))
    files = rows.select(F.explode(F.array(*made)).alias("f")).select("f.*")
    figures = rows.select("id", (F.size("samples") / F.col("rate")).alias("seconds"), signal.energy_above("samples", "rate").alias("above_band"), signal.law_snr("low", laws[0]).alias("snr"))
    return files, figures
