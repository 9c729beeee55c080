"""The clip manifest's schema and how loosely typed fields are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "text")]
    + [T.StructField("duration", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("speaker_id", "channel", "source_id", "review_reasons")]
    + [T.StructField(f"quality_{n}", T.DoubleType()) for n in ("clip_ratio", "music_score", "speech_ratio", "dnsmos_ovrl", "speaker_cosine", "asr_cer", "lufs")]
    + [T.StructField("ref_id", T.StringType()), T.StructField("ref_sim", T.DoubleType()), T.StructField("audio", T.StringType()), T.StructField("src", T.StringType()), T.StructField("sr", T.IntegerType())]
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """As a string; "" and "None" count as null."""
    s = col(c).cast("string")
    return F.when(~s.isin("", "None"), s)


def number(c: Column | str) -> Column:
    """As a double; what is no plain number, and NaN, is null. Columns that are
    numbers already aren't parsed (the type test folds away)."""
    x = col(c)
    numeric = F.typeof(x).isin("double", "float", "int", "bigint", "smallint", "tinyint") | F.typeof(x).startswith("decimal")
    direct = x.try_cast("double")
    s = F.trim(known(x))
    parsed = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    return F.when(numeric, F.when(~F.isnan(direct), direct)).otherwise(parsed)


def speaker_key(speaker: Column | str = "speaker_id", channel: Column | str = "channel") -> Column:
    """The speaker, or else the channel in a name space of its own."""
    return F.coalesce(known(speaker), F.concat(F.lit("channel:"), F.coalesce(col(channel).cast("string"), F.lit("None"))))


def reasons(c: Column | str) -> Column:
    """Review reasons as an array: a JSON list, a bare string, or nothing."""
    s = F.trim(col(c).cast("string"))
    listed = F.from_json(s, "array<string>")
    return F.when(s.isNull() | (s == ""), F.array().cast("array<string>")).when(s.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(s))
