"""The hygiene rule chain: cleaning, ordered filters, duplicate recordings.

All filters are one CASE expression, because a row counts under the first rule
that it breaks. Duplicate recordings are found among the rows that pass: per key
the first row is a minimum, which aggregates before the shuffle and so bears hot
keys. Reports come from verdicts(), which judges each row once and stores what it
found without the text; judged() has the texts, too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspool.functions import text as T
from larkspool.plans.storage import spread_lookup, stored
from larkspool.schema import number, reasons, speaker_key


@dataclass(frozen=True)
class Policy:
    """What is fixed and what is dropped; a limit of None is off."""

    clean: bool = True
    # The corpus's own thresholds and review labels.
    min_words: int = 2
    drop_loops: bool = True
    drop_rate_outliers: bool = True
    rate_min: float = 6.0
    rate_max: float = 25.0
    drop_reasons: tuple[str, ...] = ("asr_cift_gecis_uyusmazligi", "farkli_konusmaci_suphesi")
    max_clip_ratio: float | None = 0.02
    max_music_score: float | None = 0.70
    min_speech_ratio: float | None = 0.70
    min_dnsmos_ovrl: float | None = 2.50
    min_speaker_cosine: float | None = 0.55
    drop_duplicates: bool = True
    fragments: str = "mark"  # mark, drop or keep
    verbalize: bool = False

    def with_reasons(self, keep: tuple[str, ...] = (), add: tuple[str, ...] = ()) -> Policy:
        """The drop reasons without keep and with add."""
        kept = tuple(r for r in self.drop_reasons if r not in keep)
        return Policy(**{**self.__dict__, "drop_reasons": tuple(dict.fromkeys(kept + add))})


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def drop_reason(df: DataFrame, policy: Policy, audio_exists: Column | None = None) -> Column:
    """The first broken rule of each row with columns text and duration, or null."""
    rate = F.length("text") / F.col("duration")
    rules: list[tuple[Column, Column | str]] = [
        (F.col("text") == "", "empty_text"),
        (T.word_count("text") < policy.min_words, "few_words"),
        (F.col("duration") <= 0, "bad_duration"),
    ]
    if policy.drop_loops:
        rules.append((T.asr_loop("text"), "asr_loop"))
    if policy.drop_rate_outliers:
        rules.append((~rate.between(policy.rate_min, policy.rate_max), "rate_outlier"))
    if policy.drop_reasons and _has(df, "review_reasons"):
        hit = F.array_min(F.array_intersect(reasons("review_reasons"), F.array(*map(F.lit, policy.drop_reasons))))
        rules.append((hit.isNotNull(), F.concat(F.lit("reason:"), hit)))
    for name, limit, over, tag in (
        ("quality_clip_ratio", policy.max_clip_ratio, True, "clip"),
        ("quality_music_score", policy.max_music_score, True, "music"),
        ("quality_speech_ratio", policy.min_speech_ratio, False, "speech"),
        ("quality_dnsmos_ovrl", policy.min_dnsmos_ovrl, False, "dnsmos"),
        ("quality_speaker_cosine", policy.min_speaker_cosine, False, "cosine"),
    ):
        if limit is not None and _has(df, name):
            v = number(name)
            rules.append((v.isNotNull() & ~F.isnan(v) & ((v > limit) if over else (v < limit)), f"limit:{tag}"))
    if audio_exists is not None:
        rules.append((~audio_exists, "audio_missing"))
    case = None
    for cond, label in rules:
        value = F.lit(label) if isinstance(label, str) else label
        case = F.when(cond, value) if case is None else case.when(cond, value)
    return case


def _ruled(df: DataFrame, policy: Policy, audio_exists: Column | None) -> DataFrame:
    """df with cleaned text, speaker_key, fragment flags and the row's own rules."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = df.withColumn("_raw", raw).withColumn("text", T.clean_text("_raw") if policy.clean else F.col("_raw"))
    df = df.withColumn("text_fixed", F.col("text") != F.col("_raw")).drop("_raw")
    df = df.withColumn("duration", F.coalesce(number("duration"), F.lit(0.0))).withColumn("speaker_key", speaker_key())
    df = df.withColumn("drop_reason", drop_reason(df, policy, audio_exists))
    return df.withColumns({"frag_start": T.fragment_start("text"), "frag_end": T.fragment_end("text")})


def _without_copies(df: DataFrame, keys: list[str], order: str, policy: Policy) -> DataFrame:
    """df with the reasons of duplicate recordings and fragments."""
    if policy.drop_duplicates:
        passed = df.where("drop_reason is null")
        first = passed.groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        again = F.when(F.col(order) > F.col("_first"), F.lit("duplicate_recording"))
        # only rows that passed meet the keys, and only keys of several rows
        passed = spread_lookup(passed, first, keys, F.col(order)).withColumn("drop_reason", again).drop("_first")
        df = passed.unionByName(df.where("drop_reason is not null"))
    if policy.fragments == "drop":
        df = df.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (F.col("frag_start") | F.col("frag_end")), "fragment").otherwise(F.col("drop_reason")))
    return df


def judged(df: DataFrame, policy: Policy = Policy(), order: tuple[str, ...] = ("id",), audio_exists: Column | None = None) -> DataFrame:
    """df with cleaned text, speaker_key, frag_start, frag_end, text_fixed and
    drop_reason (null: kept). order: columns that say which row came first; all
    inputs of a run are to be in one frame, so that the first wins over all."""
    df = _ruled(df, policy, audio_exists).withColumns({"_k": F.struct("speaker_key", "text", F.round("duration", 1)), "_ord": F.struct(*order)})
    return _without_copies(stored(df) if policy.drop_duplicates else df, ["_k"], "_ord", policy).drop("_k", "_ord")


def verdicts(df: DataFrame, policy: Policy = Policy(), order: tuple[str, ...] = ("id",), keep: tuple[str, ...] = ("source_split",), audio_exists: Column | None = None) -> DataFrame:
    """judged() without the texts: keep, duration, flags and drop_reason. Rows are
    judged once and stored; recordings are told apart by 128 bits of hashes."""
    key = ("speaker_key", "text", F.round("duration", 1))
    rows = _ruled(df, policy, audio_exists)
    cols = [c for c in keep if c in df.columns]
    rows = rows.select(*cols, "duration", "text_fixed", "frag_start", "frag_end", "drop_reason", F.struct(*order).alias("_ord"), F.xxhash64(*key).alias("_k1"), F.xxhash64(F.lit(1), *key).alias("_k2"))
    return _without_copies(stored(rows), ["_k1", "_k2"], "_ord", policy).drop("_k1", "_k2", "_ord")


def kept(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The rows of judged() that stay, verbalised last if the policy says so."""
    out = df.where("drop_reason is null").drop("drop_reason", "text_fixed")
    if policy.fragments != "mark":
        out = out.drop("frag_start", "frag_end")
    if policy.verbalize:
        from larkspool.functions.verbal import prepare

        out = out.withColumn("text", prepare("text"))
    return out


def report(df: DataFrame) -> DataFrame:
    """metric, n: kept, each drop reason, fixed texts, and fragments among the
    rows that reached that step. One aggregate by reason has them all; most common
    first is report_order()."""
    reached = F.col("drop_reason").isNull() | (F.col("drop_reason") == "fragment")
    few = df.groupBy("drop_reason").agg(F.count("*").alias("n"), F.count_if("text_fixed").alias("fixed"), F.count_if(reached & F.col("frag_start")).alias("fs"), F.count_if(reached & F.col("frag_end")).alias("fe"))
    name = F.coalesce(F.concat(F.lit("dropped:"), "drop_reason"), F.lit("kept"))
    parts = F.array(*(F.struct(m.alias("metric"), F.col(c).alias("n")) for m, c in ((name, "n"), (F.lit("fixed:text"), "fixed"), (F.lit("fragment:start"), "fs"), (F.lit("fragment:end"), "fe"))))
    return few.select(F.explode(parts).alias("p")).groupBy("p.metric").agg(F.sum("p.n").alias("n"))


def report_order(report_: DataFrame) -> DataFrame:
    """The counters, most common first."""
    return report_.orderBy(F.desc("n"), "metric")


def by_source(df: DataFrame, source: str = "source_split") -> DataFrame:
    """Per source and in total (null): rows in, kept, dropped, hours kept."""
    ok = F.col("drop_reason").isNull()
    return df.rollup(source).agg(
        F.count("*").alias("rows_in"),
        F.count_if(ok).alias("kept"),
        F.count_if(~ok).alias("dropped"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("duration"))), F.lit(0.0)) / 3600, 4).alias("hours_kept"),
    )
