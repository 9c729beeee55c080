"""Manifest audit: findings, distributions, character inventory, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspool.functions import text as T
from larkspool.plans.storage import spread_lookup, stored
from larkspool.schema import known, number

# The alphabet and the punctuation that texts may have.
LOWER = "abcçdefgğhıijklmnoöprsştuüvyzâîû"
UPPER = "ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZÂÎÛ"
FOREIGN = "qwxQWX"
PUNCTUATION = " .,!?:;-'\"()%&/…"

#: severity, rule
RULES = {
    "empty_text": "BLOCK", "few_words": "BLOCK", "bad_duration": "BLOCK", "repeated_text": "BLOCK", "asr_loop": "BLOCK", "high_cer": "BLOCK",
    "doubled_apostrophe": "FIX", "straight_quote": "FIX", "ellipsis": "FIX", "curly_quote": "FIX", "digits": "FIX", "outer_space": "FIX", "double_space": "FIX", "not_composed": "FIX", "odd_character": "FIX", "lower_start": "FIX", "no_terminal": "FIX",
    "apostrophe_and_quote": "INFO", "foreign_letter": "INFO", "mostly_upper": "INFO",
    "ref_missing": "BLOCK", "ref_self": "BLOCK",
    "clip_ratio": "FIX", "speech_ratio": "FIX", "music_score": "FIX", "dnsmos": "FIX", "speaker_cosine": "FIX",
    "rate_outlier": "BLOCK",
}


def row_rules() -> dict[str, Column]:
    """The rules that look at one row alone."""
    t, first, last = F.col("text"), F.substring(F.col("_bare"), 1, 1), F.right(F.col("_bare"), F.lit(1))
    dur = F.col("_dur")
    rate = F.length(t) / dur

    def over(name, limit):
        return number(name) > limit

    def under(name, limit):
        return number(name) < limit

    letters, capitals = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    return {
        "few_words": F.regexp_count(t, F.lit(f"[{LOWER}{UPPER}{FOREIGN}0-9]+")) < 2,
        "bad_duration": dur <= 0,
        "asr_loop": T.asr_loop(t),
        "high_cer": over("quality_asr_cer", 0.15),
        "doubled_apostrophe": t.contains("''"),
        "straight_quote": t.contains('"'),
        "ellipsis": t.contains("…"),
        "curly_quote": t.rlike("[“”‘’«»„]"),
        "digits": T.has_digits(t),
        "outer_space": t.rlike(r"(?U)^\s|\s$"),
        "double_space": t.rlike(r"(?U)\s{2,}"),
        "not_composed": T.nfc(t) != t,
        "odd_character": t.rlike(f"[^{LOWER}{UPPER}{FOREIGN} .,!?:;\\-'\"()%&/…\\p{{Nd}}\\p{{No}}]"),
        "lower_start": first.rlike(f"[\\p{{L}}&&[^{UPPER}{FOREIGN.upper()}]]"),
        "no_terminal": ~last.isin(*".!?\"'"),
        "apostrophe_and_quote": t.rlike(f"[{LOWER}{UPPER}]'[{LOWER}]") & t.contains("''"),
        "foreign_letter": t.rlike(f"[{FOREIGN}]"),
        "mostly_upper": (letters > 0) & (capitals / F.greatest(letters, F.lit(1)) > 0.6),
        "clip_ratio": over("quality_clip_ratio", 0.01),
        "speech_ratio": under("quality_speech_ratio", 0.5),
        "music_score": over("quality_music_score", 0.5),
        "dnsmos": under("quality_dnsmos_ovrl", 2.5),
        "speaker_cosine": under("quality_speaker_cosine", 0.5),
        "rate_outlier": F.when(dur > 0, (rate < 6) | (rate > 25)),
    }


def findings(df: DataFrame) -> DataFrame:
    """id, rule, severity: a row for each rule that a row breaks. The first row of a
    text (by id) isn't a repeat. Rows without text have one finding.

    A row's own rules are tried once and stored beside its reference and a 128-bit
    hash of its text; repeats and references are joined to that."""
    rows = df.withColumns({"text": F.coalesce("text", F.lit("")), "_ref": known("ref_id"), "_dur": F.coalesce(number("duration"), F.lit(0.0))})
    rows = rows.withColumn("_bare", F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    hit = F.array_compact(F.array(*(F.when(cond, F.lit(rule)) for rule, cond in row_rules().items())))
    rows = stored(rows.select("id", "_ref", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2"), (F.col("_bare") == "").alias("_blank"), hit.alias("_hit")))
    told = rows.where("not _blank")
    own = rows.select("id", F.explode(F.when(F.col("_blank"), F.array(F.lit("empty_text"))).otherwise(F.col("_hit"))).alias("rule"))
    first = told.groupBy("_h1", "_h2").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = spread_lookup(told.select("id", "_h1", "_h2"), first, ["_h1", "_h2"], F.col("id")).where("id > _first").select("id", F.lit("repeated_text").alias("rule"))
    asked = told.where("_ref is not null")
    ids = rows.select(F.col("id").cast("string").alias("_ref")).distinct()
    missing = asked.join(ids, "_ref", "left_anti").select("id", F.lit("ref_missing").alias("rule"))
    self_ = asked.where(F.col("_ref") == F.col("id").cast("string")).select("id", F.lit("ref_self").alias("rule"))
    severity = F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv))
    return own.unionByName(again).unionByName(missing).unionByName(self_).withColumn("severity", severity[F.col("rule")])


def summary(df: DataFrame, examples: int = 5) -> DataFrame:
    """rule, severity, n, percent of rows, examples (the first ids)."""
    total = df.agg(F.count("*").alias("_total"))
    found = stored(findings(df))
    order = Window.partitionBy("rule", "_salt").orderBy("id")
    # the first ids of hash splits first: one rule may hold most rows
    few = found.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= examples)
    few = few.groupBy("rule").agg(F.slice(F.array_sort(F.collect_list("id")), 1, examples).alias("examples"))
    counts = found.groupBy("rule", "severity").agg(F.count("*").alias("n"))
    return counts.join(few, "rule").crossJoin(F.broadcast(total)).withColumn("percent", F.round(F.col("n") * 100 / F.col("_total"), 3)).drop("_total")


def report_order(summary_: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "BLOCK", 0).when(F.col("severity") == "FIX", 1).otherwise(2)
    return summary_.orderBy(rank, F.desc("n"), "rule")


def distributions(df: DataFrame) -> DataFrame:
    """field, mean, p1, p50, p99 of duration, rate and the quality fields."""
    dur = F.coalesce(number("duration"), F.lit(0.0))
    text = F.coalesce("text", F.lit(""))
    filled = ~text.rlike(r"(?U)^\s*$")
    fields = {"duration": dur, "rate": F.when(filled, F.when(dur > 0, F.length(text) / dur).otherwise(0.0))}
    fields |= {c: F.when(filled, number(c)) for c in df.columns if c in ("quality_clip_ratio", "quality_speech_ratio", "quality_music_score", "quality_dnsmos_ovrl", "quality_speaker_cosine")}
    long = df.select(F.stack(F.lit(len(fields)), *(x for k, v in fields.items() for x in (F.lit(k), v))).alias("field", "v")).where("v is not null")
    cut = F.percentile("v", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    out = long.groupBy("field").agg(F.avg("v").alias("mean"), cut.alias("p"))
    return out.select("field", F.round("mean", 4).alias("mean"), *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p1", "p50", "p99"))))


def char_inventory(df: DataFrame) -> DataFrame:
    """char, n of the characters that are neither letters nor digits, and of q, w, x."""
    # only what is counted is exploded
    odd = F.regexp_replace("text", f"[\\p{{L}}\\p{{N}}&&[^{FOREIGN}]]", "")
    return df.where(F.length(odd) > 0).select(F.explode(F.filter(F.split(odd, ""), lambda c: c != "")).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def leakage(train: DataFrame, held: DataFrame, fields: tuple[str, ...] = ("source_id", "speaker_id", "channel", "text")) -> DataFrame:
    """Per field: distinct values in each, in both, and percent of held rows whose
    value is in both. Null counts as a value."""
    total = held.agg(F.count("*").alias("_rows"))
    out = None
    for name in fields:
        a = train.groupBy(F.col(name).alias("v")).agg(F.lit(1).alias("a"))
        b = held.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("b"))
        both = a.join(b, a["v"].eqNullSafe(b["v"]), "full").agg(
            F.count("a").alias("train_values"), F.count("b").alias("held_values"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared_values"), F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("b"))), F.lit(0)).alias("held_rows_covered")
        )
        one = both.crossJoin(total).select(F.lit(name).alias("field"), "train_values", "held_values", "shared_values", "held_rows_covered", F.round(F.try_divide(F.col("held_rows_covered") * 100, F.col("_rows")), 2).alias("percent"))
        out = one if out is None else out.unionByName(one)
    return out
