"""Metric roll-ups: evaluation summary, held-out loss, ingest status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Means of what is not null per kind, per has_digits and over all (grouping
    sets in one pass): rows, empty (fewer than a frame of tokens), means. An error
    rate that is NaN counts as null."""
    results = results.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("cer", "cer_band") if c in results.columns})
    means = [F.round(F.avg(c), 6).alias(c) for c in ("cer", "cer_band", "spk_cos", "dnsmos_ovrl", "dur_sec") if c in results.columns]
    sets = [[F.col("kind")], [F.col("has_digits")], []]
    grouped = results.groupingSets(sets, "kind", "has_digits")
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col("n_tokens") < 7).alias("empty"), *means)


def heldout_loss(losses: DataFrame) -> DataFrame:
    """losses: checkpoint, step, nll, tokens, one row a batch. Per checkpoint the
    loss, perplexity, whether it is the best so far, and whether it is the last
    before the rounded loss first rises."""
    own = losses.groupBy("checkpoint", "step").agg((F.sum("nll") / F.sum("tokens")).alias("loss"))
    # checkpoints are few: one row each
    w = Window.orderBy("step")
    best = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.lead(F.round("loss", 4)).over(w)
    own = own.withColumns({"best_so_far": F.col("loss") == best, "_rise": after > F.round("loss", 4)})
    first = F.min(F.when(F.col("_rise"), F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return own.select("checkpoint", "step", F.round("loss", 4).alias("loss"), F.round(F.exp("loss"), 4).alias("perplexity"), "best_so_far", F.coalesce(F.col("step") == first, F.lit(False)).alias("turning_point"))


def best_checkpoint(rolled: DataFrame) -> DataFrame:
    return rolled.agg(F.min_by("checkpoint", "loss").alias("checkpoint"), F.min("loss").alias("loss"))


def ingest_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("duration") / 3600, 4).alias("hours"))


# The map of the overall score.
OVERALL_FIT = (-0.06766283, 1.11546468, 0.04602535)


def window_mean(scores: DataFrame) -> DataFrame:
    """scores: id and raw, one row a window. The overall score of the mean."""
    a, b, c = OVERALL_FIT
    x = F.avg("raw")
    return scores.groupBy("id").agg((a * x * x + b * x + c).alias("dnsmos_ovrl"))


def predicted_mos(raw_sig: str, raw_bak: str, raw_ovr: str, fit: dict[str, tuple[float, float, float]]):
    """Quadratic maps of raw quality scores; fit: name to (a, b, c) of a x^2 + b x + c."""
    return {n: F.lit(fit[n][0]) * F.col(c) * F.col(c) + F.lit(fit[n][1]) * F.col(c) + F.lit(fit[n][2]) for n, c in (("sig", raw_sig), ("bak", raw_bak), ("ovr", raw_ovr))}
