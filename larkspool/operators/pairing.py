"""Nearest neighbours within a group and another source, and pairing reports.

A group's vectors are compared in blocks: each group is split by a hash into
parts of bounded size, and each pair of parts is one task's dense product. A task
keeps the best match of each of its rows only, so no pairs leave it, and a group
that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cosine(a, b):
    """Cosine of two arrays as a Column (null if a length is zero)."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def nearest_in_group(df: DataFrame, min_sim: float = 0.70, rows_per_part: int = 2000, dim: int | None = None) -> DataFrame:
    """df: id, channel, source_id, embedding. One row per id whose best match in
    its channel with another source reaches min_sim: id, ref_id, ref_sim (4
    decimals). Ties go to the smallest id; vectors of another size are left out."""
    rows = df.select("id", "channel", "source_id", "embedding").where("embedding is not null")
    if dim is not None:
        rows = rows.where(F.size("embedding") == dim)
    counts = rows.groupBy("channel").agg(F.ceil(F.count("*") / rows_per_part).cast("int").alias("parts"))
    rows = rows.join(counts, "channel").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = rows.select("channel", "part", every.alias("other"), "id", "source_id", "embedding")
    right = rows.select(F.col("channel").alias("channel"), every.alias("part"), F.col("part").alias("other"), *(F.col(c).alias(c) for c in ("id", "source_id", "embedding")))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "sim": [], "ref": []})
        x, y = (np.array(t.embedding.tolist(), np.float64) for t in (a, b))
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
        order = np.argsort(b.id.to_numpy(), kind="stable")
        y, ids, src = y[order], b.id.to_numpy()[order], b.source_id.to_numpy()[order]
        sim = np.round(x @ y.T, 12)
        sim[a.source_id.to_numpy()[:, None] == src[None, :]] = -2.0
        k = sim.argmax(axis=1)
        s = sim[np.arange(len(a)), k]
        ok = s > -2.0
        return pd.DataFrame({"id": a.id.to_numpy()[ok], "sim": s[ok], "ref": ids[k][ok]})

    kind = df.schema["id"].dataType.simpleString()
    keys = ["channel", "part", "other"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"id {kind}, sim double, ref {kind}")
    # most similar, then the smallest id
    top = found.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("n"), F.col("ref").alias("ref"))).alias("t"))
    return top.select("id", F.col("t.ref").alias("ref_id"), F.round(-F.col("t.n"), 4).alias("ref_sim")).where(F.col("ref_sim") >= min_sim)


def pairing_report(paired: DataFrame, total: DataFrame) -> DataFrame:
    """One row: rows, pairs, percent, and the similarity's mean and deciles."""
    cut = F.percentile("ref_sim", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    a = paired.agg(F.count("*").alias("pairs"), F.round(F.avg("ref_sim"), 4).alias("mean_sim"), cut.alias("p"))
    b = total.agg(F.count("*").alias("rows_in"))
    return a.crossJoin(b).select("rows_in", "pairs", F.round(F.try_divide(F.col("pairs") * 100, F.col("rows_in")), 2).alias("percent"), "mean_sim", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


def with_embedding(manifest: DataFrame, vectors: DataFrame) -> DataFrame:
    """Manifest rows beside the vector of their channel and clip times; vector is
    null where there is none. vectors: channel, start_ms, end_ms, embedding; of
    several the last by clip id counts."""
    from larkspool.functions.text import parse_clip_id

    last = vectors.groupBy("channel", "start_ms", "end_ms").agg(F.max_by("embedding", "clip_id").alias("embedding"))
    at = parse_clip_id("id")
    m = manifest.withColumns({"start_ms": at["start_ms"], "end_ms": at["end_ms"]})
    return m.join(last, ["channel", "start_ms", "end_ms"], "left")
