"""Subsets, budgets, evaluation sets and reference picks.

Every random choice is an order by md5(seed, key): the same under any
partitioning. Running sums over a whole table go by blocks: sums of hash-range
blocks first, then each block's rows beside its offset, so no window has all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspool.functions.text import hash_order, recording_of
from larkspool.schema import known, number, speaker_key

BEFORE = (Window.unboundedPreceding, -1)


def running_before(df: DataFrame, order: list[Column], value: Column, block: Column, out: str) -> DataFrame:
    """df with the sum of value over all rows before it. block: a value that
    doesn't fall along the order and splits it into many parts."""
    df = df.withColumn("_block", block).withColumn("_value", value)
    within = F.coalesce(F.sum("_value").over(Window.partitionBy("_block").orderBy(*order).rowsBetween(*BEFORE)), F.lit(0))
    sums = df.groupBy("_block").agg(F.sum("_value").alias("_sum"))
    offsets = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(*BEFORE)), F.lit(0)).alias("_before"))
    return df.join(offsets, "_block").withColumn(out, F.col("_before") + within).drop("_block", "_value", "_before")


def quality_floor(df: DataFrame, column: str, percent: float) -> DataFrame:
    """One row: floor, the percentile of a quality column (null without values)."""
    return df.agg(F.percentile(number(column), F.lit(percent / 100)).alias("floor"))


def subset_reason(min_sec=2.0, max_sec=15.0, max_clip=0.005, max_music=0.30, max_cer=0.05) -> Column:
    """The first rule that keeps a row out of a clean subset; expects columns
    dnsmos_floor and speech_floor (null: off)."""

    def under(name, floor):
        return F.coalesce(number(name) < F.col(floor), F.lit(False))

    def over(name, limit):
        return F.coalesce(number(name) > limit, F.lit(False))

    return (
        F.when(~F.coalesce(number("duration"), F.lit(0.0)).between(min_sec, max_sec), "duration")
        .when(F.coalesce(F.col("frag_start") | F.col("frag_end"), F.lit(False)), "fragment")
        .when(under("quality_dnsmos_ovrl", "dnsmos_floor"), "dnsmos")
        .when(under("quality_speech_ratio", "speech_floor"), "speech")
        .when(over("quality_clip_ratio", max_clip), "clip")
        .when(over("quality_music_score", max_music), "music")
        .when(over("quality_asr_cer", max_cer), "cer")
    )


def round_robin(df: DataFrame, target_sec: float, seed: int = 0, cell: tuple[str, ...] = ("rate_bucket", "loud_bucket")) -> DataFrame:
    """Rows picked in turns over cells, in a cell in turns over speakers, until
    their duration reaches the target. Adds pick, the place in the order."""
    df = df.withColumn("_h", hash_order(seed, "id"))
    turn = F.row_number().over(Window.partitionBy(*cell, "speaker_key").orderBy("_h"))
    df = df.withColumn("_turn", turn)
    df = df.withColumn("pick", F.row_number().over(Window.partitionBy(*cell).orderBy("_turn", "speaker_key")))
    order = [F.col("pick"), *(F.col(c).asc_nulls_last() for c in cell)]
    # rows of like turns are a block: as many at most as there are cells
    df = running_before(df, order, F.col("duration"), F.col("pick"), "_sum")
    return df.where(F.col("_sum") < target_sec).drop("_h", "_turn", "_sum")


def with_references(chosen: DataFrame, every: DataFrame) -> DataFrame:
    """chosen and the clips that it refers to (one hop), found among every."""
    refs = chosen.select(known("ref_id").alias("id")).where("id is not null").distinct()
    wanted = refs.join(chosen.select(F.col("id").cast("string").alias("id")), "id", "left_anti").withColumnRenamed("id", "_want")
    added = every.join(wanted, every["id"].cast("string") == F.col("_want"), "left_semi")
    return chosen.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)), allowMissingColumns=True)


def hour_budget(df: DataFrame, budget_sec: float, seed: int = 0) -> DataFrame:
    """Greedy in seeded order: a row that would go over the budget is passed
    over, later ones may still fit.

    Whole rounds: the longest prefix that fits is taken, rows longer than what
    is left are dropped, and the rest is tried again, until nothing changes. A
    round takes the whole prefix, so what is left of the budget is soon small and
    few rows are tried; where long and short rows alternate near its end, rounds
    can be as many as the rows passed over there.
    """
    from larkspool.plans.storage import stored

    rest = df.select("id", F.col("duration").alias("_d"), hash_order(seed, "id").alias("_h")).where(F.col("_d") <= budget_sec)
    left, taken = budget_sec, None
    while True:
        rest = stored(running_before(rest.drop("_sum"), [F.col("_h")], F.col("_d"), F.substring("_h", 1, 3), "_sum"))
        fits = F.col("_sum") + F.col("_d") <= left
        stop = rest.where(~fits).agg(F.min("_h")).first()[0]
        now = rest if stop is None else rest.where(F.col("_h") < stop)
        taken = stored(now.select("id") if taken is None else taken.unionByName(now.select("id")))
        if stop is None:
            return df.join(taken, "id", "left_semi")
        left -= now.agg(F.sum("_d")).first()[0] or 0.0
        rest = rest.where((F.col("_h") >= stop) & (F.col("_d") <= left))


def export_reason(min_sec=1.0, max_sec=30.0, allow_fragments=False, file_there: Column | None = None) -> Column:
    """Why a row isn't exported, or null; expects picked_ref. file_there: whether the
    clip's audio file is there, if that is to be asked."""
    frag = F.lit(False) if allow_fragments else F.coalesce(F.col("frag_start") | F.col("frag_end"), F.lit(False))
    return F.when(~F.col("duration").between(min_sec, max_sec), "duration").when(frag, "fragment").when(F.col("picked_ref").isNull(), "no_reference").when(F.lit(False) if file_there is None else ~file_there, "no_file")


def pick_reference(df: DataFrame, max_ref_sec: float = 15.0, seed: int = 0, tries: int = 8) -> DataFrame:
    """df with picked_ref: the row's own reference if it is there and short
    enough, else another clip of the speaker from another recording. Of each
    speaker the first clips of `tries` hash-picked recordings are tried, so the
    work stays in proportion to the rows whatever the speaker's share."""
    key = speaker_key()
    rows = df.withColumns({"_ref": known("ref_id"), "_spk": key, "_rec": recording_of("src", "id")})
    own = df.select(F.col("id").cast("string").alias("_ref"), F.col("duration").alias("_ref_sec")).where(F.col("_ref_sec") <= max_ref_sec)
    # rows without a reference don't meet: they would be one key
    rows = rows.where("_ref is not null").join(own, "_ref", "left").unionByName(rows.where("_ref is null").withColumn("_ref_sec", F.lit(None).cast("double")))
    pool = rows.where((F.col("duration") <= max_ref_sec) & ~F.col("_spk").rlike("^(review-|emb-|channel:)"))
    first = pool.groupBy("_spk", "_rec").agg(F.min(F.struct(hash_order(seed, "id").alias("h"), F.col("id").cast("string").alias("i"))).alias("c"))
    salt = F.pmod(F.xxhash64("_rec"), F.lit(64))
    few = first.withColumn("_s", salt).withColumn("_n", F.row_number().over(Window.partitionBy("_spk", "_s").orderBy("c.h"))).where(F.col("_n") <= tries)
    few = few.groupBy("_spk").agg(F.slice(F.array_sort(F.collect_list(F.struct("c.h", "c.i", F.col("_rec").alias("r")))), 1, tries).alias("_few"))
    rows = rows.join(few, "_spk", "left")
    other = F.filter("_few", lambda x: (x["r"] != F.col("_rec")) & (x["i"] != F.col("id").cast("string")))
    n = F.size(other)
    turn = F.when(n > 0, F.get(other, (F.conv(F.substring(hash_order(seed + 1, "id"), 1, 7), 16, 10).cast("int") % F.greatest(n, F.lit(1))).cast("int"))["i"])
    picked = F.when(F.col("_ref_sec").isNotNull(), F.col("_ref")).otherwise(turn)
    return rows.withColumn("picked_ref", picked).drop("_ref", "_spk", "_rec", "_ref_sec", "_few")


def evaluation_set(df: DataFrame, banned: DataFrame, plain: int, clone: int, seed: int = 0) -> DataFrame:
    """kind, id, text, has_digits, ref_id: rows of 3 to 15 s that aren't banned,
    so many plain ones and so many whose reference is there."""
    from larkspool.functions.text import has_digits

    usable = df.where(F.col("duration").between(3, 15)).join(banned.select("id").distinct(), "id", "left_anti").withColumn("_h", hash_order(seed, "id"))
    one = usable.orderBy("_h").limit(plain).select(F.lit("plain").alias("kind"), "id", "text", F.lit(None).cast("string").alias("ref_id"))
    ref = known("ref_id")
    there = df.select(F.col("id").cast("string").alias("_there"))
    two = usable.join(there, ref == F.col("_there"), "left_semi").orderBy("_h").limit(clone).select(F.lit("clone").alias("kind"), "id", "text", ref.alias("ref_id"))
    return one.unionByName(two).withColumn("has_digits", has_digits("text"))


def needed_files(df: DataFrame, have: DataFrame) -> DataFrame:
    """id: clips and their references that aren't on disk yet."""
    ids = df.select(F.col("id").cast("string").alias("id")).unionByName(df.select(known("ref_id").alias("id"))).where("id is not null").distinct()
    return ids.join(have.select(F.col("id").cast("string").alias("id")), "id", "left_anti")
