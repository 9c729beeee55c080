"""Training sequences from manifest and codes, offsets, and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.functions import tokens as K
from larkspool.functions.text import hash_order, hash_uniform
from larkspool.operators.select import running_before
from larkspool.schema import known

MAX_LEN = 3072
CLONE_REPEAT = 2
DROPOUT = 0.15


def last_codes(codes: DataFrame) -> DataFrame:
    """One row per id of (id, codes, ordinal): the last."""
    return codes.groupBy("id").agg(F.max_by("codes", "ordinal").alias("codes"))


def with_controls(df: DataFrame, seed: int = 0, dropout: float = DROPOUT) -> DataFrame:
    """rate_token and loud_token; each falls to its "any" with the probability."""
    r = F.when(hash_uniform(seed, F.lit("rate"), "id") >= dropout, F.col("rate_bucket"))
    v = F.when(hash_uniform(seed, F.lit("loud"), "id") >= dropout, F.col("loud_bucket"))
    return df.withColumns({"rate_token": K.rate_token(r), "loud_token": K.loud_token(v)})


def sequences(df: DataFrame, codes: DataFrame, max_len: int = MAX_LEN, repeat: int = CLONE_REPEAT) -> DataFrame:
    """df: id, ref_id, text_ids, rate_token, loud_token, frag_start, frag_end;
    codes: id, codes. One row per id and kind (plain, clone): status (ok,
    miss_audio, miss_ref, too_long), and if ok tokens, length, label_start, times."""
    df = df.withColumn("_ref", known("ref_id"))
    have = df.join(codes, "id", "left")
    marks = K.fragment_tokens("frag_start", "frag_end")
    prompt = K.build_prompt("text_ids", F.col("rate_token"), F.col("loud_token"), fragments=marks)
    plain = have.select("id", F.lit("plain").alias("kind"), F.lit(1).alias("times"), F.when(F.col("codes").isNull(), "miss_audio").alias("status"), K.training_sequence(prompt, "codes").alias("tokens"), F.size(prompt).alias("label_start"))
    ref = df.select(F.col("id").cast("string").alias("_ref"), F.col("text_ids").alias("_ref_text")).join(codes.select(F.col("id").cast("string").alias("_ref"), K.truncated_reference("codes").alias("_ref_codes")), "_ref")
    pair = have.where("_ref is not null").join(ref, "_ref", "left")
    clone_prompt = K.build_prompt(F.concat("_ref_text", "text_ids"), F.col("rate_token"), F.col("loud_token"), F.col("_ref_codes"), marks)
    missing = F.col("codes").isNull() | F.col("_ref_codes").isNull()
    clone = pair.select("id", F.lit("clone").alias("kind"), F.lit(repeat).alias("times"), F.when(missing, "miss_ref").alias("status"), K.training_sequence(clone_prompt, "codes").alias("tokens"), F.size(clone_prompt).alias("label_start"))
    out = plain.unionByName(clone).withColumn("length", F.size("tokens"))
    status = F.coalesce("status", F.when(F.col("length") > max_len, "too_long"), F.lit("ok"))
    ok = F.col("status") == "ok"
    out = out.withColumn("status", status)
    return out.select("id", "kind", "status", *(F.when(ok, F.col(c)).alias(c) for c in ("tokens", "length", "label_start", "times")))


def index(seqs: DataFrame) -> DataFrame:
    """id, kind, length, label_start, times, offset: where each sequence begins in
    the token store, plain ones first, by id. Sequences aren't moved or copied."""
    ok = seqs.where("status = 'ok'").select("id", "kind", "length", "label_start", "times")
    rank = F.when(F.col("kind") == "plain", 0).otherwise(1)
    block = F.struct(rank.alias("k"), F.floor(F.col("id") / 4096).alias("b")) if dict(ok.dtypes)["id"] in ("bigint", "int") else F.struct(rank.alias("k"), F.substring("id", 1, 3).alias("b"))
    return running_before(ok, [rank, F.col("id")], F.col("length"), block, "offset")


def examples(index_: DataFrame, seed: int = 0) -> DataFrame:
    """The index with a row per repetition, and a seeded order."""
    out = index_.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.withColumn("order_key", hash_order(seed, "id", "kind", "copy"))


def at(store: DataFrame, index_: DataFrame, wanted: DataFrame) -> DataFrame:
    """Examples by id and kind: their tokens and where the label starts, by joins on
    the key, so that the store is read once for any number of them."""
    keys = wanted.select("id", "kind").distinct()
    return index_.join(keys, ["id", "kind"], "left_semi").join(store.select("id", "kind", "tokens"), ["id", "kind"]).select("id", "kind", "length", "label_start", "tokens")


def stats(seqs: DataFrame) -> DataFrame:
    """One row; examples, mean_len and p95_len count repetitions, tokens don't."""
    ok, n = F.col("status") == "ok", F.col("times")
    lens = F.when(ok, F.col("length"))
    return seqs.agg(
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("examples"),
        F.count_if(ok & (F.col("kind") == "plain")).alias("plain"),
        F.coalesce(F.sum(F.when(ok & (F.col("kind") == "clone"), n)), F.lit(0)).alias("clone"),
        F.coalesce(F.sum(lens), F.lit(0)).alias("tokens"),
        F.max(lens).alias("max_len"),
        F.round(F.try_divide(F.sum(lens * n), F.sum(F.when(ok, n))), 4).alias("mean_len"),
        # a histogram of lengths, which max_len bounds
        F.floor(F.percentile(lens, F.lit(0.95), F.coalesce(n, F.lit(0)))).cast("long").alias("p95_len"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("miss_audio", "miss_ref", "too_long")),
    )


def token_budget_batches(df: DataFrame, budget: int, seed: int = 0, longest: int | None = None) -> DataFrame:
    """df: id, length. Adds block, batch: in seeded order rows are cut into
    blocks; a block is sorted by length and packed while the longest row times
    the rows stays within the budget. Batches' seeded order is batch_order."""
    top = longest if longest is not None else df.agg(F.max("length")).first()[0]
    if top is None:
        return df.select("id", "length", F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("batch"), F.lit(None).cast("string").alias("batch_order"))
    if top > budget:
        raise ValueError(f"a row of {top} tokens is longer than the budget of {budget}")
    size = 64 * max(1, budget // top)
    df = df.select("id", "length", hash_order(seed, "id").alias("_h"))
    placed = running_before(df, [F.col("_h"), F.col("id")], F.lit(1), F.substring("_h", 1, 3), "_at").withColumn("block", F.floor(F.col("_at") / size))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_h", "id"], kind="stable")
        batch, n, out = 0, 0, []
        for length in rows.length.tolist():  # ascending, so this one is the longest so far
            if n and length * (n + 1) > budget:
                batch, n = batch + 1, 0
            n += 1
            out.append(batch)
        return rows.assign(batch=out)[["id", "length", "block", "batch"]]

    kind = dict(df.dtypes)["id"]
    out = placed.select("id", "length", "block", "_h").groupBy("block").applyInPandas(pack, f"id {kind}, length {dict(df.dtypes)['length']}, block long, batch int")
    return out.withColumn("batch_order", hash_order(seed, "block", "batch"))


def seconds_budget_batches(df: DataFrame, budget_sec: float) -> DataFrame:
    """df: id, shard, duration. Adds batch: in a shard rows go by length; a batch
    ends with the row that reaches the budget."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["duration", "id"], kind="stable")
        batch, held, out = 0, 0.0, []
        for d in rows.duration.tolist():
            out.append(batch)
            held += d
            if held >= budget_sec:
                batch, held = batch + 1, 0.0
        return rows.assign(batch=out)

    kinds = dict(df.dtypes)
    rows = df.select("id", "shard", "duration")
    return rows.groupBy("shard").applyInPandas(pack, f"id {kinds['id']}, shard {kinds['shard']}, duration double, batch int")


def shard_numbers(df: DataFrame, per_shard: int = 4096) -> DataFrame:
    """shard: the place by id divided by the shard size."""
    block = F.floor(F.col("id") / 4096)
    return running_before(df, [F.col("id")], F.lit(1), block, "_at").withColumn("shard", F.floor(F.col("_at") / per_shard)).drop("_at")


