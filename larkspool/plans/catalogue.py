"""Named queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspool.functions import signal
from larkspool.functions import text as T
from larkspool.functions import tokens as K
from larkspool.functions import verbal
from larkspool.operators import audit, hygiene, intake, metrics, packing, pairing, prosody, select
from larkspool.plans import oracles
from larkspool.plans.fixtures import PAIRING, manifest, table, view
from larkspool.plans.storage import new_path
from larkspool.schema import known, number, speaker_key
from larkspool.sources.read import clip_vectors, union_splits
from larkspool.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = oracles.SQL

POLICY = hygiene.Policy(drop_reasons=("speaker_mismatch", "synthetic_suspect"))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _verdicts(spark, sf_dir, policy=POLICY):
    return hygiene.verdicts(manifest(spark, sf_dir), policy)


def _judged(spark, sf_dir):
    return hygiene.judged(manifest(spark, sf_dir), POLICY)


@query
def hygiene_report(spark, sf_dir):
    return hygiene.report(_verdicts(spark, sf_dir))


@query
def hygiene_by_source(spark, sf_dir):
    return hygiene.by_source(_verdicts(spark, sf_dir))


@query
def hygiene_kept(spark, sf_dir):
    return hygiene.kept(_judged(spark, sf_dir), POLICY).select("id", "speaker_key", "frag_start", "frag_end", F.md5("text").alias("text_md5"))


@query
def hygiene_drop_fragments(spark, sf_dir):
    policy = hygiene.Policy(**{**POLICY.__dict__, "fragments": "drop", "max_music_score": None})
    return hygiene.report(_verdicts(spark, sf_dir, policy))


@query
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text("text")).alias("text_md5"))


@query
def fragments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fragment_start("text").alias("frag_start"), T.fragment_end("text").alias("frag_end"))


@query
def asr_loop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.asr_loop(T.clean_text("text")).alias("loop"))


@query
def text_measures(spark, sf_dir):
    return manifest(spark, sf_dir).select("id", T.word_count("text").alias("words"), T.has_digits("text").alias("digits"), F.round(T.char_rate("text", "duration"), 6).alias("rate"), speaker_key().alias("speaker_key"))


@query
def parse_ids(spark, sf_dir):
    made = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("clip-"), F.col("doc_id"))).otherwise(F.format_string("source-%x-%010d-%010d", F.col("doc_id"), F.col("n_chars"), F.col("n_chars") + 1500))
    df = table(spark, sf_dir, "documents").select("doc_id", made.alias("clip"))
    p = T.parse_clip_id("clip")
    return df.select("doc_id", p["source"].alias("source"), p["start_ms"].alias("start_ms"), p["end_ms"].alias("end_ms"), T.recording_of(F.lit(None), "clip").alias("recording"))


@query
def cer(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7f]", "x"))  # DuckDB's distance counts bytes
    return turns.select("conv_id", "turn", F.round(T.error_rate(F.translate("text", "ae.", "ea"), "text"), 9).alias("cer"))


@query
def verbalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", verbal.verbalize("text").alias("spoken"))


@query
def verbalize_trace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(verbal.trace("text")).alias("c")).select("doc_id", "c.rule", "c.matched", "c.reading")


@query
def prepare_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", verbal.prepare("text").alias("spoken"))


@query
def prosody_edges(spark, sf_dir):
    return prosody.edges(manifest(spark, sf_dir)).select(F.explode(F.map_from_arrays(F.array(F.lit("rate"), F.lit("loud")), F.array("rate_edges", "loud_edges"))).alias("kind", "e")).select("kind", F.posexplode("e").alias("edge", "value"))


@query
def prosody_buckets(spark, sf_dir):
    df = manifest(spark, sf_dir)
    return prosody.bucketed(df, prosody.edges(df)).groupBy("rate_bucket", "loud_bucket").agg(F.count("*").alias("n"))


@query
def audit_findings(spark, sf_dir):
    return audit.summary(manifest(spark, sf_dir)).select("rule", "severity", "n", "percent", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query
def audit_distributions(spark, sf_dir):
    return audit.distributions(manifest(spark, sf_dir))


@query
def char_inventory(spark, sf_dir):
    return audit.char_inventory(table(spark, sf_dir, "documents"))


@query
def leakage(spark, sf_dir):
    df = manifest(spark, sf_dir)
    return audit.leakage(df.where("source_split <> 'fr'"), df.where("source_split = 'fr'"))


@query
def exclude_anti_join(spark, sf_dir):
    banned = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").join(banned, "doc_id", "left_anti").select("doc_id", "n_chars")


@query
def ref_self_join(spark, sf_dir):
    df = manifest(spark, sf_dir)
    ref = df.select(F.col("id").alias("ref_id"), F.col("duration").alias("ref_duration"), F.col("channel").alias("ref_channel"))
    out = df.where(known("ref_id").isNotNull()).join(ref, "ref_id", "left")
    status = F.when(F.col("ref_duration").isNull(), "missing").when(F.col("ref_id") == F.col("id"), "self").otherwise("ok")
    return out.select("id", "ref_id", F.round("ref_duration", 6).alias("ref_duration"), "ref_channel", status.alias("status"))


@query
def ref_closure(spark, sf_dir):
    df = manifest(spark, sf_dir)
    return select.with_references(df.where("quality_asr_cer < 0.015"), df).select("id", "added")


@query
def needed_files(spark, sf_dir):
    df = manifest(spark, sf_dir)
    return select.needed_files(df, df.where("quality_asr_cer < 0.015").select("id"))


@query
def nearest_in_group(spark, sf_dir):
    return pairing.nearest_in_group(view(spark, sf_dir, PAIRING), min_sim=0.25)


@query
def pairing_report(spark, sf_dir):
    df = view(spark, sf_dir, PAIRING)
    return pairing.pairing_report(pairing.nearest_in_group(df, min_sim=0.25), df)


def _clean_pool(spark, sf_dir):
    df = _judged(spark, sf_dir).drop("drop_reason", "text_fixed")
    floors = df.agg(F.percentile("quality_dnsmos_ovrl", F.lit(0.1)).alias("dnsmos_floor"), F.percentile("quality_speech_ratio", F.lit(0.1)).alias("speech_floor"))
    return df.drop("frag_start", "frag_end").crossJoin(F.broadcast(floors)).withColumns({"frag_start": F.lit(False), "frag_end": F.lit(False)}).withColumn("reason", select.subset_reason(min_sec=2.0, max_sec=400.0, max_clip=0.02, max_music=0.6))


@query
def subset_reasons(spark, sf_dir):
    return _clean_pool(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _subset(spark, sf_dir):
    pool = _clean_pool(spark, sf_dir).where("reason is null")
    return select.round_robin(prosody.bucketed(pool), 20000.0, seed=7)


@query
def subset_round_robin(spark, sf_dir):
    return _subset(spark, sf_dir).select("id", "rate_bucket", "loud_bucket", F.col("pick").cast("long").alias("pick"))


@query
def subset_report(spark, sf_dir):
    return _subset(spark, sf_dir).groupBy("rate_bucket", "loud_bucket").agg(F.round(F.sum("duration") / 3600, 4).alias("hours"), F.countDistinct("speaker_key").alias("speakers"), F.count("*").alias("n"))


@query
def hour_budget_greedy(spark, sf_dir):
    return select.hour_budget(manifest(spark, sf_dir).select("id", "duration"), 30000.0, seed=3).select("id")


@query
def export_selection(spark, sf_dir):
    df = _judged(spark, sf_dir).drop("drop_reason", "text_fixed").withColumn("src", F.col("source_id"))
    out = select.pick_reference(df, max_ref_sec=150.0, seed=5)
    reason = select.export_reason(1.0, 300.0, allow_fragments=True)
    return out.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("duration") / 3600, 3).alias("hours"))


@query
def evaluation_set(spark, sf_dir):
    df = manifest(spark, sf_dir).withColumn("duration", F.col("duration") / 20)
    return select.evaluation_set(df, df.where("review_reasons is not null"), 40, 25, seed=11).select("kind", "id", "has_digits", "ref_id")


@query
def split_counts(spark, sf_dir):
    return manifest(spark, sf_dir).where(F.col("source_split").isin("de", "es", "fr")).groupBy("source_split").agg(F.count("*").alias("n"))


@query
def last_row_per_id(spark, sf_dir):
    from larkspool.sources.read import last_by_id

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", F.md5("text").alias("text_md5"))
    return last_by_id(turns, "turn", "role", "text_md5")


def _codes(spark, sf_dir):
    """Codec levels that follow from the id, 1 + id % 4 frames; one source has none."""
    docs = table(spark, sf_dir, "documents").where("source <> 'src7'").select(F.col("doc_id").alias("id"))
    n = (F.col("id") % 4 + 1).cast("int")

    def level(k):
        return F.transform(F.sequence(F.lit(0), n * k - 1), lambda t: ((F.col("id") * 7 + t * 31 + k) % 4096).cast("int"))

    return docs.select("id", level(1).alias("l0"), level(2).alias("l1"), level(4).alias("l2"))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query
def flatten_codes(spark, sf_dir):
    return _codes(spark, sf_dir).select("id", _joined(K.flatten_codes("l0", "l1", "l2")).alias("codes"))


@query
def unflatten_codes(spark, sf_dir):
    flat = _codes(spark, sf_dir).select("id", F.transform(K.flatten_codes("l0", "l1", "l2"), lambda x: x + F.when(F.col("id") % 9 == 0, 5000).otherwise(0)).alias("f"))
    u = K.unflatten_codes(F.concat("f", K.ints(1, 2)))
    return flat.select("id", *(_joined(u[k]).alias(k) for k in ("l0", "l1", "l2")))


@query
def remap_codes(spark, sf_dir):
    codes = _codes(spark, sf_dir).select("id", F.flatten(F.transform("l0", lambda x: F.array(*(((x + s) % 4096) + s * 4096 for s in range(7))))).alias("c"))
    return codes.select("id", _joined(K.slots_to_levels("c")).alias("codes"))


def _sequences(spark, sf_dir):
    df = manifest(spark, sf_dir)
    marked = prosody.bucketed(df.withColumns({"frag_start": T.fragment_start("text"), "frag_end": T.fragment_end("text")}))
    ids = F.transform(F.sequence(F.lit(0), (F.col("id") % 5).cast("int")), lambda t: ((F.col("id") * 13 + t * 17) % 4096).cast("int"))
    rows = packing.with_controls(marked.withColumn("text_ids", ids), seed=9)
    codes = _codes(spark, sf_dir).select("id", K.flatten_codes("l0", "l1", "l2").alias("codes"))
    return packing.sequences(rows, codes, max_len=60)


@query
def build_prompt(spark, sf_dir):
    s = _sequences(spark, sf_dir).where("status = 'ok'")
    return s.select("id", "kind", "label_start", _joined(F.slice("tokens", 1, F.col("label_start"))).alias("prompt"))


@query
def pack_offsets(spark, sf_dir):
    return packing.index(_sequences(spark, sf_dir)).select("id", "kind", "length", "label_start", "times", F.col("offset").cast("long").alias("offset"))


@query
def pack_stats(spark, sf_dir):
    return packing.stats(_sequences(spark, sf_dir))


@query
def packed_problems(spark, sf_dir):
    s = _sequences(spark, sf_dir).where("status = 'ok'")
    broken = F.when(F.col("id") % 10 == 3, F.slice("tokens", 1, F.col("length") - 2)).otherwise(F.col("tokens"))
    return s.groupBy(F.coalesce(K.packed_problem(broken), F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query
def collate_batch(spark, sf_dir):
    s = _sequences(spark, sf_dir).where("status = 'ok' and kind = 'plain'")
    c = K.collated("tokens", "label_start", F.lit(64))
    return s.select("id", _joined(c["labels"]).alias("labels"), F.aggregate(c["attention_mask"], F.lit(0), lambda a, x: a + x).alias("mask"), F.size(c["input_ids"]).alias("width"))


@query
def token_budget_batches(spark, sf_dir):
    lengths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 2300 + 300).alias("length"))
    return packing.token_budget_batches(lengths, 20480, seed=1, longest=2599)


@query
def seconds_budget_batches(spark, sf_dir):
    rows = packing.shard_numbers(manifest(spark, sf_dir).select("id", "duration"), 256)
    return packing.seconds_budget_batches(rows, 2000.0)


@query
def control_dropout(spark, sf_dir):
    rows = packing.with_controls(prosody.bucketed(manifest(spark, sf_dir)), seed=9)
    return rows.groupBy("rate_token", "loud_token").agg(F.count("*").alias("n"))


@query
def eval_summary(spark, sf_dir):
    m = manifest(spark, sf_dir)
    rows = m.select(
        F.when(F.col("id") % 3 == 0, "clone").otherwise("plain").alias("kind"),
        T.has_digits("text").alias("has_digits"),
        (F.col("id") % 90).alias("n_tokens"),
        F.when(F.col("id") % 8 != 0, F.col("quality_asr_cer")).alias("cer"),
        F.when(F.col("id") % 3 == 0, F.col("quality_speaker_cosine")).alias("spk_cos"),
        F.col("quality_dnsmos_ovrl").alias("dnsmos_ovrl"),
        F.col("duration").alias("dur_sec"),
    )
    return metrics.evaluation_summary(rows)


@query
def heldout_turn(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    step = (F.floor(F.col("event_id") % 12) * 500).cast("long")
    rows = e.select(F.concat(F.lit("checkpoint-"), step.cast("string")).alias("checkpoint"), step.alias("step"), (F.abs("value") % 7 + (step - 2500) * (step - 2500) / 5e6).alias("nll"), F.lit(1).alias("tokens"))
    return metrics.heldout_loss(rows)


@query
def quality_floor(spark, sf_dir):
    return select.quality_floor(manifest(spark, sf_dir), "quality_dnsmos_ovrl", 20)


@query
def reason_algebra(spark, sf_dir):
    from larkspool.schema import reasons

    raw = F.when(F.col("doc_id") % 4 == 0, F.lit('["a", "c"]')).when(F.col("doc_id") % 4 == 1, F.lit("b")).when(F.col("doc_id") % 4 == 2, F.lit(""))
    r = reasons(raw)
    drop = F.array(F.lit("a"), F.lit("b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(F.array_intersect(r, drop)), ",").alias("hit"), F.array_join(F.sort_array(F.array_union(F.array_except(drop, r), F.array(F.lit("z")))), ",").alias("rest"))


@query
def event_dedup_stream(spark, sf_dir):
    """The stream's result, run to its end over the files that are there."""
    base = new_path(spark, "stream")
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    ingest.run_available(ingest.distinct_keys(stream.select("user_id", "event_type"), ["user_id", "event_type"]), f"{base}/out", f"{base}/state")
    return spark.read.schema("user_id long, event_type string").parquet(f"{base}/out")


def _waves(spark, sf_dir):
    """Vectors as short clips of doubles at 16 kHz."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("samples"), F.lit(16000).alias("rate"))


@query
def quality_windows(spark, sf_dir):
    clips = _waves(spark, sf_dir).withColumn("samples", F.slice("samples", 1, (F.col("id") % 64 + 1).cast("int")))
    w = clips.select("id", F.posexplode(signal.windows("samples", 20, 7)).alias("window", "x"))
    return w.select("id", "window", F.size("x").alias("n"), F.round(F.get("x", F.lit(0)), 6).alias("first"), F.round(F.element_at("x", -1), 6).alias("last"))


@query
def band_energy(spark, sf_dir):
    return _waves(spark, sf_dir).select("id", F.round(signal.energy_above("samples", "rate"), 6).alias("above_band"))


@query
def telephony_snr(spark, sf_dir):
    loud = _waves(spark, sf_dir).withColumn("samples", F.transform("samples", lambda v: v * 3))
    return loud.select("id", *(F.round(signal.law_snr("samples", law), 4).alias(f"snr_{law}") for law in ("u", "a")))


@query
def resampled_signal(spark, sf_dir):
    made = _waves(spark, sf_dir).select("id", F.posexplode(signal.at_rate("samples", F.lit(24000), 16000)).alias("place", "v"))
    return made.select("id", "place", F.round("v", 6).alias("v"))


@query
def intake_defaults(spark, sf_dir):
    src = F.when(F.col("id") % 4 == 0, "  ").when(F.col("id") % 4 == 1, F.concat(F.lit(" "), F.col("source_id"))).when(F.col("id") % 4 == 2, F.col("source_id"))
    rows = manifest(spark, sf_dir).select("id", "speaker_id", "channel", src.alias("src_column"))
    return intake.with_defaults(rows, "id", "speaker_id", "src_column").select("id", "speaker_id", "src")


@query
def pairing_defaults(spark, sf_dir):
    rows = manifest(spark, sf_dir).select("id", F.when(F.col("id") % 3 != 0, F.col("speaker_id")).alias("speaker_id"), F.when(F.col("id") % 5 != 0, F.col("channel")).alias("channel"), F.when(F.col("id") % 2 == 0, F.col("source_id")).otherwise("").alias("src"))
    return intake.for_pairing(rows).select("id", "channel", "source_id", "speaker_id")


@query
def ingest_status(spark, sf_dir):
    rows = manifest(spark, sf_dir).select("duration", intake.gate_status(F.col("review_reasons").isNull(), "quality_dnsmos_ovrl", 3.0).alias("status"))
    return metrics.ingest_status(rows)


@query
def new_paths(spark, sf_dir):
    rows = manifest(spark, sf_dir).select("id", "ref_id", F.concat(F.lit("old/"), F.col("id")).alias("audio"), F.lit("fixed.wav").alias("ref_audio"))
    return intake.with_new_paths(rows, "clips/").select("id", "audio", "ref_audio")


@query
def packed_lookup(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    wanted = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit("plain"), F.lit("clone"))).alias("kind"))
    return packing.at(s, packing.index(s), wanted).select("id", "kind", "length", "label_start", _joined("tokens").alias("tokens"))


@query
def repeated_examples(spark, sf_dir):
    return packing.examples(packing.index(_sequences(spark, sf_dir)), seed=4).select("id", "kind", "copy", "order_key")


@query
def generated_codes(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 9).cast("int")), lambda t: ((F.col("doc_id") * 31 + t * 997) % 16448).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", _joined(K.audio_codes(ids)).alias("codes"), K.frames_of("n_chars").cast("long").alias("frames"))


@query
def shard_number(spark, sf_dir):
    return packing.shard_numbers(manifest(spark, sf_dir).select("id"), 256).select("id", F.col("shard").cast("long").alias("shard"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 10 == 7, 32).otherwise(F.size("embedding")).alias("dimensions"))


def _clips(spark, sf_dir):
    start = F.col("doc_id") % 1000 + 0.25
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("channel"), F.lit("rec").alias("source_id"), F.when(F.col("doc_id") % 3 == 0, "drop").otherwise("keep").alias("decision"), start.alias("start_sec"), (start + F.col("n_chars") / 8).alias("end_sec"))


@query
def clips_with_vectors(spark, sf_dir):
    return clip_vectors(_clips(spark, sf_dir), _vectors(spark, sf_dir), "keep").select("clip_id", "channel", "start_ms", "end_ms", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query
def vectors_by_time(spark, sf_dir):
    have = clip_vectors(_clips(spark, sf_dir), _vectors(spark, sf_dir), "keep")
    rows = _clips(spark, sf_dir).select(F.format_string("source-%x-%010d-%010d", "id", F.round(F.col("start_sec") * 1000).cast("long"), F.round(F.col("end_sec") * 1000).cast("long")).alias("id"), "channel", F.col("id").alias("doc_id"))
    return pairing.with_embedding(rows, have).select("doc_id", "channel", F.col("embedding").isNotNull().alias("paired"))


@query
def origin_counts(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    parts = {lang: df.where(F.col("lang") == lang) for lang in ("fr", "de", "en")}
    return union_splits(parts).groupBy("source_split", "source_ord").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query
def loose_numbers(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    cases = [n, F.concat(F.lit(" -"), n, F.lit(".5 ")), F.lit("None"), F.lit(""), F.lit("NaN"), F.concat(n, F.lit("_0")), F.concat(n, F.lit("e2")), F.concat(F.lit("."), n), F.concat(n, F.lit("d"))]
    raw = F.get(F.array(*cases), (F.col("doc_id") % len(cases)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(number(raw), 9).alias("value"))


@query
def made_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.synthetic_id("set", F.col("doc_id") % 12000, "n_chars").alias("made"))


@query
def spoken_numbers(spark, sf_dir):
    """Whole numbers, amounts, shares and measures as the verbaliser says them."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 37 % 1000).alias("a"), (F.col("n_chars") % 900 + 1).alias("b"))
    forms = {"plain": ("Toplam ", "a", " tane"), "share": ("Oran %", "b", " oldu"), "money": ("Fiyat ", "a", " TL oldu"), "measure": ("Yol ", "b", " km sürdü")}
    made = F.array(*(F.struct(F.lit(k).alias("form"), F.concat(F.lit(x), F.col(n).cast("string"), F.lit(y)).alias("t")) for k, (x, n, y) in forms.items()))
    return d.select("doc_id", F.explode(made).alias("f")).select("doc_id", "f.form", verbal.verbalize("f.t").alias("spoken"))


@query
def evaluation_digits(spark, sf_dir):
    df = manifest(spark, sf_dir).withColumn("duration", F.col("duration") / 20)
    e = select.evaluation_set(df, df.where("review_reasons is not null"), 40, 25, seed=11)
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("has_digits").alias("with_digits"))


@query
def vocabulary(spark, sf_dir):
    return K.vocabulary(spark)
