"""Hygiene, prosody, audit and selection on small manifests."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspool.operators import audit, hygiene, packing, pairing, prosody, select
from larkspool.schema import number, reasons

ROW = dict(id="x", text="Bir cümle.", duration=1.0, speaker_id="spk-1", channel="kanal", review_reasons=None, quality_music_score=None)
DDL = "id string, text string, duration double, speaker_id string, channel string, review_reasons string, quality_music_score double"


def frame(spark, *rows):
    return spark.createDataFrame([tuple((ROW | r).values()) for r in rows], DDL)


def verdicts(spark, *rows, **policy):
    out = hygiene.judged(frame(spark, *[r | {"id": r.get("id", str(i))} for i, r in enumerate(rows)]), hygiene.Policy(**policy))
    return [r.drop_reason for r in out.orderBy("id").collect()]


def test_rule_order(spark):
    got = verdicts(
        spark,
        dict(text=""), dict(text="tek"), dict(duration=0.0), dict(text="gel gel gel artık"), dict(text="kısa bir", duration=30.0),
        dict(review_reasons='["farkli_konusmaci_suphesi","b"]'), dict(quality_music_score=0.9), dict(quality_music_score=float("nan"), speaker_id="q"),
    )
    assert got == ["empty_text", "few_words", "bad_duration", "asr_loop", "rate_outlier", "reason:farkli_konusmaci_suphesi", "limit:music", None]


def test_duplicates_first_wins_among_survivors(spark):
    got = verdicts(spark, dict(id="a", quality_music_score=0.9), dict(id="b"), dict(id="c"), dict(id="d", speaker_id="spk-2"), dict(id="e", speaker_id="None"), dict(id="f", speaker_id=None))
    assert got == ["limit:music", None, "duplicate_recording", None, None, "duplicate_recording"]


def test_fragments_and_report(spark):
    assert verdicts(spark, dict(text="yarım cümle"), fragments="drop") == ["fragment"]
    rep = {r.metric: r.n for r in hygiene.report(hygiene.judged(frame(spark, dict(text="Bir  cümle"), dict(id="y", text="")))).collect()}
    assert rep == {"kept": 1, "dropped:empty_text": 1, "fixed:text": 1, "fragment:start": 0, "fragment:end": 1}


def test_empty_manifest(spark):
    assert hygiene.judged(frame(spark).limit(0)).count() == 0


def test_numbers_and_reasons(spark):
    rows = spark.createDataFrame([("1.5",), ("None",), ("",), ("1_0",), ("1.5d",), ("-2e3",), ("NaN",)], "s string")
    assert [r[0] for r in rows.select(number("s")).collect()] == [1.5, None, None, None, None, -2000.0, None]
    rows = spark.createDataFrame([('["a","b"]',), ("a",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(reasons("s")).collect()] == [["a", "b"], ["a"], [], []]


def test_prosody(spark):
    rows = spark.createDataFrame([("x" * (i + 1), 1.0, float(i)) for i in range(100)], "text string, duration double, quality_lufs double")
    e = prosody.edges(rows)
    assert e.first().rate_edges == [20.8, 40.6, 60.4, 80.2]
    counts = prosody.bucketed(rows, e).groupBy("rate_bucket").count().collect()
    assert sorted((r.rate_bucket, r["count"]) for r in counts) == [(i, 20) for i in range(5)]


def test_audit(spark):
    rows = [("a", "Tamam, bu ''iyi'' bir söz.", 3.0, "b"), ("b", "küçük başlıyor 12", 2.0, "zz"), ("c", "küçük başlıyor 12", 2.0, "c"), ("d", " ", 1.0, None)]
    df = spark.createDataFrame(rows, "id string, text string, duration double, ref_id string")
    for name in ("quality_asr_cer", "quality_clip_ratio", "quality_speech_ratio", "quality_music_score", "quality_dnsmos_ovrl", "quality_speaker_cosine"):
        df = df.withColumn(name, F.lit(None).cast("double"))
    got = {(r.rule, r.n) for r in audit.summary(df).collect()}
    assert {("doubled_apostrophe", 1), ("repeated_text", 1), ("empty_text", 1), ("ref_missing", 1), ("ref_self", 1), ("lower_start", 2), ("digits", 2)} <= got


def test_leakage_counts_null(spark):
    a = spark.createDataFrame([("x",), (None,)], "k string")
    b = spark.createDataFrame([(None,), ("y",), ("x",), ("x",)], "k string")
    assert tuple(audit.leakage(a, b, ("k",)).first()) == ("k", 2, 3, 2, 3, 75.0)


def greedy(rows, budget, seed):
    import hashlib

    order = sorted(rows, key=lambda r: hashlib.md5(f"{seed}|{r[0]}".encode()).hexdigest())
    left, out = budget, []
    for i, d in order:
        if d <= left:
            left -= d
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_hour_budget(spark, seed):
    rng = random.Random(seed)
    rows = [(i, float(rng.choice([1, 2, 5, 9, 30]))) for i in range(120)]
    got = select.hour_budget(spark.createDataFrame(rows, "id long, duration double"), 150.0, seed)
    assert sorted(r.id for r in got.collect()) == greedy(rows, 150.0, seed)


def test_round_robin_takes_turns(spark):
    rows = [(i, i % 2, 0, f"s{i % 3}", 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, rate_bucket int, loud_bucket int, speaker_key string, duration double")
    got = select.round_robin(df, 120.0).collect()
    assert len(got) == 12 and {r.rate_bucket for r in got} == {0, 1}
    assert all(sum(r.rate_bucket == b and r.speaker_key == s for r in got) == 2 for b in (0, 1) for s in ("s0", "s1", "s2"))


def test_reference_picks(spark):
    rows = [("a", "s", 2.0, "r1", "b"), ("b", "s", 3.0, "r2", None), ("c", "t", 2.0, "r3", None), ("d", "s", 2.0, "r1", "zz")]
    df = spark.createDataFrame(rows, "id string, speaker_id string, duration double, src string, ref_id string").withColumn("channel", F.lit("k"))
    got = {r.id: r.picked_ref for r in select.pick_reference(df).collect()}
    assert got["a"] == "b" and got["b"] in ("a", "d") and got["c"] is None and got["d"] == "b"


def test_nearest(spark):
    rows = [(1, "g", 1, [1.0, 0.0]), (2, "g", 2, [0.9, 0.1]), (3, "g", 1, [1.0, 0.01]), (4, "h", 1, [1.0, 0.0]), (5, "g", 3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, channel string, source_id int, embedding array<double>")
    for parts in (2000, 1):
        got = {r.id: r.ref_id for r in pairing.nearest_in_group(df, 0.7, rows_per_part=parts).collect()}
        assert got == {1: 2, 2: 3, 3: 2}


def test_token_budget(spark):
    rows = [(i, 300 + i * 37 % 2300) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, length int")
    got = packing.token_budget_batches(df, 20480).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.block, r.batch), []).append(r.length)
    assert sorted(r.id for r in got) == list(range(500)) and all(max(g) * len(g) <= 20480 for g in groups.values())
    with pytest.raises(ValueError):
        packing.token_budget_batches(df, 1000)


def test_sources(spark, tmp_path):
    from larkspool.sources import read, write

    df = spark.createDataFrame([("a", b"1", "t"), ("b", b"2", "u")], "id string, audio binary, text string")
    df.toPandas().to_parquet(tmp_path / "train-00000-of-00001.parquet")
    root = str(tmp_path)
    assert read.available_splits(spark, root) == ["train"]
    assert set(read.read_split(spark, root, "train").columns) == {"id", "text", "_shard", "_split", "_row"}
    assert [r.id for r in read.read_audio(spark, root, "train", df.where("id = 'b'")).collect()] == ["b"]
    with pytest.raises(ValueError):
        read.load_rows(spark, root)
    write.manifest(df.select("id", "text"), f"{root}/m.jsonl")
    assert sorted(r.id for r in read.read_jsonl(spark, f"{root}/m.jsonl").collect()) == ["a", "b"]
    assert json.loads(df.select("id").toJSON().first()) == {"id": "a"}


def test_audio_from_paths(spark, tmp_path):
    from larkspool.sources import read

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "one.flac").write_bytes(b"one")
    rows = [("x", (None, "b/one.flac")), ("y", (b"two", "one.flac")), ("z", (None, None)), ("w", (None, "none.flac"))]
    df = spark.createDataFrame(rows, "id string, audio struct<bytes: binary, path: string>")
    got = {r.id: r.audio and bytes(r.audio) for r in read.audio_bytes(df, f"{tmp_path}/a").collect()}
    assert got == {"x": b"one", "y": b"two", "z": None, "w": None}
    paths = spark.createDataFrame([("x", "/far/one.flac")], "id string, audio string")
    assert bytes(read.audio_bytes(paths, f"{tmp_path}/a").first().audio) == b"one"


def test_code_shards_last_wins(spark, tmp_path):
    from larkspool.operators import packing
    from larkspool.sources import read

    for k, codes in (("s1", [1]), ("s2", [2])):
        spark.createDataFrame([("x", codes), (k, codes)], "id string, codes array<int>").coalesce(1).write.parquet(f"{tmp_path}/codes/{k}")
    got = {r.id: r.codes for r in packing.last_codes(read.code_shards(spark, f"{tmp_path}/codes")).collect()}
    assert got == {"x": [2], "s1": [1], "s2": [2]}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        read.code_shards(spark, f"{tmp_path}/none")


def test_prosody_edges_load(spark, tmp_path):
    from larkspool.operators import prosody

    assert prosody.load(spark, f"{tmp_path}/no").first().loud_edges == prosody.DEFAULT_LOUD
    prosody.save(spark.createDataFrame([([1.0, 2.0], [3.0])], "rate_edges array<double>, loud_edges array<double>"), f"{tmp_path}/p")
    assert prosody.load(spark, f"{tmp_path}/p").first().rate_edges == [1.0, 2.0]
