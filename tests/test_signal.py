"""Waveforms, intake rules and file sinks on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspool.functions import signal, tokens
from larkspool.operators import intake, metrics
from larkspool.sources import write


def test_resample_is_the_sum_over_the_sinc():
    x = np.random.default_rng(0).normal(size=157)
    for rate, target in ((44100, 24000), (8000, 16000), (24000, 16000)):
        down, up = rate // np.gcd(rate, target), target // np.gcd(rate, target)
        cut = min(down, up) * 0.99
        want = []
        for j in range(-(-up * len(x) // down)):
            t = (np.arange(len(x)) / down - j / up) * cut
            k = np.where(abs(t) < 6, np.sinc(t) * np.cos(np.pi * t / 12) ** 2, 0)
            want.append((x * k).sum() * cut / down)
        assert np.allclose(signal.resample(x, rate, target), want)
    assert signal.resample(x, 16000, 16000) is x and len(signal.resample(x[:0], 8000, 16000)) == 0


@pytest.mark.parametrize("law", ["u", "a"])
def test_g711(law):
    x = np.linspace(-1.2, 1.2, 5001)
    code, back = signal.companded(x, law)
    assert np.array_equal(signal.expanded(code, law), back)
    inside = abs(x) <= 0.97
    assert np.all(abs(back - x)[inside] <= np.maximum(abs(x[inside]) / 30, 0.0006))
    # known codes: silence, and the ends of the range
    assert signal.companded(np.array([0.0, 1.0, -1.0]), law)[0].tolist() == ({"u": [0xFF, 0x80, 0x00], "a": [0xD5, 0xAA, 0x2A]}[law])


def test_wav_round_trip():
    x = np.sin(np.arange(99) / 7) * 0.8
    rate, got = signal.wav_samples(signal.wav_bytes(x, 16000))
    assert rate == 16000 and np.allclose(got, x, atol=1e-4)
    rate, got = signal.wav_samples(signal.wav_bytes(x, 8000, signal.A_LAW))
    assert rate == 8000 and np.array_equal(got, signal.companded(x, "a")[1])
    assert signal.wav_samples(b"") is None and signal.wav_samples(b"fLaC" + b"\0" * 40) is None
    assert signal.wav_samples(signal.wav_bytes(x[:0], 8000))[1].size == 0


def test_windows(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],), (None,), ([float(i) for i in range(9)],)], "x array<double>")
    got = [r[0] for r in df.select(signal.windows("x", 4, 2)).collect()]
    assert got == [[[1, 2, 3, 1]], [], None, [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7]]]


def test_checked_samples(spark):
    x = np.zeros(8)
    rows = [("a", 1.0, signal.wav_bytes(x, 16000)), ("b", 1.0, signal.wav_bytes(x, 8000)), ("c", 1.0, None)]
    df = spark.createDataFrame(rows, "id string, duration double, audio binary")
    assert len(intake.checked_samples(df.where("id = 'a'")).first().samples) == 8
    for bad in ("b", "c"):
        with pytest.raises(Exception, match="clip . isn't WAV at 16000 Hz"):
            intake.checked_samples(df.where(F.col("id") == bad)).collect()


def test_telephony_files(spark, tmp_path):
    tone = (np.sin(np.arange(1600) / 5) * 1.4).tolist()
    df = spark.createDataFrame([("x", 16000, tone), ("y", 8000, [0.0] * 80)], "id string, rate int, samples array<double>")
    files, figures = intake.telephony(df)
    assert sorted(r.name for r in write.files(files, str(tmp_path)).collect()) == sorted(f"{i}_g711{s}.wav" for i in "xy" for s in ("u", "a", "u_16k"))
    assert not any(r.written for r in write.files(files, str(tmp_path)).collect())
    rate, low = signal.wav_samples((tmp_path / "x_g711u.wav").read_bytes())
    assert rate == 8000 and len(low) == 800 and abs(low).max() <= 1
    assert signal.wav_samples((tmp_path / "x_g711u_16k.wav").read_bytes())[0] == 16000
    f = {r.id: r for r in figures.collect()}
    assert f["x"].seconds == 0.1 and f["x"].snr > 25 and f["x"].above_band < 0.01 and f["y"].above_band == 0
    with pytest.raises(ValueError):
        intake.telephony(df, ("b",))


def test_clips_and_reports(spark, tmp_path):
    audio = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", None)], "id string, audio binary")
    need = spark.createDataFrame([("a",), ("a",), ("c",)], "id string")
    assert [tuple(r) for r in write.clips(audio, need, str(tmp_path / "clips")).collect()] == [("a.flac", True)]
    assert (tmp_path / "clips" / "a.flac").read_bytes() == b"1"
    write.evaluation(audio.select("id"), need.limit(1), str(tmp_path / "e"), "step-1")
    assert spark.read.json(str(tmp_path / "e" / "step-1" / "results")).count() == 3
    write.audits({"train": need}, need, str(tmp_path / "audit"))
    assert json.loads(next((tmp_path / "audit" / "train").glob("*.json")).read_text().splitlines()[0]) == {"id": "a"}


def test_intake_rules(spark):
    df = spark.createDataFrame([("a", None, None, 3.0, True), ("b", "", " s ", 1.0, True), ("c", "p", "", None, True), ("d", "p", "s", 5.0, None)], "id string, who string, rec string, score double, ok boolean")
    out = intake.with_defaults(df, "id", "who", "rec").withColumn("status", intake.gate_status(F.col("ok"), "score", 2.0)).orderBy("id")
    assert [(r.speaker_id, r.src, r.status) for r in out.collect()] == [("", "a", "kept"), ("", "s", "dnsmos"), ("p", "c", "kept"), ("p", "s", "hygiene")]
    assert {r.speaker_id for r in intake.with_defaults(df, constant="one").collect()} == {"one"}
    p = spark.createDataFrame([("a", None, "x", "y"), (None, "b", "x", "y")], "id string, ref_id string, audio string, ref_audio string")
    assert [(r.audio, r.ref_audio) for r in intake.with_new_paths(p, "f").collect()] == [("f/a.flac", "y"), ("x", "f/b.flac")]


def test_window_mean_and_vocabulary(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0)], "id string, raw double")
    assert metrics.window_mean(df).first().dnsmos_ovrl == pytest.approx(-0.06766283 * 9 + 1.11546468 * 3 + 0.04602535)
    v = {r.name: (r.first_id, r.last_id) for r in tokens.vocabulary(spark).collect()}
    assert v["text"] == (0, 4095) and v["audio"] == (4096, 16383) and v["bos"] == (16384, 16384) and v["padded"] == (16405, 16447)
