"""Waveforms: WAV bytes, rate conversion, quality windows, G.711 and band energy.

Samples are arrays; windows are Column functions, filters and transforms run in
numpy over Arrow batches, one clip at a time.
"""

from __future__ import annotations

import struct
from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspool.schema import col

# Rates, the quality model's window and hop, the telephone band.
SPEECH_RATE, TELEPHONE_RATE = 16000, 8000
WINDOW, WINDOW_HOP = int(9.01 * SPEECH_RATE), SPEECH_RATE
BAND = 4000.0
# WAV format tags.
PCM, FLOAT, A_LAW, MU_LAW = 1, 3, 6, 7
# The windowed sinc's half width in zero crossings, and its cut-off.
LOBES, ROLLOFF = 6, 0.99


def windows(samples: Column | str, size: int = WINDOW, hop: int = WINDOW_HOP) -> Column:
    """Whole windows; a shorter clip is repeated to fill one, an empty one has none."""
    x = col(samples)
    n = F.size(x)
    tiled = F.slice(F.flatten(F.array_repeat(x, F.ceil(F.lit(size) / F.greatest(n, F.lit(1))).cast("int"))), 1, size)
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(hop))
    return F.when(n >= size, F.transform(starts, lambda s: F.slice(x, s + 1, size))).when(n > 0, F.array(tiled)).when(n == 0, F.slice(F.array(x), 1, 0))


def sinc_kernel(down: int, up: int) -> tuple[np.ndarray, int]:
    """Filters of the up phases for a ratio in lowest terms, and the reach to the left."""
    cut = min(down, up) * ROLLOFF
    reach = ceil(LOBES * down / cut)
    at = np.arange(-reach, reach + down) / down
    t = np.clip((at[None, :] - np.arange(up)[:, None] / up) * cut, -LOBES, LOBES)
    return np.sinc(t) * np.cos(t * np.pi / LOBES / 2) ** 2 * cut / down, reach


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    g = gcd(rate, target)
    down, up = rate // g, target // g
    if down == up or not len(x):
        return x
    kernel, reach = sinc_kernel(down, up)
    padded = np.pad(x, (reach, reach + down))
    frames = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape[1])[::down]
    return (frames @ kernel.T).ravel()[: ceil(up * len(x) / down)]


def companded(x: np.ndarray, law: str) -> tuple[np.ndarray, np.ndarray]:
    """G.711 bytes of samples, and the samples that they decode to."""
    s = np.rint(np.clip(x, -1.0, 1.0) * 32767).astype(np.int64)
    minus = s < 0
    if law == "u":
        mag = np.minimum(np.abs(s), 32635) + 132
        e = np.frexp(mag)[1] - 8
        m = mag >> (e + 3) & 15
        code = ~(minus * 0x80 | e << 4 | m) & 0xFF
        back = ((m << 3) + 132 << e) - 132
    else:
        mag = np.where(minus, -(s >> 3) - 1, s >> 3)
        e = np.where(mag > 31, np.frexp(mag)[1] - 5, 0)
        m = mag >> np.maximum(e, 1) & 15
        code = (e << 4 | m) ^ np.where(minus, 0x55, 0xD5)
        back = (m << 4) + np.where(e > 0, 264, 8) << np.maximum(e - 1, 0)
    return code.astype(np.uint8), np.where(minus, -back, back) / 32768.0


def expanded(code: np.ndarray, law: str) -> np.ndarray:
    """Samples of G.711 bytes."""
    c = code.astype(np.int64)
    if law == "u":
        c = ~c & 0xFF
        e, m, minus = c >> 4 & 7, c & 15, c & 0x80 != 0
        back = ((m << 3) + 132 << e) - 132
    else:
        c ^= 0x55
        e, m, minus = c >> 4 & 7, c & 15, c & 0x80 == 0
        back = (m << 4) + np.where(e > 0, 264, 8) << np.maximum(e - 1, 0)
    return np.where(minus, -back, back) / 32768.0


def wav_bytes(x: np.ndarray, rate: int, tag: int = PCM) -> bytes:
    """One channel as 16-bit PCM or G.711."""
    if tag == PCM:
        data, width = np.rint(np.clip(x, -1.0, 1.0) * 32767).astype("<i2").tobytes(), 2
    else:
        data, width = companded(x, "u" if tag == MU_LAW else "a")[0].tobytes(), 1
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * width, width, 8 * width)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(data: bytes) -> tuple[int, np.ndarray] | None:
    """Rate and samples in [-1, 1], channels averaged; None for what isn't WAV of
    16-bit PCM, 32-bit floats or G.711."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and form:
            tag, channels, rate, _, _, bits = form
            kind = {(PCM, 16): "<i2", (FLOAT, 32): "<f4", (A_LAW, 8): "u1", (MU_LAW, 8): "u1"}.get((tag, bits))
            if kind is None or not channels:
                return None
            width = np.dtype(kind).itemsize * channels
            x = np.frombuffer(body[: len(body) // width * width], kind)
            x = expanded(x, "u" if tag == MU_LAW else "a") if tag in (A_LAW, MU_LAW) else x / 32768.0 if tag == PCM else x.astype(np.float64)
            return rate, x.reshape(-1, channels).mean(axis=1)
        at += 8 + size + size % 2
    return None


def _doubles(x) -> np.ndarray | None:
    return None if x is None else np.asarray(x, np.float64)


def decoded(audio: Column | str) -> Column:
    """WAV bytes as struct(rate, samples); null for null and for other formats."""

    @F.pandas_udf("rate int, samples array<double>")
    def run(a: pd.Series) -> pd.DataFrame:
        out = [None if b is None else wav_samples(b) for b in a]
        return pd.DataFrame({"rate": pd.array([o and o[0] for o in out], "Int32"), "samples": pd.Series([o and o[1] for o in out], dtype=object)})

    made = run(col(audio))
    return F.when(made["rate"].isNotNull(), made)


def at_rate(samples: Column | str, rate: Column | str, target: int) -> Column:
    """Samples converted to the target rate by a windowed sinc."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(s) else resample(_doubles(x), int(s), target) for x, s in zip(a, r, strict=True)], dtype=object)

    return run(col(samples), col(rate))


def energy_above(samples: Column | str, rate: Column | str, band: float = BAND) -> Column:
    """The share of the spectrum's energy above the band; 0 for silence."""

    def share(x, rate_):
        power = np.abs(np.fft.rfft(x)) ** 2
        return float(power[np.fft.rfftfreq(len(x), 1 / rate_) > band].sum() / power.sum()) if len(x) and power.sum() > 0 else 0.0

    @F.pandas_udf("double")
    def run(a: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(s) else share(_doubles(x), s) for x, s in zip(a, r, strict=True)], dtype=float)

    return run(col(samples), col(rate))


def law_snr(samples: Column | str, law: str) -> Column:
    """Signal to quantisation noise of G.711 in dB (law "u" or "a")."""

    def ratio(x):
        x = np.clip(x, -1.0, 1.0)
        noise = companded(x, law)[1] - x
        return float(10 * np.log10((np.mean(x**2) + 1e-12) / (np.mean(noise**2) + 1e-12)))

    @F.pandas_udf("double")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) else ratio(_doubles(x)) for x in a], dtype=float)

    return run(col(samples))


def wav(samples: Column | str, rate: int, tag: int = PCM) -> Column:
    """Samples as the bytes of a WAV file."""

    @F.pandas_udf("binary")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else wav_bytes(_doubles(x), rate, tag) for x in a], dtype=object)

    return run(col(samples))


def through_law(samples: Column | str, law: str) -> Column:
    """Samples as a G.711 line gives them back."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else companded(_doubles(x), law)[1] for x in a], dtype=object)

    return run(col(samples))
