"""Signals as arrays of samples: features, fingerprints and segments in Arrow batches, scores and recursions natively."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.arrays import dot, let, total
from corpusloom.models.protocols import Factory, PitchTracker

FINGERPRINT_RATE, VAD_RATE = 8_000, 16_000


def mono(samples: np.ndarray) -> np.ndarray:
    """The mean over channels of (samples, channels)."""
    x = np.asarray(samples, np.float32)
    return x if x.ndim == 1 else x.mean(axis=1)


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """x at another rate, by linear interpolation after a moving average over the samples that fall together."""
    if rate == to or not len(x):
        return np.asarray(x, np.float32)
    step = rate / to
    if step > 1:
        width = int(np.ceil(step))
        x = np.convolve(x, np.ones(width) / width, mode="same")
    return np.interp(np.arange(round(len(x) / step)) * step, np.arange(len(x)), x).astype(np.float32)


def mel_filters(bands: int, size: int, rate: int) -> np.ndarray:
    """(bands, size // 2 + 1): triangles that are evenly spaced on the mel scale."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), bands + 2) / 2595) - 1)
    at = np.fft.rfftfreq(size, 1 / rate)
    left, top, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((at - left) / (top - left), (right - at) / (right - top)))


def spectra(x: np.ndarray, size: int, hop: int, centred: bool = True) -> np.ndarray:
    """(frames, size // 2 + 1): power of Hann-windowed frames; centred frames see the signal mirrored at its ends."""
    if centred and len(x) > 1:
        x = np.pad(x, min(size // 2, len(x) - 1), mode="reflect")
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.abs(np.fft.rfft(frames * np.hanning(size + 1)[:-1], axis=1)) ** 2


def log_mel(x: np.ndarray, rate: int, size: int = 1024, hop: int = 256, bands: int = 100, floor: float = 1e-5) -> np.ndarray:
    """(frames, bands): logarithms of mel levels, at least those of floor."""
    return np.log(np.maximum(np.sqrt(spectra(x, size, hop)) @ mel_filters(bands, size, rate).T, floor))


def fingerprint(x: np.ndarray, rate: int) -> str:
    """A digest of the rough shape of a signal: which cells of a 32 x 32 picture of its mel levels are above the mean."""
    y = resampled(x, rate, FINGERPRINT_RATE)
    y = y / max(float(np.abs(y).max(initial=0)), 1e-6)
    picture = np.log1p(spectra(y, 512, 160) @ mel_filters(32, 512, FINGERPRINT_RATE).T)
    at = (np.arange(32) + 0.5) * len(picture) / 32 - 0.5
    low = np.clip(np.floor(at).astype(int), 0, len(picture) - 1)
    high, part = np.minimum(low + 1, len(picture) - 1), np.clip(at - low, 0, 1)[:, None]
    small = picture[low] * (1 - part) + picture[high] * part
    return hashlib.sha256(np.packbits(small >= small.mean()).tobytes()).hexdigest()


def timbre(x: np.ndarray, rate: int, edges: list[float], least_level: float = 0.01) -> list[float] | None:
    """Levels of bands in dB, less their mean, over the frames that are loud enough; None where none is."""
    power = spectra(x, 2048, 1024, centred=False)
    levels = np.sqrt(np.mean(np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, 2048 - len(x)))), 2048)[::1024] ** 2, axis=1))
    loud = power[levels >= least_level]
    if not len(loud):
        return None
    at = np.fft.rfftfreq(2048, 1 / rate)
    bands = np.array([loud[:, (at >= a) & (at < b)].mean() if ((at >= a) & (at < b)).any() else 0.0 for a, b in zip(edges, edges[1:])])
    db = 10 * np.log10(bands + 1e-12)
    return (db - db.mean()).tolist()


def voiced_features(pitch: np.ndarray, energy: np.ndarray, seconds: float, characters: int) -> list[float] | None:
    """Six features of a reading: log seconds a character, mean and deviation of log energy and of log pitch over voiced
    frames, share of voiced frames; None without any."""
    voiced = pitch > 0
    if not voiced.any() or characters <= 0 or seconds <= 0:
        return None
    e, p = np.log1p(energy), np.log(pitch[voiced])
    return [float(np.log(seconds / characters)), float(e.mean()), float(e.std()), float(p.mean()), float(p.std()), float(voiced.mean())]


def speech_spans(x: np.ndarray, rate: int, threshold: float = 0.02, least: float = 0.25, silence: float = 0.3, pad: float = 0.1, most: float = 20.0) -> list[tuple[int, int]]:
    """(start, end) samples of stretches of speech: frames of 20 ms above a level, joined over short silences, padded, and
    cut where they are too long. A stand-in for a model of speech; any function of this shape can take its place."""
    hop = max(1, rate // 50)
    n = len(x) // hop
    if not n:
        return []
    loud = np.sqrt(np.mean(np.reshape(x[: n * hop], (n, hop)) ** 2, axis=1)) >= threshold
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
    spans: list[list[int]] = []
    for a, b in zip(edges[::2], edges[1::2]):
        if spans and (a - spans[-1][1]) * hop < silence * rate:
            spans[-1][1] = int(b)
        else:
            spans.append([int(a), int(b)])
    out = []
    for a, b in spans:
        if (b - a) * hop < least * rate:
            continue
        start, end = max(0, int(a * hop - pad * rate)), min(len(x), int(b * hop + pad * rate))
        step = int(most * rate)
        out += [(s, min(s + step, end)) for s in range(start, end, step)]
    return out


def segments(df: DataFrame, row_id: str, samples: str, rate: str, version: str = "v1", spans=speech_spans) -> DataFrame:
    """(parent, segment, clip_id, start, end, audio): one row a stretch of speech; ids depend on the parent and the places
    in it only. A parent that cannot be read fails; one without speech has no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for parent, x, hz in frame.itertuples(index=False):
                if x is None or not hz or hz <= 0:
                    raise ValueError(f"{parent} cannot be read")
                y = np.asarray(x, np.float32)
                for k, (a, b) in enumerate(spans(y, int(hz))):
                    digest = hashlib.sha256(f"{version}:{parent}:{a}:{b}:{int(hz)}".encode()).hexdigest()
                    rows.append((parent, k, f"{parent}-seg-{digest[:16]}", a, b, y[a:b].tolist()))
            yield pd.DataFrame(rows, columns=["parent", "segment", "clip_id", "start", "end", "audio"])

    return df.select(F.col(row_id).cast("string"), F.col(samples).cast("array<float>"), F.col(rate).cast("int")).mapInPandas(run, "parent string, segment int, clip_id string, start long, end long, audio array<float>")


def _of_signals(kind: T.DataType, function):
    @F.pandas_udf(kind)
    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) or not hz else function(np.asarray(x, np.float32), int(hz)) for x, hz in zip(samples, rate)], dtype=object)

    return run


fingerprint_of = _of_signals(T.StringType(), fingerprint)
mono_16k = _of_signals(T.ArrayType(T.FloatType()), lambda x, hz: resampled(x, hz, VAD_RATE).tolist())


def timbre_of(samples: Column, rate: Column, edges: list[float]) -> Column:
    """timbre, of columns; null for null and silent signals."""
    return _of_signals(T.ArrayType(T.DoubleType()), lambda x, hz: timbre(x, hz, edges))(samples, rate)


def pitch_features(samples: Column, rate: Column, factory: Factory[PitchTracker]) -> Column:
    """Mean and deviation of log pitch and the share of voiced frames; null where no frame is voiced."""
    from corpusloom.models.stages import once

    model = once(factory)

    def features(x: np.ndarray, hz: int) -> list[float] | None:
        pitch = np.asarray(model()(x, hz), float)
        voiced = pitch > 0
        return [float(np.log(pitch[voiced]).mean()), float(np.log(pitch[voiced]).std()), float(voiced.mean())] if voiced.any() else None

    return _of_signals(T.ArrayType(T.DoubleType()), features)(samples, rate)


def envelope_penalty(features: Column, mean: Column, deviation: Column, group_mean: Column, group_deviation: Column, absent: float = 10.0) -> Column:
    """The root mean square of three features, standardised twice: by their own statistics and by those of a group."""
    z = lambda x, m, d: F.zip_with(F.zip_with(x, m, lambda v, c: v - c), d, lambda v, s: v / s)
    return F.coalesce(let(z(z(features, mean, deviation), group_mean, group_deviation), lambda s: F.sqrt(dot(s, s) / F.size(s))), F.lit(absent))


def mel_score(mel: Column, width: int, clip: float = 4.0, still: float = 0.05, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> Column:
    """How far a normalised spectrogram, rows of `width` values one after the other, is from mean 0, deviation 1, without
    clipped values and without frames that hardly differ from the next; 0 is best. Only whole frames count."""
    frames = F.floor(F.size(mel) / width).cast("int")

    def scored(x: Column) -> Column:
        n = F.greatest(F.size(x), F.lit(1)).cast("double")
        mean = total(x) / n
        deviation = let(mean, lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n))
        clipped = F.size(F.filter(x, lambda v: F.abs(v) >= clip)) / n
        moves = F.zip_with(F.slice(x, F.lit(width + 1), F.greatest(F.size(x) - width, F.lit(0))), F.slice(x, F.lit(1), F.greatest(F.size(x) - width, F.lit(0))), lambda a, b: F.abs(a - b))
        steps = F.greatest(F.size(x) / width - 1, F.lit(0)).cast("int")
        static = let(moves, lambda d: F.size(F.filter(F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")), lambda i: total(F.slice(d, i * width + 1, F.lit(width))) / width < still)) / F.greatest(steps, F.lit(1)))
        return -(weights[0] * F.abs(mean) + weights[1] * F.abs(deviation - 1) + weights[2] * clipped + weights[3] * static)

    return let(F.slice(F.transform(mel, lambda v: v.cast("double")), F.lit(1), frames * width), scored)


def smoothed(values: Column, target: float) -> Column:
    """The exponential moving average of an array, whose decay grows with the number of steps up to target."""
    start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(0).alias("n"))

    def step(acc: Column, v: Column) -> Column:
        decay = F.least(F.lit(target), (1.0 + acc["n"]) / (10.0 + acc["n"]))
        return F.struct(F.when(acc["m"].isNull(), v.cast("double")).otherwise(decay * acc["m"] + (1 - decay) * v).alias("m"), (acc["n"] + 1).alias("n"))

    return F.aggregate(values, start, step)["m"]


def warped(t: Column, strength: float) -> Column:
    """A time in 0..1, slower at the start for negative strengths."""
    return t + strength * (F.cos(F.pi() / 2 * t) - 1 + t)


def resolved_style(presets: Column, style: Column, base: Column) -> Column:
    """The preset vector of a style, from a map, where there is one; else the base vector."""
    return F.coalesce(F.element_at(presets, style), base)


def largest_bands(delta: Column, n: int) -> Column:
    """Positions of the n largest absolute values, largest first, the lower position in a tie."""
    order = F.array_sort(F.transform(delta, lambda v, i: F.struct((-F.abs(v)).alias("a"), i.alias("i"))))
    return F.transform(F.slice(order, 1, n), lambda s: s["i"])
