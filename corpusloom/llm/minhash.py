"""Minwise hashing of placed shingles, and small profiles that bound edit distances from below, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, ROWS = 2, 28, 4
#: Shingles are told apart by the stretch of the text that they lie in; stretches of BLOCK characters, at two offsets.
BLOCK = 32
#: Up to this length all texts have the same stretches; beyond, they grow with the root of the length, in classes.
SHORT, GROWTH = 400, 1.3
#: Characters that a profile counts each on its own; all others are counted by code point, in OTHERS kinds. Which ones
#: they are does not matter for the results, only for how much a profile rules out.
FREQUENT, OTHERS = " aeinrlıkdmtysuo", 7
#: A profile is two numbers: 9 bits of length with the first 11 counts, and 12 counts, of 5 bits each.
LENGTH_BITS, COUNT_BITS, FIRST = 9, 5, 11
GROUPS = len(FREQUENT) + OTHERS


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def length_class(length: int | np.ndarray) -> np.ndarray:
    """0 up to SHORT, then one more for every GROWTH."""
    n = np.maximum(np.asarray(length, float), 1.0)
    return np.maximum(0, np.ceil(np.log(n / SHORT) / np.log(GROWTH) - 1e-9)).astype(int)


def _band_keys(texts: list[str], classes: np.ndarray, shingle: int, bands: int, rows: int) -> np.ndarray:
    """A (texts, bands) array of bucket keys, with the stretches of the given length classes."""
    lengths = np.array([max(len(t), shingle) for t in texts])
    joined = "".join(t if len(t) >= shingle else t + "\0" * (shingle - len(t)) for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    code = points[: len(points) - shingle + 1].copy()
    for k in range(1, shingle):
        code = code * np.uint64(0x1000193) + points[k : len(points) - shingle + 1 + k] * np.uint64(0x9E3779B1)
    ends = np.cumsum(lengths)
    counts = lengths - shingle + 1
    keep = np.ones(len(code), bool)
    for k in range(1, shingle):  # shingles across two texts
        at = ends[:-1] - k
        keep[at[at < len(code)]] = False
    code = code[keep]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.arange(len(code)) - np.repeat(starts, counts)
    wide = np.repeat(np.rint(BLOCK * GROWTH ** (classes / 2)).astype(np.int64), counts)
    stretch = np.stack([2 * (place // wide), 2 * ((place + wide // 2) // wide) + 1]).astype(np.uint64)
    code = (_mix(code ^ _mix(stretch * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)).astype(np.uint32)
    draw = np.random.default_rng(20310101)
    factors = draw.integers(1, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    masks = draw.integers(1, 2**32, bands * rows, dtype=np.uint32)
    keys = np.empty((len(texts), bands), np.uint64)
    order = np.argsort(counts, kind="stable")
    for at in range(0, len(order), 256):  # texts of like length, one a column; short columns repeat their last shingle
        some = order[at : at + 256]
        spot = starts[some] + np.minimum(np.arange(counts[some[-1]])[:, None], counts[some] - 1)
        block = np.concatenate([code[0][spot], code[1][spot]])
        for b in range(bands):
            key = (classes[some] * 1000 + b + 1).astype(np.uint64)
            for r in range(b * rows, b * rows + rows):
                key = _mix(key * np.uint64(0x100000001B3) ^ ((block ^ masks[r]) * factors[r]).min(axis=0))
            keys[some, b] = key
    return keys.view(np.int64)


def band_keys(texts: list[str], reach: float = 0.0, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, bucket key) of every text and band.

    reach: a text also gets the keys of the length classes that a text up to this share longer or shorter may lie in.
    A text shorter than a shingle is one shingle.
    """
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = np.array([len(t) for t in texts])
    low, high = length_class(n * (1 - reach)), length_class(n / (1 - reach) if reach < 1 else n)
    at = np.repeat(np.arange(len(texts)), high - low + 1)
    classes = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
    keys = _band_keys([texts[i] for i in at], classes, shingle, bands, rows)
    return np.repeat(at, bands), keys.reshape(-1)


def profiles(texts: list[str]) -> np.ndarray:
    """(texts, 2): the length of each text and its characters by kind, each up to what its bits can hold."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    kind = len(FREQUENT) + points % OTHERS
    for g, c in enumerate(FREQUENT):
        kind[points == ord(c)] = g
    counts = np.bincount(np.repeat(np.arange(len(texts)), lengths) * GROUPS + kind, minlength=len(texts) * GROUPS).reshape(-1, GROUPS)
    counts = np.minimum(counts, 2**COUNT_BITS - 1).astype(np.int64)
    first, second = np.minimum(lengths, 2**LENGTH_BITS - 1), np.zeros(len(texts), np.int64)
    for g in range(FIRST):
        first |= counts[:, g] << (LENGTH_BITS + COUNT_BITS * g)
    for g in range(FIRST, GROUPS):
        second |= counts[:, g] << (COUNT_BITS * (g - FIRST))
    return np.column_stack([first, second])


def may_be_near(a: tuple[Column, Column], b: tuple[Column, Column], most_edits: float) -> Column:
    """Whether texts with these profiles can lie within most_edits of the longer one's length; never false for those
    that do: an edit changes the length by at most 1 and the counts by at most 2 together."""
    length = lambda p: p[0].bitwiseAND(F.lit(2**LENGTH_BITS - 1))
    part = lambda p, shift: F.shiftrightunsigned(p, shift).bitwiseAND(F.lit(2**COUNT_BITS - 1))
    count = lambda p, g: part(p[0], LENGTH_BITS + COUNT_BITS * g) if g < FIRST else part(p[1], COUNT_BITS * (g - FIRST))
    longer = F.greatest(length(a), length(b))
    edits = F.floor(longer * most_edits + 1e-9)
    apart = F.abs(count(a, 0) - count(b, 0))
    for g in range(1, GROUPS):
        apart = apart + F.abs(count(a, g) - count(b, g))
    return (longer == 2**LENGTH_BITS - 1) | ((F.abs(length(a) - length(b)) <= edits) & (apart <= 2 * edits))


def buckets(texts: DataFrame, reach: float = 0.0, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, p0, p1, bucket): one row a text and band, from texts (key long, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words = part.column(1).to_pylist()
                of, bucket = band_keys(words, reach, shingle, bands, rows)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                own = profiles(words)[of]
                yield pa.RecordBatch.from_arrays([pa.array(keys[of]), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(bucket)], names=["key", "p0", "p1", "bucket"])

    return texts.select("key", "text").mapInArrow(run, "key long, p0 long, p1 long, bucket long")
