"""Functions on arrays of numbers, all native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    """The sum, in order, in double precision."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """The scalar product."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(x: Column) -> Column:
    """The Euclidean length."""
    return F.sqrt(dot(x, x))


def unit(x: Column) -> Column:
    """x over its length, which is at least 1e-8."""
    return let(F.greatest(norm(x), F.lit(1e-8)), lambda n: F.transform(x, lambda v: v.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of the angle."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))


def standardised(x: Column, mean: Column, deviation: Column, limit: float = 5.0) -> Column:
    """(x - mean) / deviation by position, within ±limit."""
    centred = F.zip_with(x, mean, lambda v, m: v.cast("double") - m)
    return F.transform(F.zip_with(centred, deviation, lambda v, d: v / d), lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v)))


def blended(base: Column, target: Column, strength: float, limit: float = 5.0) -> Column:
    """base + strength * (target - base), within ±limit."""
    mixed = F.zip_with(base, target, lambda b, t: b + strength * (t - b))
    return F.transform(mixed, lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v)))


def penalty(x: Column, mean: Column, deviation: Column, floor: float = 0.5, absent: float = 10.0) -> Column:
    """The root mean square of the standard scores, with deviations of at least floor; absent for null."""
    scores = F.zip_with(F.zip_with(x, mean, lambda v, m: v.cast("double") - m), deviation, lambda v, d: v / F.greatest(F.lit(floor), d))
    return F.coalesce(F.sqrt(dot(scores, scores) / F.size(x)), F.lit(absent))


def frames(x: Column, size: int) -> Column:
    """Consecutive frames without an incomplete last one."""
    count = F.floor(F.size(x) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(x, i * size + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def frame_levels(x: Column, size: int) -> Column:
    """The root mean square of each frame."""
    return let(F.transform(x, lambda v: v.cast("double")), lambda d: F.transform(frames(d, size), lambda f: F.sqrt(dot(f, f) / size)))


def percentile_of(x: Column, share: float) -> Column:
    """Linear percentile of an array."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(share)
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, a + (b - a) * (at - low))

    return let(F.array_sort(x), between)


def signal_metrics(x: Column, frame: int, floor_db: float = -45.0) -> Column:
    """peak, rms_db, clipping, active and snr_db of a signal."""
    share = lambda n, of: F.when(of > 0, n / of).otherwise(0.0)

    def described(levels: Column) -> Column:
        ends = F.struct(F.coalesce(percentile_of(levels, 0.1), F.lit(0.0)).alias("noise"), F.coalesce(percentile_of(levels, 0.9), F.lit(0.0)).alias("loud"))
        return let(ends, lambda e: F.struct(
            F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))).alias("peak"),
            (20 * F.log10(F.greatest(F.sqrt(dot(x, x) / F.size(x)), F.lit(1e-12)))).alias("rms_db"),
            share(F.size(F.filter(x, lambda v: F.abs(v.cast("double")) >= 0.995)), F.size(x)).alias("clipping"),
            share(F.size(F.filter(levels, lambda v: v >= F.greatest(F.lit(10 ** (floor_db / 20)), e["noise"] * 2))), F.size(levels)).alias("active"),
            (20 * F.log10((e["loud"] + 1e-8) / (e["noise"] + 1e-8))).alias("snr_db"),
        ))

    return let(frame_levels(x, frame), described)


def static_share(x: Column, frame: int, least: float = 0.05) -> Column:
    """The share of neighbouring frames whose mean absolute difference is below least."""

    def still(f: Column) -> Column:
        moves = F.transform(F.sequence(F.lit(1), F.size(f) - 1), lambda i: total(F.zip_with(F.element_at(f, i), F.element_at(f, i + 1), lambda a, b: F.abs(a - b))) / frame)
        return F.when(F.size(f) > 1, F.size(F.filter(moves, lambda v: v < least)) / (F.size(f) - 1)).otherwise(0.0)

    return let(frames(F.transform(x, lambda v: v.cast("double")), frame), still)


def by_position(df: DataFrame, vector: str, *by: str, sample: bool = True) -> DataFrame:
    """(by, mean, deviation, n): mean and standard deviation of each position, as arrays."""
    each = df.select(*by, F.posexplode(vector).alias("p", "v"))
    spread = F.stddev_samp("v") if sample else F.stddev_pop("v")
    per = each.groupBy(*by, "p").agg(F.avg(F.col("v").cast("double")).alias("m"), spread.alias("s"), F.count(F.lit(1)).alias("n"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("p", c))), lambda x: x[c])
    return per.groupBy(*by).agg(ordered("m").alias("mean"), ordered("s").alias("deviation"), F.max("n").alias("n"))
