"""Exact prefixes of ordered groups under limits on count and size, without ever sorting a whole group in one task.

The order of a group is given by a chain of integer bins. A histogram of each level is a small mergeable aggregate;
its running totals show which bins lie wholly within the limits, which lie beyond them, and which single bin the limit
falls into. Only that bin's rows go on to the next level, and only what is left at the end is ranked row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.joins import hot_keys, salted_join
from corpusloom.session import cut

BINS = 1024


def quality_rank(quality: Column) -> Column:
    """A 64-bit number that orders as the qualities do, best first: the bits of the double, with those of negative ones
    turned round, complemented. Null and NaN come last, after every number; 0.0 and -0.0 are equal."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), quality + F.lit(0.0)).cast("long")
    ordered = F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)
    return F.when(quality.isNull() | F.isnan(quality), F.lit(2**63 - 1)).otherwise(F.bitwise_not(ordered))


def quality_levels(quality: Column, tie: Column) -> list[Column]:
    """Bins that order by quality, best first and exactly, then by the 64-bit hash `tie`.

    The first level is the arc tangent of the quality in BINS steps, which parts usual scores well on any scale; the next
    ones are the bits of quality_rank, ten at a time, so that qualities that differ at all are told apart in the end.
    """
    arc = F.lit(BINS) - F.floor((F.atan(quality) / math.pi + 0.5) * BINS).cast("int")
    rank = quality_rank(quality).bitwiseXOR(F.lit(-(2**63)))
    bits = [F.shiftrightunsigned(rank, shift).bitwiseAND(F.lit(BINS - 1)).cast("int") for shift in (54, 44, 34, 24, 14, 4)]
    return [
        F.when(quality.isNull() | F.isnan(quality), F.lit(BINS + 1)).otherwise(arc),
        *bits,
        rank.bitwiseAND(F.lit(15)).cast("int"),
        *hash_levels(tie),
    ]


def hash_levels(tie: Column) -> list[Column]:
    """Bins that order by the upper bits of a 64-bit hash, read as unsigned."""
    high = F.shiftrightunsigned(tie, 44)
    return [F.shiftrightunsigned(high, 10).cast("int"), F.pmod(high, F.lit(BINS)).cast("int")]


def _cuts(hist: DataFrame, limits: DataFrame | None) -> DataFrame:
    """For each group that exceeds its limits, the bin they fall into and what lies before it.

    hist: g, bin, n, s, base_n, base_s, cap_n, cap_s. A group has at most BINS + 2 bins, whatever its size.
    """
    by = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("to_n", F.col("base_n") + F.sum("n").over(by)).withColumn("to_s", F.col("base_s") + F.sum("s").over(by))
    over = run.where((F.col("to_n") > F.col("cap_n")) | (F.col("to_s") > F.col("cap_s")))
    return over.groupBy("g", "cap_n", "cap_s").agg(F.min_by(F.struct("bin", (F.col("to_n") - F.col("n")).alias("before_n"), (F.col("to_s") - F.col("s")).alias("before_s"), "n"), "bin").alias("c")).select(
        "g", "cap_n", "cap_s", F.col("c.bin").alias("cut_bin"), F.col("c.before_n").alias("base_n"), F.col("c.before_s").alias("base_s"), F.col("c.n").alias("pending")
    )


def first_cut(hist: DataFrame, cap_n: Column | int, cap_s: Column | int) -> DataFrame:
    """The cut of each group over its limits, from its histogram (g, bin, n, s) at the first level."""
    as_long = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("long")
    return cut(_cuts(hist.select("g", "bin", "n", "s", as_long(cap_n).alias("cap_n"), as_long(cap_s).alias("cap_s"), F.lit(0).cast("long").alias("base_n"), F.lit(0).cast("long").alias("base_s")), None))


def take_prefix(rows: DataFrame, cuts: DataFrame, hist: DataFrame, levels: int, rank_limit: int = 100_000) -> DataFrame:
    """The rows within their group's limits.

    rows: g (null: not limited), s, order (a tie-free struct that agrees with the bins), b0 .. b<levels-1>; other
    columns are passed on. cuts: from first_cut. hist: the histogram of b0, from which hot groups are known.
    """
    hot = hot_keys(hist.groupBy("g").agg(F.sum("n").alias("n")), "g", "n")
    spread = F.xxhash64("order")
    small = cuts.select("g", "cap_n", "cap_s", "cut_bin", "base_n", "base_s")
    at = salted_join(rows.where("g is not null"), small, "g", hot, spread, "left")
    inside = at.where(F.col("cut_bin").isNull() | (F.col("b0") < F.col("cut_bin")))
    names = rows.columns
    kept = [rows.where("g is null"), inside.select(names)]
    open_rows = at.where(F.col("b0") == F.col("cut_bin"))
    level = 0
    most = cuts.agg(F.max("pending")).first()[0] or 0
    while most > rank_limit and level + 1 < levels:
        level += 1
        open_rows = cut(open_rows.drop("cut_bin"))
        deeper = open_rows.groupBy("g", F.col(f"b{level}").alias("bin"), "cap_n", "cap_s", "base_n", "base_s").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))
        nxt = cut(_cuts(deeper, None))
        heavy = hot_keys(open_rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g", "n")
        at = salted_join(open_rows.drop("cap_n", "cap_s", "base_n", "base_s"), nxt.drop("pending"), "g", heavy, spread, "left")
        kept.append(at.where(F.col("cut_bin").isNull() | (F.col(f"b{level}") < F.col("cut_bin"))).select(names))
        open_rows = at.where(F.col(f"b{level}") == F.col("cut_bin"))
        most = nxt.agg(F.max("pending")).first()[0] or 0
    by = Window.partitionBy("g").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    ranked = open_rows.withColumn("at_n", F.col("base_n") + F.count(F.lit(1)).over(by)).withColumn("at_s", F.col("base_s") + F.sum("s").over(by))
    kept.append(ranked.where((F.col("at_n") <= F.col("cap_n")) & (F.col("at_s") <= F.col("cap_s"))).select(names))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out
