"""Problem 2: a mix of sources with given shares of the total size, small sources repeated a capped number of times."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.identity import canonical_id, micros
from corpusloom.llm.prefix import first_cut, hash_levels, take_prefix
from corpusloom.plans.joins import bounded
from corpusloom.session import cut

MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Mix:
    """sources: one row a target source, with its demand, what it can give, its weight and what it gave.
    records: the chosen records with the number of their uses."""

    sources: DataFrame
    records: DataFrame


def tempered(sizes: list[float], targets: list[float], exponent: float) -> list[float]:
    """Weights s * (t / s) ** exponent, normalised: natural shares at 0, the targets at 1. Empty sources get 0."""
    raw = [s ** (1 - exponent) * t**exponent if s > 0 and t > 0 else 0.0 for s, t in zip(sizes, targets)]
    total = math.fsum(raw)
    return [x / total if total else 0.0 for x in raw]


def entropy(weights: list[float]) -> float:
    """In nats."""
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def bisect_exponent(good, steps: int = 60) -> float:
    """The largest exponent in 0..1 at which good(exponent) holds, where it holds below some point; 0 if nowhere."""
    if good(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def beyond_limits(sizes: list[float], targets: list[float], repeats: list[int], budget: float, exponent: float) -> list[bool]:
    """Which sources would need more than their repetition limits allow at this exponent. At 1 the targets are taken as
    they are, so a source without any records is beyond its limit; below, it has no weight."""
    w = targets if exponent >= 1 else tempered(sizes, targets, exponent)
    return [x * budget > s * r for x, s, r in zip(w, sizes, repeats)]


def plan_weights(
    sizes: list[float], targets: list[float], repeats: list[int], budget: float | None, least_entropy: float | None = None
) -> tuple[float, float, list[float]]:
    """(exponent, budget, amounts): how much to take of each source.

    Without a budget the targets are met exactly, over the sources that have anything, with the largest budget that
    the repetition limits allow. With one, the exponent is bisected until no source needs more than its limit (and the
    entropy of the weights is at least least_entropy, where that is given); what the limits then still forbid is given
    to the sources that have room, in proportion to their weights.
    """
    room = [s * r for s, r in zip(sizes, repeats)]
    if not any(s > 0 and t > 0 for s, t in zip(sizes, targets)):
        return 1.0, 0.0, [0.0] * len(sizes)
    if budget is None:
        w = tempered(sizes, targets, 1.0)
        exponent = 1.0
        if least_entropy is not None and entropy(w) < least_entropy:
            exponent = bisect_exponent(lambda e: entropy(tempered(sizes, targets, e)) >= least_entropy)
            w = tempered(sizes, targets, exponent)
        budget = min(c / x for c, x in zip(room, w) if x > 0)
        return exponent, budget, [x * budget for x in w]

    def fits(e: float) -> bool:
        w = tempered(sizes, targets, e)
        return all(x * budget <= c * (1 + 1e-12) for x, c in zip(w, room)) and (least_entropy is None or entropy(w) >= least_entropy)

    exponent = bisect_exponent(fits)
    if not fits(exponent):
        exponent = 1.0  # no exponent fits: hold to the targets, and fill what the limits leave
    w = tempered(sizes, targets, exponent)
    amounts, left, free = [0.0] * len(w), budget, [x > 0 for x in w]
    while left > 1e-9 * budget and any(free):
        share = math.fsum(x for x, f in zip(w, free) if f)
        full = False
        for i, f in enumerate(free):
            if f and amounts[i] + left * w[i] / share >= room[i]:
                full = True
        if not full:
            amounts = [a + left * x / share if f else a for a, x, f in zip(amounts, w, free)]
            break
        grow = min((room[i] - amounts[i]) / (w[i] / share) for i, f in enumerate(free) if f)
        grow = min(grow, left)
        amounts = [a + grow * x / share if f else a for a, x, f in zip(amounts, w, free)]
        free = [f and amounts[i] < room[i] * (1 - 1e-12) for i, f in enumerate(free)]
        left -= grow
    return exponent, budget, amounts


def mix_sources(
    records: DataFrame,
    targets: DataFrame,
    id_col: str = "clip_id",
    source_col: str = "source_dataset",
    size_col: str = "duration_seconds",
    share_col: str = "target_share",
    repeats_col: str = "max_repeats",
    budget: float | str | None = None,
    least_entropy: float | None = None,
    seed: int = 0,
    rank_limit: int = 100_000,
) -> Mix:
    """Choose records, with repetition, so that each target source gives its share of the total size.

    Method: temperature mixing. The weights lie on the path from the sources' natural shares (exponent 0) to the
    target shares (exponent 1); the exponent is bisected to the repetition limits and a least entropy, see
    plan_weights. The weights are realised as block permutations: each source is one fixed permutation by a seeded
    hash, cut into blocks; whole passes over it come first, then the blocks that fit the rest of its budget, and the
    block in which the budget ends is taken record by record. budget: the total size of the mix; "all": the size of
    all records; "targets": the size of all records of target sources; None: the largest with which the target shares
    are exact. short: the sources that stop the bisection at the target shares, as they would need more than their limit.

    Defined cases: whole-row duplicates (equal id, source and size) count once. Source ids are compared in canonical
    form; records of other or unknown sources are not used but count in the total size. Unknown sizes count as 0, and
    records of size 0 are never chosen: they give no share. A null share counts as 0, null or negative repeats as 0;
    of two targets for one source the one with the larger share holds. A source without records has demand but gives
    nothing. The targets are collected: at most MAX_SOURCES rows, which is checked.
    """
    if not bounded(targets, MAX_SOURCES):
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    spark = records.sparkSession
    rows = (
        records.select(F.col(id_col).alias("id"), F.col(source_col).alias("spelling"), F.col(size_col).alias("size"))
        .dropDuplicates(["id", "spelling", "size"])
        .select("id", canonical_id(F.col("spelling")).alias("g"), F.xxhash64(F.lit(seed), "id").alias("h"), micros(F.col("size")).alias("s"))
    )
    bins = hash_levels(F.col("h"))
    hist = cut(rows.groupBy("g", bins[0].alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")))
    wanted = targets.select(
        F.col(source_col).alias("source"), canonical_id(F.col(source_col)).alias("g"),
        F.greatest(F.coalesce(F.col(share_col).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("t"),
        F.greatest(F.coalesce(F.col(repeats_col).cast("int"), F.lit(0)), F.lit(0)).alias("r"),
    ).where("g is not null")
    wanted = wanted.groupBy("g").agg(F.max(F.struct("t", "r", "source")).alias("x")).select("g", "x.*")
    total = hist.agg(F.sum("s")).first()[0] or 0
    had = hist.groupBy("g").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    per = wanted.join(had, "g", "left").select("g", "source", "t", "r", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).alias("s")).orderBy("g").collect()
    sizes, shares, repeats = [float(p.s) for p in per], [p.t for p in per], [p.r for p in per]
    asked = None if budget is None else float(total) if budget == "all" else sum(sizes) if budget == "targets" else float(budget) * 1e6
    exponent, given, amounts = plan_weights(sizes, shares, repeats, asked, least_entropy)
    stops = beyond_limits(sizes, shares, repeats, float(total) if asked is None else asked, 1.0)
    plan = []
    for p, amount, stop in zip(per, amounts, stops):
        passes = min(p.r, int(amount * (1 + 1e-12) // p.s)) if p.s else 0
        rest = int(round(amount)) - passes * p.s if p.s and passes < p.r else 0
        plan.append(Row(g=p.g, source=p.source, target_share=p.t, max_repeats=p.r, records=p.n, micros=p.s, demand=p.t * (asked if asked is not None else total), passes=passes, rest=max(0, rest), exponent=exponent, short=stop))
    schema = T.StructType([T.StructField(n, t) for n, t in (("g", T.StringType()), ("source", T.StringType()), ("target_share", T.DoubleType()), ("max_repeats", T.IntegerType()), ("records", T.LongType()), ("micros", T.LongType()), ("demand", T.DoubleType()), ("passes", T.IntegerType()), ("rest", T.LongType()), ("exponent", T.DoubleType()), ("short", T.BooleanType()))])
    plans = spark.createDataFrame(plan, schema)
    part = F.broadcast(plans.where("rest > 0").select("g", F.lit(2**62).alias("cap_n"), F.col("rest").alias("cap_s")))
    cuts = first_cut(hist.join(part, "g"), F.col("cap_n"), F.col("cap_s"))
    usable = rows.where("s > 0").select("g", "id", "s", F.struct(F.shiftrightunsigned("h", 44).alias("k"), F.col("h"), F.coalesce(F.col("id"), F.lit("")).alias("id")).alias("order"), bins[0].alias("b0"), bins[1].alias("b1"))
    chosen = take_prefix(usable.join(part.select("g"), "g", "left_semi"), cuts, hist.where("g is not null"), 2, rank_limit).select("id", "g", "s", F.lit(1).alias("extra"))
    whole = usable.join(F.broadcast(plans.where("passes > 0").select("g", "passes")), "g").select("id", "g", "s", F.col("passes").alias("extra"))
    uses = whole.unionByName(chosen).groupBy("id", "g", "s").agg(F.sum("extra").cast("int").alias("uses"))
    gave = uses.groupBy("g").agg(F.sum(F.col("s") * F.col("uses")).alias("used"), F.max("uses").alias("most"), F.count(F.lit(1)).alias("chosen"))
    made = gave.agg(F.sum("used").alias("mix"))
    sources = (
        plans.join(gave, "g", "left")
        .join(F.broadcast(made))
        .select(
            F.col("source").alias(source_col), "target_share", "max_repeats", "records", (F.col("micros") / 1e6).alias("seconds"),
            (F.col("demand") / 1e6).alias("demand_seconds"),
            "short", "exponent", F.coalesce("chosen", F.lit(0)).alias("records_used"), F.coalesce("most", F.lit(0)).alias("most_uses"),
            (F.coalesce("used", F.lit(0)) / 1e6).alias("mix_seconds"),
            F.when(F.col("mix") > 0, F.coalesce("used", F.lit(0)) / F.col("mix")).otherwise(0.0).alias("actual_share"),
        )
    )
    names = F.broadcast(plans.select("g", "source"))
    return Mix(sources, uses.join(names, "g").select(F.col("id").alias(id_col), F.col("source").alias(source_col), (F.col("s") / 1e6).alias("seconds"), "uses"))
