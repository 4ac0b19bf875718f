"""Samples, caps, batches and thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut


def hash_order(version: str, row_id: Column) -> Column:
    """A fixed order that has nothing to do with the rows."""
    return F.sha2(F.concat_ws(":", F.lit(version), row_id), 256)


def hash_sample(df: DataFrame, row_id: str, n: int, version: str) -> DataFrame:
    """The first n rows in hash order: a top-k, never a full sort."""
    return df.orderBy(hash_order(version, F.col(row_id)), row_id).limit(n)


def running(df: DataFrame, group: str | None, order: list[str], size: str, out: str = "run") -> DataFrame:
    """df with the total of size, within its group and in order, up to and with each row. order must be total.

    The rows are cut into ranges of (group, order), each of which is totalled on its own and begins after what the ranges
    before it hold of its first group; so no task sees a whole group. Only ranges that begin inside a group need that,
    at most one group each, and these few totals are broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group] if group else []
    parts = cut(df.repartitionByRange(n, *keys, *order).withColumn("__p", F.spark_partition_id()))
    same = (lambda c, d: F.col(c).eqNullSafe(F.col(d))) if group else (lambda c, d: F.lit(True))
    sums = parts.groupBy("__p", *keys).agg(F.sum(size).alias("__s"))
    of = Window.partitionBy(*keys).orderBy("__p")
    before = sums.withColumn("__before", F.sum("__s").over(of) - F.col("__s")).withColumn("__first", F.row_number().over(of))
    before = before.where("__first > 1").select(F.col("__p").alias("__q"), *[F.col(k).alias("__same") for k in keys], "__before")
    within = F.sum(size).over(Window.partitionBy("__p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = parts.withColumn("__within", within).join(F.broadcast(before), (F.col("__p") == F.col("__q")) & (same(group, "__same") if group else F.lit(True)), "left")
    return joined.withColumn(out, F.coalesce("__before", F.lit(0)) + F.col("__within")).drop("__p", "__q", "__same", "__before", "__within")


def _folded(rows: DataFrame) -> DataFrame:
    """(g, i) kept of rows (g, o, i, s, room), group by group in order; for groups of a bounded size."""
    items = F.array_sort(F.collect_list(F.struct("o", "i", "s")))
    start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<string>").alias("k"))
    take = lambda a, x: F.struct((a["t"] + x["s"]).alias("t"), F.concat(a["k"], F.array(x["i"].cast("string"))).alias("k"))
    folded = rows.groupBy("g").agg(items.alias("items"), F.first("room").alias("room"))
    return folded.select("g", F.explode(F.aggregate("items", start, lambda a, x: F.when(a["t"] + x["s"] <= F.col("room"), take(a, x)).otherwise(a))["k"]).alias("i"))


def greedy_cap(df: DataFrame, group: str, row_id: str, size: Column, order: list[Column], cap: int, bound: int = 20_000) -> DataFrame:
    """(group, id) of the rows kept: in order, each row that still fits under the cap; a row that does not is skipped
    and later ones are tried. size: whole units, null counts as too large. Ids are told apart within a group.

    Groups of at most `bound` rows are folded. In larger ones all rows before the first that does not fit are kept at
    once, found by running totals over ranges; after it only rows that fit into what is left stay candidates, and the
    step is repeated until at most `bound` candidates of a group are left, which are folded. No task sees a whole group.
    """
    key = F.col(group).cast("string")
    rows = df.select(key.alias("g"), F.col(row_id).cast("string").alias("i"), size.cast("long").alias("s"), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]).alias("o"), F.lit(cap).cast("long").alias("room")).where(F.col("s") <= cap)
    rows = cut(rows)
    large = lambda r: r.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("g")
    marked = lambda r, big: r.join(F.broadcast(big.withColumnRenamed("g", "__g")), F.col("g").eqNullSafe(F.col("__g")), "left").withColumn("big", F.col("__g").isNotNull() | (F.lit(len(big.where("g is null").take(1)) > 0) & F.col("g").isNull())).drop("__g")
    big = cut(large(rows))  # at most one group for every `bound` rows
    if big.isEmpty():
        out = _folded(rows)
        return out.select(F.col("g").cast(df.schema[group].dataType).alias(group), F.col("i").alias(row_id))
    split = marked(rows, big)
    kept = [_folded(split.where("not big").drop("big"))]
    left = split.where("big").drop("big")
    while True:
        run = cut(running(left, "g", ["o", "i"], "s"))
        over = run.where("run > room").groupBy("g").agg(F.min(F.struct("o", "i")).alias("stop")).withColumnRenamed("g", "__g")
        at = run.join(F.broadcast(over), F.col("g").eqNullSafe(F.col("__g")), "left").drop("__g")
        fits = F.col("stop").isNull() | (F.struct("o", "i") < F.col("stop"))
        kept.append(at.where(fits).select("g", "i"))
        used = at.where(fits & F.col("stop").isNotNull()).groupBy("g").agg(F.sum("s").alias("used")).withColumnRenamed("g", "__g")
        rest = at.where(~fits & (F.struct("o", "i") > F.col("stop"))).join(F.broadcast(used), F.col("g").eqNullSafe(F.col("__g")), "left")
        left = cut(rest.withColumn("room", F.col("room") - F.coalesce("used", F.lit(0))).where(F.col("s") <= F.col("room")).select("g", "i", "s", "o", "room"))
        big = cut(large(left))
        if big.isEmpty():
            kept.append(_folded(left))
            break
        split = marked(left, big)
        kept.append(_folded(split.where("not big").drop("big")))
        left = split.where("big").drop("big")
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.select(F.col("g").cast(df.schema[group].dataType).alias(group), F.col("i").alias(row_id))


def until_reached(df: DataFrame, order: list[Column], size: Column, target: int, buckets: int = 256) -> DataFrame:
    """Rows in order until their sizes reach the target; the row that reaches it is the last.

    The running total is two-level: totals of hash buckets first, then rows within a bucket, so no task sees all rows.
    order[0] must be a hex hash.
    """
    rows = df.withColumn("__s", size.cast("long")).withColumn("__b", F.conv(F.substring(order[0], 1, 2), 16, 10).cast("int") * buckets / 256)
    rows = rows.withColumn("__b", F.floor("__b"))
    before = rows.groupBy("__b").agg(F.sum("__s").alias("__t"))
    before = before.withColumn("__before", F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")).select("__b", "__before")
    joined = rows.join(F.broadcast(before), "__b").where(F.col("__before") < target)
    run = F.sum("__s").over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("__run", F.col("__before") + run - F.col("__s")).where(F.col("__run") < target).drop("__b", "__s", "__before", "__run")


def places(df: DataFrame, *order: str) -> DataFrame:
    """df with place: the position of each row in the order, from 0. The order must be total.

    Ranges of the order are ranked each on its own, and begin after the rows of those before, so no task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.join(F.broadcast(before), "__p").withColumn("place", F.col("__before") + rank - 1).drop("__p", "__before")


def first_k(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group by the order, which is total. The window's own limit of a group runs before the
    shuffle, so no task sees more than k rows a group of each partition."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def least_k(df: DataFrame, by: str, order: Column, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the least order, the least tie column among equal ones."""
    return first_k(df.withColumn("__o", order), [by], ["__o", tie], k).drop("__o")


def drawn_siblings(df: DataFrame, group: str, row_id: str, k: int, seed: str, bins: int = 64) -> DataFrame:
    """(target, choice): for every row of a group, k of the group's other rows, or all where there are fewer, drawn by
    the target's own seed. Rows without a group draw none and are drawn by none. row_id must be unique.

    The rows of a group are numbered, in bins, so that no task sees a whole group; a target draws numbers, each among
    those that it has not drawn, and looks up their rows: no pairs within a group are formed.
    """
    rows = df.select(F.col(group).alias("__g"), F.col(row_id).alias("__i")).where(F.col("__g").isNotNull()).withColumn("__b", F.pmod(F.xxhash64("__i"), F.lit(bins)))
    sizes = rows.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__c"))
    bins_of = Window.partitionBy("__g")
    sizes = sizes.select("__g", "__b", (F.sum("__c").over(bins_of.orderBy("__b")) - F.col("__c")).alias("__before"), F.sum("__c").over(bins_of).alias("__n"))
    numbered = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__i"))).join(sizes, ["__g", "__b"])
    numbered = numbered.select("__g", "__i", "__n", (F.col("__before") + F.col("__r") - 1).alias("__r"))
    drawn: list[Column] = [F.col("__r")]
    for draw in range(k):
        left = F.col("__n") - 1 - draw
        number = F.pmod(F.xxhash64(F.lit(f"{seed}:{draw}"), "__i"), F.when(left > 0, left))
        drawn.append(F.aggregate(F.array_sort(F.array(*drawn)), number, lambda a, x: F.when(x <= a, a + 1).otherwise(a)))
        numbered = numbered.withColumn(f"__d{draw}", drawn[-1])
        drawn[-1] = F.col(f"__d{draw}")
    asked = numbered.select("__g", F.col("__i").alias("target"), F.explode(F.array(*drawn[1:])).alias("__r")).where(F.col("__r").isNotNull())
    return asked.join(numbered.select("__g", "__r", F.col("__i").alias("choice")), ["__g", "__r"]).select("target", "choice")


def duration_batches(df: DataFrame, group: str, row_id: str, frames: Column, budget: int, most: int, block: int = 20_000) -> DataFrame:
    """(group, id, batch): rows sorted by length; a batch is closed before it would pass the budget or at `most` rows.
    Rows without a group are a group of their own.

    Where a batch ends depends only on where it starts, and it has at most `most` rows. So the ordered rows of all groups
    are cut into blocks, each of which tells for each of its first `most` rows, were a batch to start there, where the
    first batch of the next block starts; these short answers are followed block by block, and then every block marks its
    own starts. No task sees a whole group.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    block = max(block, most)
    rows = df.select(key.alias("k"), F.col(group).alias("g"), F.col(row_id).alias("i"), frames.cast("long").alias("n"))
    placed = places(rows, "k", "n", "i").withColumn("block", F.floor(F.col("place") / block))
    ahead = (F.col("place") % block < most - 1) & (F.col("block") > 0)
    blocks = F.when(ahead, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))
    copies = cut(placed.withColumn("own", F.col("block")).withColumn("block", F.explode(blocks)))

    def ends(part: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray]:
        """The block in order, how many rows are its own, and for each row the place after a batch that starts there."""
        part = part.sort_values("place")
        k, n = part["k"].to_numpy(), part["n"].to_numpy()
        length, total, open_ = np.ones(len(part), dtype=np.int64), n.copy(), np.ones(len(part), dtype=bool)
        for c in range(1, min(most, len(part))):
            open_[-c:] = False
            total[:-c] += n[c:]
            open_[:-c] &= (k[:-c] == k[c:]) & (total[:-c] <= budget)
            length += open_
        return part, int((part["own"] == part["block"]).sum()), np.arange(len(part)) + length

    def answers(part: pd.DataFrame) -> pd.DataFrame:
        part, own, after = ends(part)
        out = np.zeros(max(own, most), dtype=np.int64)
        for j in range(own - 1, -1, -1):
            out[j] = after[j] - own if after[j] >= own else out[after[j]]
        return pd.DataFrame({"block": [part["block"].iloc[0]], "leads": [out[:most].tolist()]})

    def followed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        entry, entries = 0, []
        for leads in part["leads"]:
            entries.append(entry)
            entry = int(leads[entry])
        return pd.DataFrame({"block": part["block"], "entry": entries})

    def marked(part: pd.DataFrame) -> pd.DataFrame:
        part, own, after = ends(part)
        starts, j = np.zeros(len(part), dtype=np.int64), int(part["entry"].iloc[0])
        while j < own:
            starts[j], j = 1, after[j]
        return part.assign(start=starts)[["k", "i", "place", "block", "start"]].iloc[:own]

    told = copies.select("block", "own", "place", "k", "n").groupBy("block").applyInPandas(answers, "block long, leads array<long>")
    entries = told.groupBy((F.col("block") * 0).alias("all")).applyInPandas(followed, "block long, entry long")
    kind = rows.schema["i"].dataType.simpleString()
    starts = cut(copies.drop("g").join(F.broadcast(entries), "block").groupBy("block").applyInPandas(marked, f"k string, i {kind}, place long, block long, start long"))
    sums = starts.groupBy("k", "block").agg(F.sum("start").alias("c"))
    before = sums.select("k", "block", (F.sum("c").over(Window.partitionBy("k").orderBy("block")) - F.col("c")).alias("before"))
    within = F.sum("start").over(Window.partitionBy("k", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    name = F.when(F.col("k") != "", F.substr("k", F.lit(2))).cast(rows.schema["g"].dataType)
    return starts.withColumn("within", within).join(before, ["k", "block"]).select(name.alias(group), F.col("i").cast("string").alias(row_id), (F.col("before") + F.col("within") - 1).cast("int").alias("batch"))


def ranked_batches(batches: DataFrame, batch: str, ranks: int, seed: str, epoch: int = 0, drop_remainder: bool = True) -> DataFrame:
    """batches with rank and step: the batches of one set, numbered from 0, in an order seeded by the epoch, dealt to
    ranks in turn. With drop_remainder the last batches that do not fill a round are left out, by number, so that every
    rank has as many."""
    n = batches.agg(F.countDistinct(batch)).first()[0]
    usable = n - n % ranks if drop_remainder else n
    order = places(batches.select(batch).distinct().where(F.col(batch) < usable).withColumn("__h", F.sha2(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), F.col(batch).cast("string")), 256)), "__h", batch)
    dealt = order.select(batch, F.pmod("place", F.lit(ranks)).cast("int").alias("rank"), F.floor(F.col("place") / ranks).cast("int").alias("step"))
    return batches.join(dealt, batch)


def clamped(value: Column, low: float, high: float) -> Column:
    """value within low..high."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
