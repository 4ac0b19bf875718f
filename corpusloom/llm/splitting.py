"""Problem 4: train, validation and test splits that never separate related records."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.identity import canonical_id
from corpusloom.llm.components import components
from corpusloom.plans.joins import hot_keys, salted_join
from corpusloom.session import cut

PROPORTIONS = {"train": 0.9, "validation": 0.05, "test": 0.05}
SHARD = 20_000
#: Shards whose bins one task joins.
FAN = 64
#: Bins that are dealt to the splits: shares are met to about half a bin.
BINS = 400


@dataclass(frozen=True)
class Groups:
    """records: id, group, speakers of the group. groups: group, records, speakers."""

    records: DataFrame
    groups: DataFrame


def related_groups(records: DataFrame, id_col: str = "clip_id", speaker_col: str = "speaker_id", session_col: str = "session_id") -> Groups:
    """Join records that share a speaker or a session, directly or through others, into groups.

    The graph has a node for each speaker and session and an edge for each pair that occurs, so it is as large as the
    distinct pairs, not as the records. A group is named by the smallest id of its records, by code point.

    Defined cases: rows equal in id, speaker and session count once. Ids that differ in case, separators, white space
    or width are one; null, empty and words for "not known" are no id. A record with neither speaker nor session is a
    group of its own, without speakers; a record without an id belongs to its group but cannot name it: a group whose
    records all lack ids has a null name. An empty table gives empty results. Other columns are not read.
    """
    rows = records.select(F.col(id_col).alias("id"), canonical_id(F.col(speaker_col)).alias("p"), canonical_id(F.col(session_col)).alias("e")).distinct()
    rows = rows.withColumns({"p": F.concat(F.lit("p"), "p"), "e": F.concat(F.lit("s"), "e")})
    pairs = cut(rows.groupBy("p", "e").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = cut(components(pairs.select(F.col("p").alias("a"), F.col("e").alias("b"))))
    key = F.coalesce("p", "e")
    nodes = pairs.select(key.alias("node"), "p", "first", "n").where("node is not null").groupBy("node").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("p").alias("named"))
    labelled = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # distinct speakers of a component: its speaker nodes; a session without a speaker is a node that is none
    named = cut(labelled.groupBy("root").agg(F.min("first").alias("group_id"), F.sum("n").alias("records"), F.count(F.when(F.col("named") > 0, True)).alias("speakers")))
    of_node = labelled.select("node", "root").join(named.select("root", "group_id", "speakers"), "root").select("node", "group_id", "speakers")
    hot = hot_keys(nodes, "node", "n")
    known = rows.withColumn("node", key)
    joined = salted_join(known.where("node is not null").select("id", "node"), of_node, "node", hot, F.xxhash64("id"))
    alone = known.where("node is null").groupBy("id").agg(F.count(F.lit(1)).alias("records"))
    out = joined.select("id", "group_id", "speakers").unionByName(alone.select("id", F.col("id").alias("group_id"), F.lit(0).cast("long").alias("speakers")))
    groups = named.select("group_id", "records", "speakers").unionByName(alone.select(F.col("id").alias("group_id"), "records", F.lit(0).cast("long").alias("speakers")))
    return Groups(out, groups)


def difference_bins(weights: list[int], bins: int) -> list[list[int]]:
    """Positions of the weights in `bins` nearly equal bins, by the largest differencing method.

    Every weight starts as a partial solution of its own; the two partial solutions with the largest spread are
    joined, the fullest bin of the one with the emptiest of the other, until one is left.
    """
    if not weights:
        return [[] for _ in range(bins)]
    heap = [(-w, k, [(w, [k])]) for k, w in enumerate(weights)]  # bins that hold something, heaviest first; the rest are empty
    heapq.heapify(heap)
    serial = len(weights)
    while len(heap) > 1:
        _, _, x = heapq.heappop(heap)
        _, _, y = heapq.heappop(heap)
        extra = len(x) + len(y) - bins
        if extra > 0:  # the lightest bins of x take the lightest of y, crosswise
            x, low = x[: len(x) - extra], x[len(x) - extra :]
            y, high = y[: len(y) - extra], y[len(y) - extra :]
            pairs = [(a + b, m + n) for (a, m), (b, n) in zip(low, reversed(high))]
            # x's remaining bins are heavier than all of low: they stay alone, as do y's
            z = sorted(x + y + pairs, key=lambda t: -t[0])
        else:
            z = sorted(x + y, key=lambda t: -t[0])
        spread = z[0][0] - (z[-1][0] if len(z) == bins else 0)
        serial += 1
        heapq.heappush(heap, (-spread, serial, z))
    done = [members for _, members in heap[0][2]]
    return done + [[] for _ in range(bins - len(done))]


def balance_splits(groups: DataFrame, proportions: dict[str, float] | None = None, bins: int = BINS, shard: int = SHARD, group_col: str = "group_id", weight_col: str = "records") -> DataFrame:
    """(group, weight, split): whole groups in splits of the given proportions of the total weight.

    Method: largest-differencing balance. Groups are hashed to shards of about `shard` groups; each shard is balanced
    into `bins` bins by differencing, in a task of its own; the bins of FAN shards at a time are then joined to one set,
    lightest with heaviest, in tasks again, until one set is left; whole bins go to the splits by proportion, the
    heaviest to the split that lacks most. Groups heavier than a bin should be are bins of their own.

    Defined cases: null weights count as 0, equal names as one group with the sum of their weights; proportions are
    normalised; an empty table gives an empty result. Collected are at most 2 * `bins` sums, whatever the number of groups.
    """
    want = proportions or PROPORTIONS
    whole = sum(want.values())
    want = {k: v / whole for k, v in want.items()}
    spark = groups.sparkSession
    base = groups.groupBy(F.col(group_col).alias("group_id")).agg(F.coalesce(F.sum(weight_col), F.lit(0)).cast("long").alias("weight"))
    base = cut(base)
    size = base.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    fair = max(1, size.w // bins)
    giants = base.where(F.col("weight") > fair)  # fewer than `bins` rows
    shards = max(1, -(-size.n // shard))

    def one_shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["weight", "group_id"], ascending=[False, True], kind="stable", na_position="last")
        at = [0] * len(frame)
        for k, members in enumerate(difference_bins(frame["weight"].tolist(), bins)):
            for m in members:
                at[m] = k
        return frame.assign(bin=at)

    rest = base.where(F.col("weight") <= fair).withColumn("shard", F.pmod(F.xxhash64("group_id"), F.lit(shards)))
    placed = cut(rest.groupBy("shard").applyInPandas(one_shard, "group_id string, weight long, shard long, bin int"))
    level, steps = placed.groupBy("shard", "bin").agg(F.sum("weight").alias("weight")), []
    while shards > 1:  # trees of tasks: FAN shards give one set of bins, until one set is left
        step = cut(level.withColumn("up", F.floor(F.col("shard") / FAN).cast("long")).groupBy("up").applyInPandas(_merger(bins), "shard long, bin int, weight long, up long, slot int"))
        steps.append(step)
        level, shards = step.groupBy(F.col("up").alias("shard"), F.col("slot").alias("bin")).agg(F.sum("weight").alias("weight")), -(-shards // FAN)
    # at most `bins` sums and fewer than `bins` giants
    items = [(r.weight, None, r.bin) for r in level.collect()] + [(g.weight, g.group_id, None) for g in giants.collect()]
    items.sort(key=lambda t: (-t[0], str(t[1]), t[2] or 0))
    have = dict.fromkeys(want, 0.0)
    rows, big = [], []
    for w, name, slot in items:
        to = max(want, key=lambda k: (want[k] * size.w - have[k], want[k]))
        have[to] += w
        if slot is None:
            big.append((name, to))
        else:
            rows.append((0, slot, to))
    where = F.broadcast(spark.createDataFrame(rows, "shard long, bin int, split string"))
    heavy = spark.createDataFrame(big, "group_id string, split string")
    for step in reversed(steps):
        where = step.join(where.select(F.col("shard").alias("up"), F.col("bin").alias("slot"), "split"), ["up", "slot"]).select("shard", "bin", "split")
    return placed.join(where, ["shard", "bin"]).select("group_id", "weight", "split").unionByName(giants.join(F.broadcast(heavy), giants["group_id"].eqNullSafe(heavy["group_id"])).select(giants["group_id"], "weight", "split"))


def _merger(bins: int):
    """A function that joins the bins of several shards to one set, the lightest so far with the heaviest of the next."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total, slots, parts = [0] * bins, list(range(bins)), []
        for _, own in frame.sort_values(["shard", "weight", "bin"], ascending=[True, False, True]).groupby("shard"):
            slots.sort(key=lambda k: (total[k], k))
            taken = slots[: len(own)]
            for k, w in zip(taken, own["weight"].tolist()):
                total[k] += w
            parts.append(own.assign(slot=taken))
        return pd.concat(parts)[["shard", "bin", "weight", "up", "slot"]]

    return merge


def assign_splits(records: DataFrame, proportions: dict[str, float] | None = None, id_col: str = "clip_id", speaker_col: str = "speaker_id", session_col: str = "session_id", bins: int = BINS) -> DataFrame:
    """(id, group_id, split) of every record, see related_groups and balance_splits."""
    found = related_groups(records, id_col, speaker_col, session_col)
    of = balance_splits(found.groups, proportions, bins)
    held = cut(found.records)
    hot = hot_keys(held.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "group_id", "n")
    named = salted_join(held.where("group_id is not null").select("id", "group_id"), of.where("group_id is not null").select("group_id", "split"), "group_id", hot, F.xxhash64("id"))
    lost = held.where("group_id is null").select("id", "group_id").join(F.broadcast(of.where("group_id is null").select("split").limit(1)))
    return named.select("id", "group_id", "split").unionByName(lost.select("id", "group_id", "split")).withColumnRenamed("id", id_col)

