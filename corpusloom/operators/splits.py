"""Deterministic splits by hash and by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.identity import canonical_split
from corpusloom.operators.sampling import places, running
from corpusloom.plans.joins import hot_keys, salted_join


def hash_bucket(text: Column, modulus: int) -> Column:
    """The first eight hex digits of SHA-256, as a number, modulo."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % modulus


def by_cuts(bucket: Column, train: int, validation: int) -> Column:
    """train below the first cut, validation below the second, else test."""
    return F.when(bucket < train, "train").when(bucket < validation, "validation").otherwise("test")


def speaker_split(speaker: Column, prefix: str = "common-voice-split-v1:") -> Column:
    """90/5/5 by salted hash of the speaker."""
    return by_cuts(hash_bucket(F.concat(F.lit(prefix), speaker), 10_000), 9_000, 9_500)


def parent_split(parent: Column) -> Column:
    """90/5/5 by hash of the parent."""
    return by_cuts(hash_bucket(parent, 100), 90, 95)


def ranked_split(df: DataFrame, parent: str, validation: float = 0.05, test: float = 0.05, salt: str = "") -> DataFrame:
    """(parent, split): parents in hash order; the first share is validation, the next test, at least one each.

    Only one row a parent is ranked, in ranges of the hash. Fewer than three parents cannot be split: all are train.
    """
    parents = df.where(F.col(parent).isNotNull()).select(F.col(parent).alias("parent")).distinct()
    ranked = places(parents.withColumn("h", F.sha2(F.concat(F.lit(salt), "parent"), 256)), "h", "parent")
    n = F.lit(ranked.count())
    held = lambda f: F.greatest(F.lit(1), F.bround(n * f).cast("int"))
    split = F.when(n < 3, "train").when(F.col("place") < held(validation), "validation").when(F.col("place") < held(validation) + held(test), "test").otherwise("train")
    return ranked.select("parent", split.alias("split"))


def stratified_holdout(df: DataFrame, group: str, row_id: str, share: float, seed: str) -> DataFrame:
    """df with held: within each group, in hash order, round(n * share) rows, at least 1 and at most n - 1.

    Ranks are running counts over ranges, so a group that holds a large part of the rows is ranked by many tasks.
    """
    rows = df.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(row_id)), 256)).withColumn("__one", F.lit(1))
    ranked = running(rows, group, ["__h", row_id], "__one", "__rank")
    sizes = df.groupBy(F.col(group).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    most = F.when(F.col("__n") == 1, 0).otherwise(F.least(F.col("__n") - 1, F.greatest(F.lit(1), F.bround(F.col("__n") * share).cast("long"))))
    hot = hot_keys(sizes.select(F.col("__of").alias("__k"), "__n"), "__k", "__n")
    joined = salted_join(ranked.withColumn("__k", F.col(group)).where(F.col(group).isNotNull()), sizes.select(F.col("__of").alias("__k"), "__n"), "__k", hot, F.xxhash64(row_id))
    lost = ranked.where(F.col(group).isNull()).join(F.broadcast(sizes.where("__of is null").select("__n")))
    out = joined.drop("__k").unionByName(lost)
    return out.withColumn("held", F.col("__rank") <= most).drop("__h", "__one", "__rank", "__n")


def split_names(split: Column) -> Column:
    """Canonical split names; what is no split is null."""
    return canonical_split(split)


def crossing(df: DataFrame, key: str, split: str) -> DataFrame:
    """(value, splits) of every key value that lies in more than one split; must be empty for a sound split."""
    return df.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.array_sort(F.collect_set(split)).alias("splits")).where("size(splits) > 1")


def fixed_or_hashed(df: DataFrame, fixed: DataFrame, parent: str) -> DataFrame:
    """df with split: from fixed (parent, split) where it has the parent, otherwise by hash."""
    known = fixed.select(F.col("parent").alias("__parent"), F.col("split").alias("__split"))
    joined = df.join(known, F.col(parent) == F.col("__parent"), "left")
    return joined.withColumn("split", F.coalesce("__split", parent_split(F.col(parent)))).drop("__parent", "__split")
