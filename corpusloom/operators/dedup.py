"""Duplicates: the first row of each key stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.joins import hot_keys, salted_join


def mark_duplicates(df: DataFrame, key: str, order: list[str], code_of: str = "duplicate_of") -> DataFrame:
    """df with the id of the first row of its key in code_of, null for that row itself and for null keys.

    The first rows are one aggregate with partial sums, joined back, so a hot key is never sorted in one task: the
    order columns are compared as a struct, and the first of them is the id. Keys that many rows share are salted.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*order)).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    hot = hot_keys(firsts, "__key", "__n")
    joined = salted_join(df.withColumn("__key", F.col(key)), firsts, "__key", hot, F.xxhash64(*order), "left")
    own = F.struct(*order) == F.col("__first")
    return joined.withColumn(code_of, F.when(F.col("__first").isNotNull() & ~own, F.col("__first")[order[0]])).drop("__key", "__first", "__n")


def mark_accepted_duplicates(df: DataFrame, key: str, order: list[str], eligible: Column, code_of: str = "duplicate_of") -> DataFrame:
    """mark_duplicates among eligible rows only; others neither mark nor are marked."""
    some = mark_duplicates(df.where(eligible), key, order, code_of)
    return some.unionByName(df.where(~F.coalesce(eligible, F.lit(False))).withColumn(code_of, F.lit(None).cast("string")))


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    """(key, value, rows) of every value that occurs more than once in a column that should be unique."""
    out = None
    for k in keys:
        one = df.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").select(F.lit(k).alias("key"), "value", "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of the rows of one key, the last by ordinal: an aggregate with partial results, not a sort."""
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*df.columns), ordinal).alias("__x")).select("__x.*")
