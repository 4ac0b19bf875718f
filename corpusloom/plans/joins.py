"""Joins that stay safe at any size: hot keys are salted, and only sides of a proven size are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int) -> bool:
    """Whether the values of df take at most limit bytes, strings by their length and 16 bytes a value besides; one
    aggregate over all of df, which should be written already."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        long = F.octet_length(name) if kind in ("string", "binary") else 8 * F.size(name) if kind.startswith("array") else F.lit(0)
        size = size + 16 + F.coalesce(long, F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def sent(df: DataFrame, limit: int = 16_000_000) -> DataFrame:
    """df, marked for broadcast where it is small; otherwise as it is, so that joins with it shuffle."""
    return F.broadcast(df) if small(df, limit) else df


def hot_keys(counts: DataFrame, key: str, rows: str, share: float = 0.001, least: int = 20_000) -> DataFrame:
    """The keys that hold at least a share of all rows, and at least `least`: never more than 1/share of them."""
    total = counts.agg(F.sum(rows).alias("__total"))
    return (
        counts.join(F.broadcast(total))
        .where((F.col(rows) >= F.col("__total") * share) & (F.col(rows) >= least))
        .select(key)
    )


def salted_join(
    left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner", salts: int = 64
) -> DataFrame:
    """left join right on one key, where right has few rows a key and left may hold a third of its rows under one.

    hot: the hot keys, from hot_keys, hence broadcast. Their rows in left are spread over `salts` tasks by the
    expression `spread`; their rows in right are repeated as often. Other keys are joined as usual.
    """
    flag = F.broadcast(hot.select(F.col(key).alias("__hot")))
    hit = F.col("__hot").isNotNull()
    a = left.join(flag, F.col(key) == F.col("__hot"), "left").withColumn(
        "__salt", F.when(hit, F.pmod(spread, F.lit(salts)).cast("int")).otherwise(0)
    )
    b = right.join(flag, F.col(key) == F.col("__hot"), "left").withColumn(
        "__salt", F.explode(F.when(hit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return a.drop("__hot").join(b.drop("__hot"), [key, "__salt"], how).drop("__salt")
