"""Choosing rows: the best of several runs, top-k by group, worst-k chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(df: DataFrame, key: str, score: Column, run: str) -> DataFrame:
    """The row with the highest score of each key; the earliest run in a tie. An aggregate, not a sort."""
    return df.withColumn("score", score).groupBy(key).agg(F.max_by(F.struct(*df.columns, "score"), F.struct(F.col("score"), -F.col(run))).alias("x")).select("x.*")


def top_k(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def worst_chain(df: DataFrame, row_id: str, lists: list[tuple[str, list[Column]]], k: int) -> DataFrame:
    """(list, rank, id): k rows for each list in turn, none of which is in an earlier one.

    Each list is a top-k over at most k rows for every list before it, which are marked, so no anti join is needed.
    """
    out, used = None, None
    for name, order in lists:
        rest = df if used is None else df.join(F.broadcast(used), row_id, "left_anti")
        some = rest.orderBy(*order).limit(k)
        ranked = some.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.lit(name).alias("list"), "rank", row_id)
        out = ranked if out is None else out.unionByName(ranked)
        used = out.select(row_id)
    return out
