"""Connected components over pairs of node names, with nothing but grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.joins import hot_keys, salted_join
from corpusloom.session import cut


#: A node with fewer neighbours than this is never worth salting.
MANY = 20_000


def _joined(edges: DataFrame, least: DataFrame, salt: bool) -> DataFrame:
    """edges (a, b) with m, the least neighbour of a."""
    if not salt:
        return edges.join(least.select("a", "m"), "a")
    return salted_join(edges, least.select("a", "m"), "a", hot_keys(least, "a", "n", least=MANY), F.xxhash64("b"))


def _star(edges: DataFrame, salt: bool) -> DataFrame:
    """One large star and one small star over edges (a, b) with a > b: every node moves to the least name it can see.

    A node's neighbours are never gathered: their minimum is an aggregate, and the join that hands it back salts the
    nodes that hold a large part of the edges.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    larger = _joined(both.where("b > a"), least, salt)
    large = larger.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _joined(large, low, salt)
    small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return small.where("a > b").distinct()


def _state(edges: DataFrame) -> tuple[tuple, int]:
    """(number and checksum of the edges, the most edges that end in one node)."""
    per = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    r = per.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return (r[0], r[1]), r[2] or 0


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the component's least node.

    Alternating large and small stars, which need a number of rounds that grows with the logarithm of the number of
    nodes; each round is written to the checkpoint folder. Joins are salted in rounds in which a node has MANY
    neighbours. Loops and nulls are ignored; a node that only has a loop is not in the result.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now)
    mark, most = _state(now)
    out_degree = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    most = max(most, out_degree)
    for _ in range(rounds):
        now = cut(_star(now, most >= MANY // 2))
        before = mark
        mark, most = _state(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
