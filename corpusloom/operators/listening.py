"""Scoring of blinded listening tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.reports import mean_and_interval
from corpusloom.plans.joins import sent

MOST_CATCHES, LEAST_SAME = 1, 0.95


def oriented(ratings: DataFrame, key: DataFrame, categories: DataFrame) -> DataFrame:
    """Ratings (listener, trial, cmos, same_person) of sound listeners, turned towards the candidate.

    key: trial, type, A, B. categories: trial, category. The last rating of a trial counts; a rating of an unknown
    trial fails; listeners with more than one non-zero catch rating are left out.
    """
    joined = ratings.join(sent(key), "trial", "left")
    joined = joined.where(F.when(F.col("type").isNull(), F.raise_error(F.lit("unknown trial")).cast("boolean")).otherwise(F.lit(True)))
    bad = joined.groupBy("listener").agg(F.count_if((F.col("type") == "catch") & (F.col("cmos") != 0)).alias("catches")).where(F.col("catches") > MOST_CATCHES)
    kept = joined.where("type <> 'catch'").join(bad.select("listener"), "listener", "left_anti").join(sent(categories), "trial", "left")
    candidate = F.when(F.col("type") == "ab", "gated").otherwise("synth")
    return kept.select("listener", "trial", F.col("type").alias("pool"), F.coalesce("category", F.lit("general")).alias("category"), F.when(F.col("B") == candidate, F.col("cmos")).otherwise(-F.col("cmos")).alias("score"), "same_person")


def listening_report(rows: DataFrame) -> DataFrame:
    """(level, name, mean, half_interval, n): all, each pool, each category, and the share of same-person answers."""
    mean, half = mean_and_interval(F.col("score"))
    cols = (F.round(mean, 6).alias("mean"), F.round(half, 6).alias("half_interval"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(*cols).select(F.lit("all").alias("level"), F.lit("*").alias("name"), "mean", "half_interval", "n")
    pool = rows.groupBy("pool").agg(*cols).select(F.lit("pool").alias("level"), F.col("pool").alias("name"), "mean", "half_interval", "n")
    category = rows.groupBy("category").agg(*cols).select(F.lit("category").alias("level"), F.col("category").alias("name"), "mean", "half_interval", "n")
    same = rows.where("pool = 'anchored'").agg(F.round(F.avg(F.when(F.col("same_person") == "E", 1.0).otherwise(0.0)), 6).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.lit("same_person").alias("level"), F.lit("anchored").alias("name"), "mean", F.lit(None).cast("double").alias("half_interval"), "n")
    return total.unionByName(pool).unionByName(category).unionByName(same)


def verdict(report: DataFrame) -> DataFrame:
    """One row: the criteria, the worst category (the first by name in a tie) and whether to promote."""
    worst = F.min(F.when(F.col("level") == "category", F.struct("mean", "name")))
    return report.agg(
        F.max(F.when(F.col("level") == "all", F.col("mean"))).alias("pooled"), F.max(F.when(F.col("level") == "same_person", F.col("mean"))).alias("same"), worst.alias("w")
    ).select(
        "pooled", F.col("same").alias("same_person"), F.col("w.name").alias("worst_category"), F.col("w.mean").alias("worst_mean"),
        ((F.col("pooled") >= 0) & (F.col("same") >= LEAST_SAME) & (F.col("w.mean") > -1.0)).alias("promote"),
    )
