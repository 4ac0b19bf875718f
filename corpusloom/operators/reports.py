"""Aggregates: summaries, histograms and the three kinds of percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sampling import running


def hours(seconds: Column) -> Column:
    """Known seconds in hours, to three decimals."""
    known = F.when(seconds.isNull() | F.isnan(seconds), 0.0).otherwise(seconds)
    return F.round(F.sum(F.round(known * 1000).cast("long")) / 3_600_000.0, 3)


def linear_percentiles(value: Column, *shares: float) -> Column:
    """Exact percentiles with linear interpolation."""
    return F.percentile(value, list(shares))


def nearest_rank(df: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """(by, n, nearest_rank): the value at rank half-even((n - 1) * share) of the sorted values, without interpolation.

    Equal values are counted first; the counts of the sorted values are then totalled over ranges, so that no task holds
    the values of a group. Nulls are left out.
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c")).withColumn("__g", key)
    run = running(counts, "__g", [value], "__c", "__to")
    sizes = counts.groupBy("__g").agg(F.sum("__c").alias("n"))
    at = run.join(sizes, "__g").withColumn("__rank", F.bround((F.col("n") - 1) * F.lit(share)).cast("long"))
    return at.where((F.col("__rank") < F.col("__to")) & (F.col("__rank") >= F.col("__to") - F.col("__c"))).select(*by, "n", F.col(value).cast("double").alias("nearest_rank"))


def reason_histogram(df: DataFrame, codes: str) -> DataFrame:
    """(reason, n_rows)."""
    return df.select(F.explode(codes).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def corpus_summary(df: DataFrame, source: str, speaker: str, seconds: str) -> DataFrame:
    """Rows, hours and distinct speakers of each source and of all, in one pass."""
    kept = df.select(F.col(source).alias("source"), F.col(speaker).alias("speaker"), F.col(seconds).alias("seconds"))
    return kept.rollup("source").agg(F.grouping("source").alias("level"), F.count(F.lit(1)).alias("n_rows"), hours(F.col("seconds")).alias("hours"), F.countDistinct("speaker").alias("speakers")).select(F.when(F.col("level") == 1, "*").otherwise(F.col("source")).alias("source"), "n_rows", "hours", "speakers")


def mean_and_interval(value: Column) -> tuple[Column, Column]:
    """The mean and half of its 95 % interval; the latter is null below two values."""
    return F.avg(value), F.when(F.count(value) > 1, 1.96 * F.sqrt(F.var_samp(value) / F.count(value)))
