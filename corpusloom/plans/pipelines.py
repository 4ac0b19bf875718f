"""Composite pipelines: whole data sets from gated records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import joins, sampling, splits


def combined_dataset(records: DataFrame, speaker_cap: int, source_cap: int) -> DataFrame:
    """(clip_id, source, split): accepted records, at most speaker_cap milliseconds of each speaker and source and
    source_cap of each source, best first, in their own split where they have one and by hash of the session or clip
    otherwise. records: clip_id, source, speaker, session, split, units, quality, reasons."""
    fine = records.where(F.size("reasons") == 0).dropDuplicates(["clip_id"])
    order = [-F.coalesce("quality", F.lit(0.0)), F.sha2("clip_id", 256)]
    named = fine.where("speaker is not null").withColumn("owner", F.concat_ws("|", "source", "speaker"))
    one = sampling.greedy_cap(named, "owner", "clip_id", F.col("units"), order, speaker_cap)
    kept = named.join(one.select("clip_id"), "clip_id").drop("owner").unionByName(fine.where("speaker is null"))
    two = sampling.greedy_cap(kept, "source", "clip_id", F.col("units"), order, source_cap)
    chosen = kept.join(two.select("clip_id"), "clip_id")
    return chosen.select("clip_id", "source", F.coalesce("split", splits.parent_split(F.coalesce("session", "clip_id"))).alias("split"))


def paired_references(records: DataFrame, wanted: float = 8.0, least: float = 2.0, most: float = 12.0) -> DataFrame:
    """records with sibling, the reference of the same session nearest to the wanted length, and replay, whether the
    record has none and is kept as it is."""
    found = joins.nearest_sibling(records, "session_id", "clip_id", "duration_seconds", wanted, least, most)
    return records.join(found, "clip_id", "left").withColumn("replay", F.col("sibling").isNull())


def parameter_grid(prompts: DataFrame, seeds: int, configs: list[dict]) -> DataFrame:
    """Every prompt with every configuration and seed. prompts is a fixed suite; configurations and seeds are few."""
    spark = prompts.sparkSession
    grid = spark.createDataFrame(configs).crossJoin(spark.range(seeds).withColumnRenamed("id", "seed"))
    return prompts.crossJoin(F.broadcast(grid))
