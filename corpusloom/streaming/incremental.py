"""Incremental operators: resumable stages, event-time windows and a guard with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.gates import require


def resume(inputs: DataFrame, checkpoint: str, key: str, step: Callable[[DataFrame], DataFrame], compatible: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Run a step on the inputs that the checkpoint folder lacks, append its rows, and give the rows of all inputs.

    Appending twice does no harm: of several rows of one key, which are equal, one is kept. compatible: a condition that
    every row of the folder must meet, such as the model that made it or its stage; one that does not fails the run.
    """
    spark = inputs.sparkSession
    done = _stored(spark, checkpoint)
    if done is not None and compatible is not None:
        odd = done.where(~F.coalesce(compatible(done), F.lit(False))).limit(3).collect()
        if odd:
            raise ValueError(f"{checkpoint} holds rows of another model or stage, such as {odd[0][key]}")
    todo = inputs if done is None else inputs.join(done.select(key).distinct(), key, "left_anti")
    step(todo).write.mode("append").parquet(checkpoint)
    return spark.read.parquet(checkpoint).dropDuplicates([key]).join(inputs.select(key), key, "left_semi")


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of a folder; None where it is not there or holds no file."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def of_model(model: str, model_col: str, reasons: str = "reasons", stage: str = "quality_stage", exempt: str = "acoustic_audit") -> Callable[[DataFrame], Column]:
    """Rows made by a model, or rejected before any model saw them."""
    return lambda _: (F.col(model_col) == model) | ((F.size(reasons) > 0) & (F.col(stage) == exempt))


#: The stages that a checkpoint of each stage may hold.
STAGES = {
    "whisper_pseudolabel": ("segmentation", "whisper_pseudolabel"),
    "ctc_consensus_alignment": ("segmentation", "whisper_pseudolabel", "ctc_consensus_alignment"),
}


def of_stage(stage: str, column: str = "quality_stage") -> Callable[[DataFrame], Column]:
    """Rows that this stage or one before it has left."""
    return lambda _: F.col(column).isin(*STAGES[stage])


def in_input_order(inputs: DataFrame, done: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The done row of every input, sorted as the inputs are; fails on an input without one."""
    marked = inputs.select(key, F.col(ordinal).alias("__n")).join(done.withColumn("__done", F.lit(True)), key, "left")
    return require(marked, F.col("__done").isNotNull(), "an input has no result").orderBy("__n").drop("__n", "__done")


def cached(inputs: DataFrame, cache: DataFrame, key: str, model: str, digest: str, fields: list[str]) -> DataFrame:
    """inputs with the fields of the cache and hit: a result counts only for the same id, model and content."""
    known = cache.select(key, model, digest, *fields).dropDuplicates([key, model, digest]).withColumn("hit", F.lit(True))
    return inputs.join(known, [key, model, digest], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def feature_cache(inputs: DataFrame, folder: str, fingerprint: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The features of inputs from folder/fingerprint, made once; another fingerprint of configuration and manifests has
    another folder, so stale features are never read."""
    spark, path = inputs.sparkSession, f"{folder}/{fingerprint}"
    if _stored(spark, path) is None:
        step(inputs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """The same as a stream over new files: every key once, each micro-batch written whole."""
    rows = step(spark.readStream.schema(schema).parquet(source).dropDuplicates([key]))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: str, size: str, late: str) -> DataFrame:
    """Rows and sums of value in tumbling event-time windows; rows later than `late` are left out. Batch or stream."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def degradation_streaks(df: DataFrame, group: str, order: str, value: str, factor: float) -> DataFrame:
    """df with best (the least value before) and streak (consecutive values above best * factor, up to here).

    The best so far is a running minimum; streaks are islands between values that are not above.
    """
    w = Window.partitionBy(group).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("best", F.min(value).over(before)).withColumn("__bad", F.coalesce(F.col(value) > F.col("best") * factor, F.lit(False)))
    island = marked.withColumn("__island", F.sum(F.when(~F.col("__bad"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(group, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.when(F.col("__bad"), F.sum(F.col("__bad").cast("int")).over(inner)).otherwise(0)).drop("__bad", "__island")


def guard(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State function of guard_stream: (best, streak) of each group across micro-batches."""
    best, streak = state.get if state.exists else (None, 0)
    rows = []
    for frame in frames:
        for step, value in frame.sort_values("step")[["step", "value"]].itertuples(index=False):
            streak = streak + 1 if best is not None and value > best * 1.1 else 0
            best = value if best is None else min(best, value)
            rows.append((key[0], step, best, streak))
    state.update((best, streak))
    yield pd.DataFrame(rows, columns=["name", "step", "best", "streak"])


def guard_stream(stream: DataFrame) -> DataFrame:
    """degradation streaks of a stream (name, step, value), with state that survives restarts."""
    return stream.groupBy("name").applyInPandasWithState(guard, "name string, step long, best double, streak long", "best double, streak long", "append", GroupStateTimeout.NoTimeout)


def sessions(df: DataFrame, group: str, order: str, is_delimiter: Column) -> DataFrame:
    """df without delimiters, with session: how many delimiters of the group came before."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__d", is_delimiter)
    return marked.withColumn("session", F.sum(F.col("__d").cast("int")).over(w)).where(~F.col("__d")).drop("__d")

