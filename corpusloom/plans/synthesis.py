"""Suites and load tests of a synthesiser, as rows: a request in, a measured answer out."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import signal_metrics
from corpusloom.models.protocols import Factory, Synthesiser
from corpusloom.models.stages import once
from corpusloom.plans.joins import bounded

#: Limits of a stable signal: clipping, level in dB, share of active frames.
STABLE = (0.001, -50.0, 0.1)
ANSWER = "id string, text string, expect_success boolean, target_seconds double, seed int, level int, normalized_text string, frames int, audio array<float>, started double, queued double, latency double, error string"


def synthesised(requests: DataFrame, factory: Factory[Synthesiser], rate: int) -> DataFrame:
    """One answer a request (id, text, expect_success, target_seconds, seed, level): the wave, when it started, how long it
    queued behind the requests of its task and how long it took; or the error's name. A worker makes one at a time."""
    model = once(factory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrived = time.monotonic()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                began = time.monotonic()
                try:
                    wave, text, n = model()(r.text, int(r.seed))
                    answer = (text, n, np.asarray(wave, np.float32).tolist(), None)
                except Exception as error:
                    answer = (None, None, None, type(error).__name__)
                rows.append((*r, *answer[:3], began, began - arrived, time.monotonic() - began, answer[3]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")]).astype({"frames": "Int32"})

    named = requests.select("id", "text", "expect_success", F.col("target_seconds").cast("double"), F.col("seed").cast("int"), F.col("level").cast("int"))
    return named.mapInPandas(run, ANSWER).withColumn("audio_seconds", F.size("audio") / float(rate))


def measured(answers: DataFrame, tolerance: float, frame: int = 320) -> DataFrame:
    """answers with status (passed, failed, or rejected as expected), whether it is the expected one, the real-time factor,
    how far the length is from the target and whether the signal is stable; without the wave."""
    ok = F.col("error").isNull()
    status = F.when(ok & F.col("expect_success"), "passed").when(~ok & ~F.col("expect_success"), "rejected").otherwise("failed")
    off = F.when(ok & (F.col("target_seconds") > 0), F.abs(F.col("audio_seconds") - F.col("target_seconds")) / F.col("target_seconds"))
    rows = answers.withColumn("m", F.when(ok, signal_metrics(F.col("audio"), frame)))
    return rows.withColumns(
        {
            "status": status, "expectation_met": status != "failed", "real_time_factor": F.when(ok, F.col("latency") / F.greatest("audio_seconds", F.lit(1e-9))),
            "duration_error": off, "duration_within_tolerance": F.coalesce(off <= tolerance, F.lit(True)),
            "signal_stable": (F.col("m.clipping") <= STABLE[0]) & (F.col("m.rms_db") >= STABLE[1]) & (F.col("m.active") >= STABLE[2]),
        }
    ).drop("audio", "m")


def level_summary(rows: DataFrame, by: str = "level", latency: str = "latency", queued: str = "queued", started: str = "started", met: Column | None = None) -> DataFrame:
    """Of each level of concurrency: requests, how many a second from the first start to the last end, failures, and the
    median and 95th percentile of service and queue times."""
    span = F.max(F.col(started) + F.col(latency)) - F.min(started)
    fine = F.col("expectation_met") if met is None else met
    two = lambda c, name: [F.round(F.percentile(c, p), 6).alias(f"{name}_p{int(p * 100)}") for p in (0.5, 0.95)]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.round(F.count(F.lit(1)) / F.greatest(span, F.lit(1e-9)), 6).alias("per_second"), F.count_if(~fine).alias("failures"), *two(latency, "service"), *two(queued, "queue"))


def suite(prompts: DataFrame, seeds: int, limit: int | None = None, order: str = "id") -> DataFrame:
    """Requests for every prompt, or the first few in order, with every seed."""
    some = prompts if limit is None else prompts.orderBy(order).limit(limit)
    if not bounded(some, 1_000_000):
        raise ValueError("a suite is a fixed set of prompts")
    seed = prompts.sparkSession.range(seeds).select(F.col("id").cast("int").alias("seed"))
    return some.select("id", "text", F.lit(True).alias("expect_success"), F.lit(None).cast("double").alias("target_seconds")).crossJoin(F.broadcast(seed)).withColumn("level", F.lit(1))
