"""Recordings of a known script: timed words are aligned to it and cut into segments with reasons and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.alignment import align, speech_chunks, word_tokens
from corpusloom.operators.gates import reasons

SEGMENT = "parent string, segment int, text string, start double, end double, words int, heard int, exact int"


def scripted_segments(df: DataFrame, row_id: str, script: str, words: str, least: float = 3.0, most: float = 20.0) -> DataFrame:
    """(parent, segment, text, start, end, words, heard, exact): stretches of a script in the places of its recording.

    words: array of (text, start, end). They are brought to comparison form, of which one may give several words, and
    aligned to the script's words; a script's word has the time of the word it is aligned to. Segments end where
    sentences do, then clauses. A parent without a script or without heard words has no segments. Works row by row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for parent, text, timed in frame.itertuples(index=False):
                tokens = word_tokens(text or "")
                heard = [(form, w["start"], w["end"]) for w in (timed if timed is not None else []) for form, _, _ in word_tokens(w["text"] or "")]
                places = align([t[0] for t in tokens], [h[0] for h in heard])
                times = [None if k is None else heard[k][1:] for k in places]
                for n, (a, b) in enumerate(speech_chunks(text or "", tokens, times, least, most)):
                    own = [(tokens[k][0], heard[places[k]]) for k in range(a, b + 1) if places[k] is not None]
                    end = tokens[b + 1][1] if b + 1 < len(tokens) else len(text)
                    rows.append((parent, n, text[tokens[a][1] : end].strip(), own[0][1][1], own[-1][1][2], b - a + 1, len(own), sum(w == h[0] for w, h in own)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    return df.select(F.col(row_id).cast("string"), script, words).mapInPandas(run, SEGMENT)


def with_script_reasons(segments: DataFrame, least_seconds: float = 1.0, most_seconds: float = 24.0, least_exact: float = 0.6, least_heard: float = 0.8) -> DataFrame:
    """segments with the reasons against them."""
    seconds = F.col("end") - F.col("start")
    codes = reasons(
        (seconds < least_seconds, "segment_too_short"), (seconds > most_seconds, "segment_too_long"),
        (F.col("heard") / F.col("words") < least_heard, "script_words_missing"), (F.col("exact") / F.greatest("heard", F.lit(1)) < least_exact, "script_mismatch"),
    )
    return segments.withColumn("reasons", codes)


def parent_reports(segments: DataFrame) -> DataFrame:
    """Of each parent: words, exact matches and their ratio, accepted segments and their seconds."""
    fine = F.size("reasons") == 0
    return segments.groupBy("parent").agg(
        F.sum("words").alias("words"), F.sum("exact").alias("exact"), F.round(F.sum("exact") / F.greatest(F.sum("words"), F.lit(1)), 6).alias("ratio"),
        F.count_if(fine).alias("accepted"), F.round(F.coalesce(F.sum(F.when(fine, F.col("end") - F.col("start"))), F.lit(0.0)), 6).alias("accepted_seconds"),
    )
