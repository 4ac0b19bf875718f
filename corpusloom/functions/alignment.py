"""Words with places and times: tokens, a global alignment, chunks of speech and word timings."""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.spelling import comparable

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SENTENCE, _CLAUSE = re.compile(r"[.!?…]"), re.compile(r"[,;:—–-]")


def word_tokens(text: str) -> list[tuple[str, int, int]]:
    """(form, start, end): words in comparison form with their places; a word that has several forms gives several."""
    return [(form, m.start(), m.end()) for m in _WORD.finditer(text) for form in comparable(m[0]).split()]


def align(a: list[str], b: list[str]) -> list[int | None]:
    """For each word of a, the place in b of the word it is matched or substituted with, by least edits.

    Where several alignments cost the same, going back from the end a pair is preferred, then a deletion, then an
    insertion. The table is filled a row at a time: insertions along a row are a running minimum.
    """
    n, m = len(a), len(b)
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    right = np.array([codes[w] for w in b], np.int64)
    steps = np.arange(m + 1)
    cost = np.empty((n + 1, m + 1), np.int32)
    cost[0] = steps
    for i, w in enumerate(a, 1):
        row = np.empty(m + 1, np.int32)
        row[0] = i
        np.minimum(cost[i - 1, :-1] + (right != codes[w]), cost[i - 1, 1:] + 1, out=row[1:])
        cost[i] = np.minimum.accumulate(row - steps) + steps
    out: list[int | None] = [None] * n
    i, j = n, m
    while i and j:
        if cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out[i] = j
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def boundary(text: str, tokens: list[tuple[str, int, int]], k: int) -> int:
    """2 where a sentence ends after token k, 1 where a clause does, else 0."""
    if k + 1 == len(tokens):
        return 2
    between = text[tokens[k][2] : tokens[k + 1][1]]
    return 2 if _SENTENCE.search(between) else 1 if _CLAUSE.search(between) else 0


def speech_chunks(text: str, tokens: list[tuple[str, int, int]], times: list[tuple[float, float] | None], least: float = 3.0, most: float = 20.0) -> list[tuple[int, int]]:
    """(first, last) tokens of chunks of at most `most` seconds, ended at the latest sentence end after `least` seconds,
    or clause end where there is none, or where time runs out. times: of each token; None where it was not heard."""
    out, at = [], 0
    while at < len(tokens):
        heard = [k for k in range(at, len(tokens)) if times[k]]
        if not heard:
            break
        begin = times[heard[0]][0]
        fits = [k for k in heard if times[k][1] - begin <= most] or heard[:1]
        run = [k for k, nxt in pairwise([*fits, len(tokens)])]
        ends = [k for k in run if times[k][1] - begin >= least and boundary(text, tokens, k)]
        last = max(ends, key=lambda k: (boundary(text, tokens, k), k)) if ends else run[-1]
        out.append((at, last))
        at = last + 1
    return out


def aligned_words(df: DataFrame, key: str, script: str, heard: str) -> DataFrame:
    """(key, position, word, heard): every word of the script with the word it is aligned to, row by row."""

    def run(frames):
        for frame in frames:
            rows = []
            for k, a, b in frame.itertuples(index=False):
                words = [w for w, _, _ in word_tokens(a or "")]
                others = [w for w, _, _ in word_tokens(b or "")]
                rows += [(k, i, w, None if j is None else others[j]) for i, (w, j) in enumerate(zip(words, align(words, others)))]
            yield pd.DataFrame(rows, columns=["key", "position", "word", "heard"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, script, heard).mapInPandas(run, f"key {kind}, position int, word string, heard string").withColumnRenamed("key", key)


def word_timings(tokens: Column) -> Column:
    """Timed letters (grapheme, start, end, probability) grouped into words at "|" tokens."""
    empty = F.struct(
        F.lit("").alias("word"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"),
        F.lit(0.0).alias("p"), F.lit(0).alias("n"), F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>").alias("done"),
    )

    def closed(a: Column) -> Column:
        word = F.struct(a["word"].alias("word"), a["start"].alias("start"), a["end"].alias("end"), F.round(a["p"] / a["n"], 6).alias("probability"))
        return F.when(a["n"] > 0, F.concat(a["done"], F.array(word))).otherwise(a["done"])

    def step(a: Column, t: Column) -> Column:
        gap = t["grapheme"] == "|"
        return F.struct(
            F.when(gap, "").otherwise(F.concat(a["word"], t["grapheme"])).alias("word"),
            F.when(~gap, F.coalesce(a["start"], t["start"])).alias("start"), F.when(~gap, t["end"]).alias("end"),
            F.when(gap, 0.0).otherwise(a["p"] + t["probability"]).alias("p"), F.when(gap, 0).otherwise(a["n"] + 1).alias("n"),
            F.when(gap, closed(a)).otherwise(a["done"]).alias("done"),
        )

    return closed(F.aggregate(tokens, empty, step))
