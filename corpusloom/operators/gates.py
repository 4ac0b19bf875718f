"""Gates: reason codes on rows, never lost rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(*checks: tuple[Column, str]) -> Column:
    """The codes of the checks that hold, in order. A null condition does not hold."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in checks]))


def merged(*lists: Column) -> Column:
    """The sorted union of reason lists; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists])))


def accepted(codes: Column) -> Column:
    """No reasons; a null list counts as none."""
    return F.size(F.coalesce(codes, F.array().cast("array<string>"))) == 0


def strictly_accepted(codes: Column) -> Column:
    """An empty list; a null list is not accepted."""
    return F.coalesce(F.size(codes) == 0, F.lit(False))


def clip_reasons(duration: Column, snr: Column, least: float = 1.0, most: float = 20.0, least_snr: float = 6.0) -> Column:
    """Codes of clips of which only the length and the noise distance are known: too short or long, too noisy. Boundary
    values pass; unknown values do not fail, except that an unknown or NaN duration counts as 0. The gate on all seven
    measures of a signal is evidence.signal_gate."""
    known = F.when(duration.isNull() | F.isnan(duration), 0.0).otherwise(duration)
    return reasons((known < least, "duration_too_short"), (known > most, "duration_too_long"), (snr < least_snr, "low_estimated_snr"))


def asr_reasons(reference: Column, text: Column, language: Column, confidence: Column, speech: Column, duration: Column) -> Column:
    """Codes of a transcript that a recogniser does not confirm: the limit on the character error rate is looser for
    short references, and a wrong language counts only where the recogniser is sure."""
    from corpusloom.functions.text import character_error_rate

    short = F.when(F.length(reference) < 20, 0.60).otherwise(0.40)
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    return reasons(
        (empty, "asr_empty"),
        ((language != "tr") & (confidence >= 0.80), "wrong_language"),
        (~empty & (character_error_rate(reference, text) > short), "transcript_mismatch"),
        (speech / F.coalesce(F.nullif(duration, F.lit(0.0)), F.lit(1.0)) < 0.25, "insufficient_asr_speech"),
    )


def with_eligible(df: DataFrame, eligible: Column, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a costly step to the eligible rows only; the others pass unchanged, with nulls in new columns."""
    return step(df.where(eligible)).unionByName(df.where(~F.coalesce(eligible, F.lit(False))), allowMissingColumns=True)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, which fails on reading a row that does not meet the condition."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
