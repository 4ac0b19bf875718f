"""Adapters: a model over the eligible rows of a DataFrame, in batches; a failed model is a reason, never a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import pii_categories
from corpusloom.models.protocols import Factory, PrivacyScanner, Recogniser, SpeakerEmbedder, TimedTranscriber, Transcriber
from corpusloom.operators.gates import accepted, merged

_LOADED: dict[str, Any] = {}


def load(token: str, factory: Factory) -> Any:
    """The worker's model of a token, loaded at its first use; a function of the module, so that all tasks share it."""
    if token not in _LOADED:
        _LOADED[token] = factory()
    return _LOADED[token]


def once(factory: Factory) -> Callable[[], Any]:
    """A function that gives the worker's model."""
    token = uuid4().hex
    return lambda: load(token, factory)


def in_batches(df: DataFrame, eligible: Column, schema: str, size: int, call: Callable[[list[dict]], Sequence[tuple]], columns: Sequence[str], alone: bool = False) -> DataFrame:
    """df with the fields of schema, which call gives for the eligible rows, `size` rows at a time, and with model_error.

    A batch whose call raises, or gives another number of results, has null fields and the error's name in model_error;
    with alone, its rows are tried one by one first. Rows that are not eligible never reach the model; they have nulls.
    columns: those that call needs. The rows keep no order; sort them where one is wanted.
    """
    fields = T._parse_datatype_string(schema).fields
    out = T.StructType([*df.schema.fields, *fields, T.StructField("model_error", T.StringType())])

    def attempt(rows: list[dict]) -> list[tuple]:
        try:
            found = [tuple(x) for x in call(rows)]
            if len(found) != len(rows):
                raise ValueError(f"{len(rows)} rows, {len(found)} results")
            return [(*x, None) for x in found]
        except Exception as error:
            if alone and len(rows) > 1:
                return [x for r in rows for x in attempt([r])]
            return [(*[None] * len(fields), type(error).__name__)] * len(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                results = attempt(part.select(list(columns)).to_pylist())
                extra = [pa.array([r[k] for r in results], wanted.field(batch.num_columns + k).type) for k in range(len(fields) + 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=wanted.names)

    done = df.where(eligible).mapInArrow(run, out)
    rest = df.where(~F.coalesce(eligible, F.lit(False)))
    return done.unionByName(rest, allowMissingColumns=True)


def with_failures(df: DataFrame, reasons: str, code: str) -> DataFrame:
    """df whose reasons have the code where the model failed."""
    return df.withColumn(reasons, F.when(F.col("model_error").isNotNull(), merged(F.col(reasons), F.array(F.lit(code)))).otherwise(F.col(reasons)))


def transcribed(df: DataFrame, factory: Factory[Transcriber], columns: Sequence[str], reasons: str = "reasons", size: int = 32) -> DataFrame:
    """df with text, language, language_probability, speech_seconds; asr_failed for rows whose batch and own call failed."""
    model = once(factory)
    schema = "text string, language string, language_probability double, speech_seconds double"
    out = in_batches(df, accepted(F.col(reasons)), schema, size, lambda rows: model()(rows), columns, alone=True)
    return with_failures(out, reasons, "asr_failed")


def recognised(df: DataFrame, factory: Factory[Recogniser], columns: Sequence[str], target: str, reasons: str = "reasons", size: int = 24) -> DataFrame:
    """df with ctc struct fields (text, confidence, mean_probability, leading, trailing) of a character recogniser."""
    model = once(factory)
    schema = "ctc_text string, ctc_confidence double, mean_probability double, leading double, trailing double"
    call = lambda rows: model()(rows, [r[target] or "" for r in rows])
    return with_failures(in_batches(df, accepted(F.col(reasons)), schema, size, call, [*columns, target]), reasons, "ctc_failed")


def embedded(df: DataFrame, factory: Factory[SpeakerEmbedder], columns: Sequence[str], size: int = 32) -> DataFrame:
    """df with embedding, of unit length."""
    model = once(factory)

    def call(rows: list[dict]) -> list[tuple]:
        vectors = np.asarray(model()(rows), float)
        return [(v.tolist(),) for v in vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)]

    return in_batches(df, F.lit(True), "embedding array<double>", size, call, columns)


def timed_words(df: DataFrame, factory: Factory[TimedTranscriber], path: str) -> DataFrame:
    """df with words, the timed words of the recording at path; null and model_error where it could not be heard."""
    model = once(factory)
    call = lambda rows: [([dict(zip(("text", "start", "end", "probability"), w)) for w in model()(r[path])],) for r in rows]
    return in_batches(df, F.col(path).isNotNull(), "words array<struct<text:string,start:double,end:double,probability:double>>", 1, call, [path])


#: Words beside which a place is an address.
ADDRESS_CATEGORY = "location"


def scanned(df: DataFrame, text: str, factory: Factory[PrivacyScanner] | None = None) -> DataFrame:
    """df with categories: those of structured patterns, and of a scanner for texts in which the patterns find nothing;
    a place counts only in a text that also has a word of an address."""
    from corpusloom.functions.text import PLACE_WORDS, turkish_lower

    first = df.withColumn("categories", F.coalesce(pii_categories(F.col(text)), F.array().cast("array<string>")))
    if factory is None:
        return first
    model = once(factory)
    open_ = (F.size("categories") == 0) & (F.coalesce(F.trim(text), F.lit("")) != "")
    call = lambda rows: [(sorted({f.category for f in model()(r[text])}),) for r in rows]
    both = in_batches(first, open_, "found array<string>", 64, call, [text])
    address = turkish_lower(F.col(text)).rlike(rf"(?U)\b(?:{'|'.join(PLACE_WORDS)})\b")
    found = F.filter(F.coalesce("found", F.array().cast("array<string>")), lambda c: (c != ADDRESS_CATEGORY) | address)
    return both.withColumn("categories", F.array_sort(F.array_union("categories", found))).drop("found")
