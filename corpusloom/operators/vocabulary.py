"""Vocabularies of characters and speakers, and encoding with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.sampling import places

UNKNOWN_CHARACTER = 1


def character_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(ch, id): the distinct characters of all texts in code point order, numbered from 2; 0 and 1 are reserved."""
    chars = df.select(F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").distinct()
    return chars.select("ch", (F.row_number().over(Window.orderBy("ch")) + 1).cast("long").alias("id"))


def speaker_vocabulary(df: DataFrame, speaker: str) -> DataFrame:
    """(speaker, id): the distinct non-empty speakers in order, numbered from 1; 0 is reserved."""
    names = df.select(F.col(speaker).alias("speaker")).where("speaker <> ''").distinct()
    return places(names, "speaker").select("speaker", (F.col("place") + 1).alias("id"))


def encoded(df: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """df with ids: the id of each character, 1 where the vocabulary has none. The vocabulary is one broadcast row: it
    has at most as many entries as there are code points."""
    table = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("ch", "id"))).alias("__ids"))
    ids = F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(F.col("__ids"), c), F.lit(UNKNOWN_CHARACTER)))
    return df.crossJoin(F.broadcast(table)).withColumn("ids", ids).drop("__ids")


def encoded_speakers(df: DataFrame, speaker: str, vocabulary: DataFrame) -> DataFrame:
    """df with speaker_number: the speaker's id, 0 for null and unknown ones."""
    known = vocabulary.select(F.col("speaker").alias("__s"), F.col("id").alias("__i"))
    return df.join(known, F.col(speaker) == F.col("__s"), "left").withColumn("speaker_number", F.coalesce("__i", F.lit(0))).drop("__s", "__i")
