"""Readers and writers of manifests, tab-separated files, blobs and reports."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.gates import require
from corpusloom.sources.schema import CLIP, REQUIRED

SUFFIXES = ("flac", "m4a", "mp3", "ogg", "wav")


def read_manifest(spark: SparkSession, path: str, schema: str = CLIP, strict: bool = True) -> DataFrame:
    """Records of a JSON-lines file. strict: a malformed line, an unknown key or an empty required value fails the
    read; otherwise such lines are kept apart in the column _bad."""
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    known = [f.name for f in kinds.fields]
    parsed = lines.withColumn("r", F.from_json("value", kinds, {"mode": "PERMISSIVE"})).withColumn("k", F.json_object_keys("value"))
    names = set(REQUIRED) & set(known)
    fine = F.col("k").isNotNull() & (F.size(F.array_except("k", F.array(*map(F.lit, known)))) == 0)
    for n in sorted(names):
        fine = fine & (F.coalesce(F.trim(F.col(f"r.{n}")), F.lit("")) != "")
    if strict:
        return require(parsed, fine, f"bad record in {path}").select("r.*")
    return parsed.select("r.*", F.when(~F.coalesce(fine, F.lit(False)), F.col("value")).alias("_bad"))


def read_table_file(spark: SparkSession, path: str, required: tuple[str, ...], separator: str = "\t") -> DataFrame:
    """A file with a header, all columns as strings, blank values as null; required columns must be there."""
    df = spark.read.option("sep", separator).option("header", True).option("quote", '"').csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in df.columns])


def optional_int(text: Column) -> Column:
    """Null for blank text, else a whole number; fails on anything else."""
    return F.nullif(F.trim(text), F.lit("")).cast("int")


def positive_int(number: Column) -> Column:
    """Null for what is not above 0."""
    return F.when(number.cast("int") > 0, number.cast("int"))


def audio_suffix(path: Column) -> Column:
    """The suffix if it is one of an allowed few, else .wav."""
    found = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.concat(F.lit("."), F.when(found.isin(*SUFFIXES), found).otherwise("wav"))


def first_filled(*columns: Column) -> Column:
    """The first value that is not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def wave_header(content: bytes) -> tuple[int, int, float] | None:
    """(channels, rate, seconds) of PCM wave bytes; None for other bytes."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form, size = 12, None, None
    while at + 8 <= len(content):
        name, length = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        if name == b"data":
            size = min(length, len(content) - at - 8)
        at += 8 + length + length % 2
    if form is None or size is None or not form[3]:
        return None
    return form[1], form[2], size / form[3]


def probe_waves(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, channels, sample_rate_hz, duration_seconds, error) of the files below a folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, h, *(wave_header(bytes(c)) or (None, None, None))) for p, h, c in frame.itertuples(index=False)]
            out = pd.DataFrame(rows, columns=["path", "sha256", "channels", "sample_rate_hz", "duration_seconds"])
            yield out.assign(error=out["channels"].map(lambda x: None if pd.notna(x) else "audio_decode_failed")).astype({"channels": "Int32", "sample_rate_hz": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(run, "path string, sha256 string, channels int, sample_rate_hz int, duration_seconds double, error string")


def write_lines(df: DataFrame, path: str, order: list[str]) -> int:
    """Rows as JSON lines with sorted keys, range-partitioned by order, so the parts in name order are in order; the
    number of rows."""
    seen = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"), *[F.col(c).alias(f"__{c}") for c in order])
    keys = [f"__{c}" for c in order]
    rows = seen.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.select("value").write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path).count()


def write_splits(df: DataFrame, path: str, split: str) -> None:
    """One folder a split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def report_json(df: DataFrame) -> str:
    """A one-row frame as indented JSON with sorted keys."""
    return json.dumps(df.first().asDict(recursive=True), ensure_ascii=False, indent=2, sort_keys=True)


def provenance(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """(path, bytes, sha256) of the files below a folder, and one digest of that list; fails where there is none."""
    base = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    listed = [r.asDict() for r in rows.orderBy("path").collect()]  # files of one model or report, not of a corpus
    if not listed:
        raise ValueError(f"{folder} has no files")
    return rows, hashlib.sha256(json.dumps(listed, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
