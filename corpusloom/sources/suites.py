"""Readers of suites, ratings, plans, thresholds, presets, reports, Arrow files and hubs kept on disk, and their writers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.dedup import last_wins
from corpusloom.operators.gates import require
from corpusloom.operators.joins import strict_pairs
from corpusloom.sources.files import optional_int, read_manifest, read_table_file
from corpusloom.sources.schema import PROMPT

# Splits of a hub, answers of a listening test, features of a reading in their order, allow-listed fields.
HUB_SPLITS = ("train", "validation", "test")
ANSWERS = ("E", "H")
PROSODY_FEATURES = ("log_seconds_per_character", "energy_mean", "energy_std", "log_f0_mean", "log_f0_std", "voiced_ratio")
PUBLIC_FIELDS = (
    "clip_id", "source_dataset", "source_version", "source_split", "source_row_id", "transcript", "normalized_transcript", "language",
    "license_id", "duration_seconds", "sample_rate_hz", "sha256",
)
PUBLIC_METADATA = ("common_voice_acoustics", "acoustics", "asr_check", "quality_filter_reasons", "quality_stage", "attribution", "license_url", "dataset_terms_url")


def read_prompts(spark: SparkSession, path: str, categories: tuple[str, ...] = ()) -> DataFrame:
    """A suite of prompts (id, category, text) in JSON lines; fails on repeated ids and on categories without a prompt."""
    df = read_manifest(spark, path, PROMPT)
    again = df.groupBy("id").count().where("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"repeated ids: {', '.join(str(r.id) for r in again)}")
    missing = set(categories) - {r[0] for r in df.select("category").distinct().limit(10_000).collect()}
    if missing:
        raise ValueError(f"no prompt of {', '.join(sorted(missing))}")
    return df


def read_ratings(spark: SparkSession, path: str, most: int = 3) -> DataFrame:
    """(trial, cmos, same_person) of a CSV file; the last line of a trial counts; fails on values out of range."""
    rows = read_table_file(spark, path, ("trial", "cmos", "same_person"), ",").withColumn("n", F.monotonically_increasing_id())
    typed = rows.select(optional_int(F.col("trial")).alias("trial"), optional_int(F.col("cmos")).alias("cmos"), F.upper("same_person").alias("same_person"), "n")
    fine = F.col("trial").isNotNull() & F.col("cmos").between(-most, most) & (F.col("same_person").isNull() | F.col("same_person").isin(*ANSWERS))
    return last_wins(require(typed, fine, f"bad rating in {path}"), ["trial"], "n").drop("n")


def read_json(path: str, known: tuple[str, ...] = ()) -> dict:
    """A JSON object; with known keys, fails on other and on missing ones."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if known and set(value) != set(known):
        raise ValueError(f"{path}: {', '.join(sorted(set(value) ^ set(known)))}")
    return value


def write_json(value: dict, path: str) -> None:
    """A JSON object with sorted keys, whole or not at all."""
    part = Path(f"{path}.part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    part.replace(path)


def read_plan(path: str, lengths: tuple[float, ...] = (5, 30, 90)) -> dict:
    """A plan of load tests. Its scenarios have unique ids, cover the lengths, and one of them is to be rejected; the
    scenario of the concurrent part is there and is to succeed."""
    plan = read_json(path)
    scenarios = {s["id"]: s for s in plan["scenarios"]}
    part = scenarios.get(plan["concurrency"]["scenario_id"], {})
    faults = [
        (len(scenarios) != len(plan["scenarios"]), "repeated scenario ids"),
        (not set(lengths) <= {s.get("target_seconds") for s in scenarios.values()}, "a length is missing"),
        (sum(not s["expect_success"] for s in scenarios.values()) != 1, "exactly one scenario must be rejected"),
        (not part.get("expect_success"), "the concurrent scenario must succeed"),
        (any(isinstance(n, bool) or not isinstance(n, int) or n < 1 for n in plan["concurrency"]["levels"]), "levels must be whole and positive"),
    ]
    found = [text for bad, text in faults if bad]
    if found:
        raise ValueError("; ".join(found))
    return plan


def read_presets(path: str, features: tuple[str, ...] = PROSODY_FEATURES) -> dict[str, list[float]]:
    """Style -> vector, and "" -> the global mean, of a file whose features are in the expected order."""
    value = read_json(path)
    vectors = {"": value["global_mean"], **{name: p["prosody"] for name, p in value["presets"].items()}}
    if tuple(value["feature_order"]) != features or any(len(v) != len(features) for v in vectors.values()):
        raise ValueError(f"{path}: features differ")
    return vectors


def read_reports(spark: SparkSession, synthesis: str, quality: str) -> DataFrame:
    """The samples of a synthesis report with those of its quality report, one to one by id."""
    one, two = (spark.read.option("multiLine", True).json(p).select(F.explode("samples").alias("s")).select("s.*") for p in (synthesis, quality))
    r = strict_pairs(one, two, "id").first()
    if r.left_only or r.right_only or r.repeated:
        raise ValueError(f"ids differ: {r.asDict()}")
    return one.join(two.select("id", *[c for c in two.columns if c not in one.columns]), "id")


def read_arrow(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of Arrow files, streams or random-access ones, a task a file, a batch at a time."""
    with pa.memory_map(paths[0]) as source:
        schema = _opened(source).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with pa.memory_map(path) as source:
                    reader = _opened(source)
                    yield from (reader.get_batch(k) for k in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader

    from pyspark.sql.pandas.types import from_arrow_schema

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, from_arrow_schema(schema))


def _opened(source):
    try:
        return pa.ipc.open_file(source)
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source)


def write_arrow(df: DataFrame, folder: str) -> None:
    """One Arrow file a partition, written under another name first, so that a file is whole or not there."""

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        target = Path(folder) / f"part-{TaskContext.get().partitionId():05}.arrow"
        part, rows = target.with_suffix(f".{TaskContext.get().taskAttemptId()}.part"), 0
        with pa.OSFile(str(part), "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
            for batch in batches:
                writer.write_batch(batch.cast(schema))
                rows += batch.num_rows
        part.replace(target)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    df.mapInArrow(run, "rows long").collect()  # one number a partition


def read_hub(spark: SparkSession, folder: str, splits: tuple[str, ...] = HUB_SPLITS) -> DataFrame:
    """The Parquet files of each split of a data set kept on disk, with split; fails on unknown splits."""
    unknown = set(splits) - set(HUB_SPLITS)
    if unknown:
        raise ValueError(f"unknown splits: {', '.join(sorted(unknown))}")
    out = None
    for s in splits:
        one = spark.read.parquet(f"{folder}/{s}").withColumn("split", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def hub_records(df: DataFrame, ordinal: Column, samples: Column, text: Column, rate: int = 16_000) -> DataFrame:
    """df with source_row_id, split:ordinal, duration_seconds where it is positive, and transcript; fails on empty texts."""
    seconds = samples / rate
    rows = df.withColumns({"source_row_id": F.concat_ws(":", "split", ordinal.cast("string")), "duration_seconds": F.when(seconds > 0, seconds), "transcript": F.trim(text)})
    return require(rows, F.coalesce(F.col("transcript"), F.lit("")) != "", "empty transcript")


def write_blobs(df: DataFrame, name: str, content: str, folder: str) -> DataFrame:
    """(name, bytes, written): every payload as a file of a shared folder, unless a file with content is there already;
    written under another name first. An empty payload fails."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for batch in batches:
            out = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not data:
                    raise ValueError(f"{file} has no content")
                target = Path(folder) / file
                there = target.exists() and target.stat().st_size > 0
                if not there:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    part = target.with_name(f"{target.name}.{TaskContext.get().taskAttemptId()}.part")
                    part.write_bytes(data)
                    part.replace(target)
                out.append((file, len(data), not there))
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "bytes", "written"), r)) for r in out], pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("written", pa.bool_())]))

    return df.select(name, F.col(content).cast("binary")).mapInArrow(run, "name string, bytes long, written boolean")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, audio_path, text, duration) of JSON lines in either of two layouts: a trainer's, known by
    audio_filepath, or clip records. A line without an id is named by its file and place in it."""
    kinds = "clip_id string, audio_filepath string, audio_path string, text string, transcript string, normalized_transcript string, duration double, duration_seconds double"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("n")).where("trim(value) <> ''")
    r = lines.select("file", "n", F.from_json("value", kinds).alias("r")).select("file", "n", "r.*")
    own = F.col("audio_filepath").isNotNull()
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = F.when(own, blank("text")).otherwise(F.coalesce(blank("normalized_transcript"), blank("transcript")))
    found = r.select(F.coalesce(blank("clip_id"), F.concat_ws("-", "file", F.col("n").cast("string"))).alias("clip_id"), F.when(own, F.col("audio_filepath")).otherwise(F.col("audio_path")).alias("audio_path"), text.alias("text"), F.when(own, F.col("duration")).otherwise(F.col("duration_seconds")).alias("duration"))
    return require(found, F.col("audio_path").isNotNull(), f"a line of {path} names no audio")


def public_view(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The allow-listed fields of records, the name of the file without its folder, and the allow-listed fields of
    metadata, a struct or a map, that are there; nothing else leaves."""
    kind = df.schema[metadata].dataType if metadata in df.columns else None
    inner = []
    if kind is not None and kind.typeName() == "struct":
        inner = [F.col(f"{metadata}.{f}").alias(f) for f in PUBLIC_METADATA if f in kind.names]
    elif kind is not None:
        inner = [F.map_filter(metadata, lambda k, _: k.isin(*PUBLIC_METADATA)).alias("metadata")]
    return df.select(*[F.col(f) for f in PUBLIC_FIELDS if f in df.columns], F.element_at(F.split("audio_path", r"[/\\]"), -1).alias("source_file"), *inner)


def write_fan_out(df: DataFrame, path: str, reasons: str, split: str) -> dict[str, int]:
    """Rows with reasons under rejected, the others under accepted, one folder a split; the number of rows of each."""
    state = F.when(F.size(F.coalesce(F.col(reasons), F.array().cast("array<string>"))) == 0, "accepted").otherwise("rejected")
    marked = df.withColumns({"state": state, "part": F.coalesce(F.col(split), F.lit("none"))})
    marked.write.mode("overwrite").partitionBy("state", "part").parquet(path)
    return {f"{r.state}/{r.part}": r["count"] for r in df.sparkSession.read.parquet(path).groupBy("state", "part").count().collect()}
