"""Data sets for training, from records to manifests: each is one plan of operators, and fails where its contract does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import by_position, standardised
from corpusloom.functions.text import comparison_form
from corpusloom.operators import evidence, joins, sampling, splits
from corpusloom.plans.joins import sent
from corpusloom.session import cut


@dataclass(frozen=True)
class Prepared:
    """manifest: the chosen rows with split. report: (split, source, n_rows, hours, parents). faults: must be empty."""

    manifest: DataFrame
    report: DataFrame
    faults: DataFrame


def contaminated(prompts: DataFrame, training: DataFrame, key: Callable[[Column], Column] = comparison_form, id_col: str = "id", text_col: str = "text", columns: tuple[str, ...] = ("normalized_transcript", "transcript")) -> DataFrame:
    """Prompts whose text, in a normal form, is that of a training record; of a record the first filled column counts."""
    filled = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns if c in training.columns])
    seen = training.select(key(filled).alias("__key")).where("__key <> ''")
    asked = prompts.withColumn("__key", key(F.col(text_col)))
    return joins.contaminated(asked, seen, "__key").drop("__key")


def _checked(rows: DataFrame, prompts: DataFrame | None) -> Prepared:
    rows = cut(rows)
    keys = {"parent": F.coalesce("parent_clip_id", "clip_id")}
    faults = evidence.split_faults(rows, keys, "split")
    lacking = rows.select(F.explode(evidence.contract_reasons(F.col("text"), F.col("rights_state"), F.col("license_id"), F.col("duration"), F.col("audio_filepath"))).alias("fault"), F.col("clip_id").alias("value"))
    faults = faults.unionByName(lacking)
    if prompts is not None:
        hit = contaminated(prompts, rows.select(F.col("text").alias("transcript")))
        faults = faults.unionByName(hit.select(F.lit("contaminated").alias("fault"), F.col("id").alias("value")))
    report = rows.groupBy("split", "source_dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("duration") / 3600, 3).alias("hours"), F.countDistinct("parent_clip_id").alias("parents"))
    return Prepared(rows, report, faults)


def manifest_rows(records: DataFrame, split: Column, speaker: Column, normal: Callable[[Column], Column]) -> DataFrame:
    """Records as rows of a trainer's manifest."""
    return records.select(
        F.col("audio_path").alias("audio_filepath"), F.col("duration_seconds").alias("duration"), F.col("transcript").alias("text"), normal(F.col("transcript")).alias("normalized_text"),
        speaker.alias("speaker"), "clip_id", F.coalesce("metadata.parent_clip_id", "clip_id").alias("parent_clip_id"), "source_dataset", "rights_state", "license_id", split.alias("split"),
    )


def target_voice(records: DataFrame, chosen: Column, name: str, normal: Callable[[Column], Column] = comparison_form, prompts: DataFrame | None = None) -> Prepared:
    """The records of one voice, in the split they have. chosen: strictly true for its records."""
    some = records.where(F.coalesce(chosen, F.lit(False)))
    return _checked(manifest_rows(some, F.col("source_split"), F.lit(name), normal), prompts)


def foundation(records: DataFrame, left_out: str, normal: Callable[[Column], Column] = comparison_form, prompts: DataFrame | None = None) -> Prepared:
    """The records of all sources but one; a record without a speaker gets one of its source."""
    some = records.where(~F.coalesce(F.col("source_dataset") == left_out, F.lit(False)))
    speaker = F.coalesce("speaker_id", F.concat("source_dataset", F.lit("-unknown")))
    return _checked(manifest_rows(some, F.col("source_split"), speaker, normal), prompts)


def adaptation(records: DataFrame, source: str, fixed: DataFrame, normal: Callable[[Column], Column] = comparison_form, prompts: DataFrame | None = None) -> Prepared:
    """The records of one source, by parent in fixed splits (parent, split), and by hash where these lack it."""
    rows = manifest_rows(records.where(F.col("source_dataset") == source), F.lit(None).cast("string"), F.coalesce("speaker_id", F.lit(f"{source}-unknown")), normal)
    return _checked(splits.fixed_or_hashed(rows.drop("split"), fixed, "parent_clip_id"), prompts)


def conditioned(rows: DataFrame, features: DataFrame, speaker: str, row_id: str, vector: str, share: float, seed: str, limit: float = 5.0) -> DataFrame:
    """rows with held, a share of each speaker's rows, and vector in standard scores of the rows that are not held; rows
    without a vector are dropped, those that are not finite fail."""
    joined = evidence.finite_vectors(rows.join(features.select(row_id, vector), row_id), vector)
    held = cut(splits.stratified_holdout(joined, speaker, row_id, share, seed))
    fit = by_position(held.where("not held"), vector, sample=False).select("mean", F.transform("deviation", lambda d: F.when(d > 0, d).otherwise(1.0)).alias("deviation"))
    return held.crossJoin(F.broadcast(fit)).withColumn(vector, standardised(F.col(vector), F.col("mean"), F.col("deviation"), limit)).drop("mean", "deviation")


def cross_parent_references(rows: DataFrame, speaker: str, parent: str, row_id: str, size: str, length: str, k: int, seed: str, replay: float, least: float = 2.0, most: float = 12.0, total: float = 20.0, longest: int = 512) -> DataFrame:
    """(clip, reference, replay): for every row k references of its speaker and another parent, drawn by the row's own
    seed, and a share of rows without a reference, in hash order. A row's candidates are counted and ranked by a hash of
    the pair; the k least stay, by partial results before the shuffle."""
    pairs = joins.cross_parent_pairs(rows, speaker, parent, row_id, size, length, least, most, total, longest)
    drawn = sampling.least_k(pairs, "target", F.xxhash64(F.lit(seed), "target", "reference"), "reference", k)
    lone = rows.select(F.col(row_id).alias("target")).join(drawn.select("target").distinct(), "target", "left_anti")
    n = int(round(drawn.count() * replay))
    some = sampling.hash_sample(lone, "target", n, seed) if n else lone.limit(0)
    return drawn.select(F.col("target").alias("clip"), "reference", F.lit(False).alias("replay")).unionByName(some.select(F.col("target").alias("clip"), F.lit(None).cast("string").alias("reference"), F.lit(True).alias("replay")))


def best_candidates(samples: DataFrame, key: str, run: str, score: Column, penalties: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(chosen, summary): of each key the run with the best score less its penalties, the earliest in a tie; every run must
    have every key. summary: mean and percentiles of the chosen scores."""
    uneven = joins.aligned_runs(samples.withColumn("__place", F.lit(0)), run, key, "__place")
    if not uneven.isEmpty():
        raise ValueError("not every run has every key")
    whole = samples.withColumn("score", score - sum(penalties, F.lit(0.0)))
    best = whole.groupBy(key).agg(F.max_by(F.struct(*whole.columns), F.struct("score", -F.col(run))).alias("x")).select("x.*")
    return best, best.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.percentile("score", 0.1).alias("p10"), F.percentile("score", 0.9).alias("p90"))


def gallery(prompts: DataFrame, raw: DataFrame, selected: DataFrame, candidates: DataFrame, k: int, worst: int) -> DataFrame:
    """Prompts with their raw and selected samples and the spread of error rates over all candidates, and list: the k
    best of each category, and the worst ones that are not among them."""
    spread = candidates.groupBy("id").agg(F.min("cer").alias("least_cer"), F.max("cer").alias("most_cer"))
    name = lambda df, p: sent(df.select("id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "id"]))
    rows = cut(prompts.join(name(raw, "raw"), "id").join(name(selected, "selected"), "id").join(spread, "id"))
    ranked = sampling.first_k(rows, ["category"], ["selected_cer", "id"], k).withColumn("list", F.lit("best"))
    rest = rows.join(ranked.select("id"), "id", "left_anti").orderBy(F.col("selected_cer").desc(), "id").limit(worst).withColumn("list", F.lit("worst"))
    return ranked.unionByName(rest)
