"""Gates and reports over clips, transcripts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import gates, reports
from corpusloom.queries.registry import query
from corpusloom.sources.tables import table

KNOWN = "(CASE WHEN duration_seconds IS NULL OR isnan(duration_seconds) THEN 0.0 ELSE duration_seconds END)"
GATED = f"""gated AS (SELECT clip_id, source_dataset, collection_format, speaker_id, rights_state, duration_seconds, metadata,
  list_filter([CASE WHEN {KNOWN} < 1.0 THEN 'duration_too_short' END, CASE WHEN {KNOWN} > 20.0 THEN 'duration_too_long' END,
   CASE WHEN metadata.estimated_snr_db < 6.0 THEN 'low_estimated_snr' END], lambda x: x IS NOT NULL) AS reasons FROM clip_records)"""
HOURS = f"round(sum(CAST(round({KNOWN} * 1000) AS BIGINT)) / 3600000.0, 3)"


def gated(spark: SparkSession, folder: str) -> DataFrame:
    """Clips with their reasons."""
    clips = table(spark, folder, "clip_records", "clip_id", "source_dataset", "collection_format", "speaker_id", "rights_state", "duration_seconds", "metadata")
    return clips.withColumn("reasons", gates.clip_reasons(F.col("duration_seconds"), F.col("metadata.estimated_snr_db")))


@query(f"WITH {GATED} SELECT clip_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM gated")
def accepted_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The reasons of every clip."""
    return gated(spark, folder).select("clip_id", F.array_join("reasons", ",").alias("reasons"), gates.accepted(F.col("reasons")).alias("accepted"))


@query(f"WITH {GATED} SELECT unnest(reasons) AS reason, count(*) AS n_rows FROM gated GROUP BY 1")
def reason_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How often each reason occurs."""
    return reports.reason_histogram(gated(spark, folder), "reasons")


@query(f"""WITH {GATED} SELECT len(reasons) = 0 AS accepted, count(*) AS n_rows, {HOURS} AS hours,
 count(DISTINCT speaker_id) AS speakers FROM gated GROUP BY 1""")
def gate_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected rows and hours."""
    return gated(spark, folder).groupBy(gates.accepted(F.col("reasons")).alias("accepted")).agg(F.count(F.lit(1)).alias("n_rows"), reports.hours(F.col("duration_seconds")).alias("hours"), F.countDistinct("speaker_id").alias("speakers"))


@query(f"""WITH {GATED} SELECT collection_format, count(*) AS n_rows, {HOURS} AS hours,
 round(sum(CASE WHEN rights_state = 'allowed' THEN CAST(round({KNOWN} * 1000) AS BIGINT) ELSE 0 END) / 3600000.0, 3) AS allowed_hours,
 count_if(len(reasons) = 0) AS accepted_rows FROM gated WHERE collection_format IN ('monologue', 'conversation') GROUP BY 1""")
def gate_summary_by_format(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and hours of two formats, with conditional sums."""
    rows = gated(spark, folder).where(F.col("collection_format").isin("monologue", "conversation"))
    known = F.when(F.col("duration_seconds").isNull() | F.isnan("duration_seconds"), 0.0).otherwise(F.col("duration_seconds"))
    allowed = F.sum(F.when(F.col("rights_state") == "allowed", F.round(known * 1000).cast("long")).otherwise(0))
    return rows.groupBy("collection_format").agg(
        F.count(F.lit(1)).alias("n_rows"), reports.hours(F.col("duration_seconds")).alias("hours"), F.round(allowed / 3_600_000.0, 3).alias("allowed_hours"),
        F.count_if(gates.accepted(F.col("reasons"))).alias("accepted_rows"),
    )


@query(f"""SELECT CASE WHEN grouping(source_dataset) = 1 THEN '*' ELSE source_dataset END AS source, count(*) AS n_rows, {HOURS} AS hours,
 count(DISTINCT speaker_id) AS speakers FROM clip_records GROUP BY ROLLUP(source_dataset)""")
def corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, hours and speakers by source and in all."""
    return reports.corpus_summary(table(spark, folder, "clip_records"), "source_dataset", "speaker_id", "duration_seconds")


@query("""SELECT rights_state, source_dataset, source_version, count(*) AS n_rows, count(DISTINCT speaker_id) AS speakers
 FROM clip_records GROUP BY GROUPING SETS ((rights_state), (source_dataset, source_version), ())""")
def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by rights, by source and version, and in all, in one pass."""
    clips = table(spark, folder, "clip_records", "rights_state", "source_dataset", "source_version", "speaker_id")
    sets = [[F.col("rights_state")], [F.col("source_dataset"), F.col("source_version")], []]
    return clips.groupingSets(sets, "rights_state", "source_dataset", "source_version").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("speaker_id").alias("speakers"))


@query(f"""WITH {GATED} SELECT count(*) AS accepted_rows, count_if(metadata.quality_score IS NULL OR metadata.estimated_snr_db IS NULL
 OR speaker_id IS NULL) AS lacking FROM gated WHERE len(reasons) = 0""")
def evidence_lacking(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted clips that lack evidence."""
    rows = gated(spark, folder).where(gates.strictly_accepted(F.col("reasons")))
    whole = F.col("metadata.quality_score").isNotNull() & F.col("metadata.estimated_snr_db").isNotNull() & F.col("speaker_id").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("accepted_rows"), F.count_if(~whole).alias("lacking"))


@query("""SELECT language, count(language_probability) AS n, round(quantile_cont(language_probability, 0.01), 4) AS p01, round(quantile_cont(language_probability, 0.05), 4) AS p05,
 round(quantile_cont(language_probability, 0.5), 4) AS p50, round(quantile_cont(language_probability, 0.95), 4) AS p95, round(quantile_cont(language_probability, 0.99), 4) AS p99
 FROM asr_results GROUP BY language""")
def percentile_linear(spark: SparkSession, folder: str) -> DataFrame:
    """Five points of a distribution, interpolated."""
    p = reports.linear_percentiles(F.col("language_probability"), 0.01, 0.05, 0.5, 0.95, 0.99)
    rows = table(spark, folder, "asr_results", "language", "language_probability").groupBy("language").agg(F.count("language_probability").alias("n"), p.alias("p"))
    return rows.select("language", "n", *[F.round(F.col("p")[i], 4).alias(name) for i, name in enumerate(("p01", "p05", "p50", "p95", "p99"))])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
 SELECT event_type, n, round(value, 6) AS nearest_rank FROM r WHERE k = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)""")
def percentile_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 90th percentile by nearest rank."""
    return reports.nearest_rank(table(spark, folder, "events", "event_type", "value"), "value", 0.9, "event_type").withColumn("nearest_rank", F.round("nearest_rank", 6))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
 round(max(value), 6) AS most, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) AS per_second FROM events GROUP BY event_type""")
def latency_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean, percentiles, maximum and rate of each kind of event."""
    p = reports.linear_percentiles(F.col("value"), 0.5, 0.95)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    rows = table(spark, folder, "events", "event_type", "value", "ts").groupBy("event_type").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p.alias("p"), F.round(F.max("value"), 6).alias("most"),
        F.round(F.count(F.lit(1)) / (seconds(F.max("ts")) - seconds(F.min("ts"))), 9).alias("per_second"),
    )
    return rows.select("event_type", "n", "mean", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), "most", "per_second")


@query("""SELECT event_type, bool_and(value >= 0) AS all_positive, bool_and(user_id IS NOT NULL) AS all_users, bool_and(value < 1000) AS all_small,
 bool_and(value >= 0 AND user_id IS NOT NULL AND value < 1000) AS passed FROM events GROUP BY event_type""")
def requirements_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every event of a kind meets each requirement."""
    a, b, c = F.col("value") >= 0, F.col("user_id").isNotNull(), F.col("value") < 1000
    return table(spark, folder, "events", "event_type", "value", "user_id").groupBy("event_type").agg(F.bool_and(a).alias("all_positive"), F.bool_and(b).alias("all_users"), F.bool_and(c).alias("all_small"), F.bool_and(a & b & c).alias("passed"))


@query(f"""WITH {GATED}, parts AS (
 SELECT 'all' AS part, * FROM gated UNION ALL SELECT 'accepted', * FROM gated WHERE len(reasons) = 0 UNION ALL
 SELECT 'scripted', * FROM gated WHERE collection_format = 'scripted' UNION ALL SELECT 'no_speaker', * FROM gated WHERE speaker_id IS NULL)
 SELECT part, count(*) AS n_rows, {HOURS} AS hours, count(DISTINCT source_dataset) AS sources FROM parts GROUP BY part""")
def combined_report(spark: SparkSession, folder: str) -> DataFrame:
    """One summary over several overlapping parts, in one pass."""
    part = F.array_compact(F.array(
        F.lit("all"), F.when(gates.accepted(F.col("reasons")), "accepted"), F.when(F.col("collection_format") == "scripted", "scripted"), F.when(F.col("speaker_id").isNull(), "no_speaker"),
    ))
    rows = gated(spark, folder).withColumn("part", F.explode(part))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), reports.hours(F.col("duration_seconds")).alias("hours"), F.countDistinct("source_dataset").alias("sources"))


@query("""SELECT a.clip_id, list_sort(list_distinct(list_filter([CASE WHEN coalesce(trim(a.text), '') = '' THEN 'asr_empty' END,
 CASE WHEN a.language <> 'tr' AND a.language_probability >= 0.8 THEN 'wrong_language' END,
 CASE WHEN a.speech_seconds / coalesce(nullif(CASE WHEN isnan(c.duration_seconds) THEN NULL ELSE c.duration_seconds END, 0.0), 1.0) < 0.25 THEN 'insufficient_asr_speech' END], lambda x: x IS NOT NULL))) AS reasons
 FROM asr_results a JOIN (SELECT DISTINCT clip_id, duration_seconds FROM clip_records) c ON a.clip_id = c.clip_id""")
def asr_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons of transcripts that need no distance."""
    clips = table(spark, folder, "clip_records", "clip_id", "duration_seconds").distinct()
    rows = table(spark, folder, "asr_results").join(clips, "clip_id")
    d = F.when(~F.isnan("duration_seconds"), F.col("duration_seconds"))
    codes = gates.reasons(
        (F.coalesce(F.trim("text"), F.lit("")) == "", "asr_empty"),
        ((F.col("language") != "tr") & (F.col("language_probability") >= 0.8), "wrong_language"),
        (F.col("speech_seconds") / F.coalesce(F.nullif(d, F.lit(0.0)), F.lit(1.0)) < 0.25, "insufficient_asr_speech"),
    )
    return rows.select("clip_id", gates.merged(codes).alias("reasons"))


def agreement_sql() -> str:
    """The SQL of asr_agreement."""
    from corpusloom.queries.text import COMPARABLE, distance_sql

    d = "coalesce(nullif(CASE WHEN NOT isnan(duration_seconds) THEN duration_seconds END, 0.0), 1.0)"
    cer = f"CASE WHEN length(ref) = 0 THEN 1.0 ELSE {distance_sql('ref', 'hyp')} / length(ref) END"
    return f"""WITH c AS (SELECT DISTINCT clip_id, transcript, duration_seconds FROM clip_records WHERE transcript IS NOT NULL),
 r AS (SELECT a.*, duration_seconds, {COMPARABLE.format(x='transcript')} AS ref, {COMPARABLE.format(x="coalesce(text, '')")} AS hyp FROM asr_results a JOIN c USING (clip_id)), e AS (SELECT *, {cer} AS cer FROM r)
 SELECT clip_id, round(cer, 6) AS cer, list_filter([CASE WHEN trim(hyp) = '' THEN 'asr_empty' END, CASE WHEN language <> 'tr' AND language_probability >= 0.8 THEN 'wrong_language' END,
  CASE WHEN trim(hyp) <> '' AND cer > CASE WHEN length(ref) < 20 THEN 0.6 ELSE 0.4 END THEN 'transcript_mismatch' END, CASE WHEN speech_seconds / {d} < 0.25 THEN 'insufficient_asr_speech' END], lambda x: x IS NOT NULL) AS reasons FROM e"""


@query(agreement_sql())
def asr_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts that a recogniser does not confirm, with the character error rate over comparison forms."""
    from corpusloom.functions.text import character_error_rate, comparison_form

    clips = table(spark, folder, "clip_records", "clip_id", "transcript", "duration_seconds").distinct().where("transcript is not null")
    rows = table(spark, folder, "asr_results").join(clips, "clip_id").withColumns({"ref": comparison_form(F.col("transcript")), "hyp": comparison_form(F.coalesce("text", F.lit("")))})
    codes = gates.asr_reasons(F.col("ref"), F.col("hyp"), F.col("language"), F.col("language_probability"), F.col("speech_seconds"), F.when(~F.isnan("duration_seconds"), F.col("duration_seconds")))
    return rows.select("clip_id", F.round(character_error_rate(F.col("ref"), F.col("hyp")), 6).alias("cer"), codes.alias("reasons"))
