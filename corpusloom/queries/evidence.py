"""Gates on evidence, contracts of data sets, calibrations and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays, signal
from corpusloom.functions.identity import canonical_split, canonical_split_sql
from corpusloom.functions.text import character_error_rate, comparison_form, word_error_rate
from corpusloom.operators import evidence, joins, reports, sampling
from corpusloom.plans import datasets, scripted, synthesis
from corpusloom.queries.registry import query
from corpusloom.queries.splitting import UNITS, clips, units
from corpusloom.queries.text import COMPARABLE, distance_sql
from corpusloom.queries.vectors import CENTRE, FLAT, centroids
from corpusloom.sources.suites import public_view
from corpusloom.sources.tables import table

LIMITS = evidence.SignalLimits(least_seconds=2.7, most_seconds=100.0, least_level_db=-18.5, most_clipping=0.0, least_active=0.45, least_snr_db=3.0)


@query(f"""WITH {FLAT}, fr AS (SELECT vec_id, (p - 1) // 8 AS f, sqrt(avg(v * v)) AS r FROM x GROUP BY 1, 2), q AS (SELECT vec_id, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM fr GROUP BY 1),
 a AS (SELECT vec_id, avg(CASE WHEN r >= greatest(power(10, -45 / 20.0), lo * 2) THEN 1.0 ELSE 0.0 END) AS active FROM fr JOIN q USING (vec_id) GROUP BY 1),
 b AS (SELECT vec_id, max(label) AS label, count(*) / 20.0 AS seconds, 20 * log10(greatest(sqrt(avg(v * v)), 1e-12)) AS rms, avg(CASE WHEN abs(v) >= 0.995 THEN 1.0 ELSE 0.0 END) AS clip FROM x GROUP BY 1)
 SELECT vec_id, list_filter([CASE WHEN seconds < 2.7 THEN 'duration_too_short' END, CASE WHEN seconds > 100 THEN 'duration_too_long' END, CASE WHEN label % 2 + 1 <> 1 THEN 'not_mono' END, CASE WHEN round(rms, 6) < -18.5 THEN 'level_too_low' END, CASE WHEN clip > 0 THEN 'excessive_clipping' END,
  CASE WHEN round(active, 6) < 0.45 THEN 'insufficient_active_audio' END, CASE WHEN round(20 * log10((hi + 1e-8) / (lo + 1e-8)), 6) < 3 THEN 'low_estimated_snr' END], lambda x: x IS NOT NULL) AS reasons FROM b JOIN a USING (vec_id) JOIN q USING (vec_id)""")
def signal_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The seven codes of signals: vectors at twenty samples a second, with one or two channels by label."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.size("embedding").alias("n"), arrays.signal_metrics(F.col("embedding"), 8).alias("m"))
    r = lambda c: F.round(c, 6)
    codes = evidence.signal_gate(F.col("n") / 20.0, F.col("label") % 2 + 1, r("m.rms_db"), F.col("m.clipping"), r("m.active"), r("m.snr_db"), LIMITS)
    return rows.select("vec_id", codes.alias("reasons"))


LABELS = evidence.LabelLimits(0.75, 0.15, 4.0, 20.0, 0.7, 0.25, 0.3)
_DUAL = f"""c AS (SELECT DISTINCT clip_id, {COMPARABLE.format(x="coalesce(transcript, '')")} AS a, duration_seconds AS d FROM clip_records),
 r AS (SELECT DISTINCT clip_id, {COMPARABLE.format(x="coalesce(text, '')")} AS b, language_probability AS conf, CASE WHEN received_at IS NOT NULL THEN speech_seconds / 10 END AS prob, language FROM asr_results),
 e AS (SELECT *, CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END ELSE {distance_sql('a', 'b')} / length(a) END AS cer, length(replace(a, ' ', '')) / CASE WHEN d IS NULL OR isnan(d) OR d = 0 THEN 1.0 ELSE d END AS rate FROM c JOIN r USING (clip_id))"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "clip_records", "clip_id", "transcript", "duration_seconds").distinct().select("clip_id", comparison_form(F.coalesce("transcript", F.lit(""))).alias("a"), F.col("duration_seconds").alias("d")).distinct()
    prob = F.when(F.col("received_at").isNotNull(), F.col("speech_seconds") / 10)
    r = table(spark, folder, "asr_results", "clip_id", "text", "language_probability", "received_at", "speech_seconds", "language")
    r = r.select("clip_id", comparison_form(F.coalesce("text", F.lit(""))).alias("b"), F.col("language_probability").alias("conf"), prob.alias("prob"), "language").distinct()
    return c.join(r, "clip_id")


@query(f"""WITH {_DUAL} SELECT clip_id, conf, prob, list_filter([CASE WHEN b = '' THEN 'ctc_empty' END, CASE WHEN conf < 0.75 THEN 'ctc_low_confidence' END, CASE WHEN cer > 0.15 THEN 'dual_asr_disagreement' END,
  CASE WHEN rate < 4 OR rate > 20 THEN 'implausible_transcript_rate' END, CASE WHEN prob IS NULL THEN 'forced_alignment_failed' END, CASE WHEN prob < 0.7 THEN 'low_alignment_probability' END,
  CASE WHEN prob IS NOT NULL AND 1 - conf > 0.25 THEN 'speech_before_transcript' END, CASE WHEN prob IS NOT NULL AND conf / 2 > 0.3 THEN 'speech_after_transcript' END], lambda x: x IS NOT NULL) AS reasons FROM e""")
def dual_asr_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Two transcripts of a clip and an alignment, made of the fields of a recogniser, against fixed thresholds."""
    p = _pairs(spark, folder)
    codes = evidence.agreement_gate(F.col("a"), F.col("b"), F.col("conf"), F.col("d"), F.col("prob"), 1 - F.col("conf"), F.col("conf") / 2, LABELS)
    return p.select("clip_id", "conf", "prob", codes.alias("reasons"))


@query(f"""WITH {_DUAL}, t AS (SELECT count(*) AS n, round(greatest(0.5, least(0.95, quantile_cont(conf, 0.05) - 0.02)), 6) AS least_confidence, round(least(0.3, greatest(0.02, quantile_cont(cer, 0.95) + 0.02)), 6) AS most_disagreement,
  round(greatest(0.5, quantile_cont(rate, 0.01) * 0.8), 6) AS least_rate, round(least(30.0, quantile_cont(rate, 0.99) * 1.2), 6) AS most_rate FROM e WHERE cer <= 0.2 AND conf IS NOT NULL) SELECT * FROM t""")
def calibrate_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds of that gate from percentiles of clean pairs, with margins, within limits."""
    p = _pairs(spark, folder).withColumn("cer", F.when(F.length("a") == 0, F.when(F.length("b") == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein("a", "b") / F.length("a")))
    p = p.withColumn("rate", F.length(F.replace("a", F.lit(" "), F.lit(""))) / F.when(F.col("d").isNull() | F.isnan("d") | (F.col("d") == 0), 1.0).otherwise(F.col("d"))).where("cer <= 0.2 and conf is not null")
    q = p.agg(F.count(F.lit(1)).alias("n"), F.percentile("conf", 0.05).alias("c"), F.percentile("cer", 0.95).alias("e"), F.percentile("rate", F.array(F.lit(0.01), F.lit(0.99))).alias("r"))
    six = lambda c, name: F.round(c, 6).alias(name)
    return q.select(
        "n", six(sampling.clamped(F.col("c") - 0.02, 0.5, 0.95), "least_confidence"), six(sampling.clamped(F.col("e") + 0.02, 0.02, 0.3), "most_disagreement"),
        six(F.greatest(F.lit(0.5), F.col("r")[0] * 0.8), "least_rate"), six(F.least(F.lit(30.0), F.col("r")[1] * 1.2), "most_rate"),
    )


@query(f"""WITH {CENTRE}, w AS (SELECT x.vec_id, sum(x.v * c.c) / greatest(sqrt(sum(x.v * x.v)), 1e-8) AS sim FROM x JOIN cen c ON c.label = x.label AND c.p = x.p GROUP BY 1),
 l AS (SELECT label, coalesce(lead(label) OVER (ORDER BY label), min(label) OVER ()) AS next_label FROM (SELECT DISTINCT label FROM embeddings)),
 b AS (SELECT l.label, sum(a.c * n.c) AS sim FROM l JOIN cen a ON a.label = l.label JOIN cen n ON n.label = l.next_label AND n.p = a.p GROUP BY 1)
 SELECT (SELECT count(*) FROM w) AS within_pairs, (SELECT count(*) FROM b) AS between_pairs, round(greatest(0.35, least(0.9, (SELECT quantile_cont(sim, 0.01) FROM w) - 0.03)), 5) AS threshold, round((SELECT quantile_cont(sim, 0.95) FROM b), 5) AS between_p95""")
def speaker_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The least similarity of a vector to its label's centroid, from the first percentile less a margin, within limits;
    beside it the similarity of neighbouring centroids."""
    c = centroids(spark, folder)
    within = table(spark, folder, "embeddings").join(c, "label").select((arrays.dot(F.col("embedding"), F.col("centroid")) / F.greatest(arrays.norm(F.col("embedding")), F.lit(1e-8))).alias("sim"))
    between = joins.ring(c, "label").select(arrays.dot(F.col("centroid"), F.col("next_centroid")).alias("sim"))
    w = within.agg(F.count(F.lit(1)).alias("within_pairs"), F.round(sampling.clamped(F.percentile("sim", 0.01) - 0.03, 0.35, 0.9), 5).alias("threshold"))
    return w.crossJoin(between.agg(F.count(F.lit(1)).alias("between_pairs"), F.round(F.percentile("sim", 0.95), 5).alias("between_p95")))


@query("""SELECT unnest(list_filter([CASE WHEN rights_state IS DISTINCT FROM 'allowed' THEN 'no_training_rights' END, CASE WHEN coalesce(trim(license_id), '') = '' THEN 'no_licence' END, CASE WHEN coalesce(trim(transcript), '') = '' THEN 'no_text' END,
  CASE WHEN duration_seconds IS NULL OR isnan(duration_seconds) OR duration_seconds <= 0 THEN 'no_duration' END, CASE WHEN coalesce(trim(audio_path), '') = '' THEN 'no_audio' END], lambda x: x IS NOT NULL)) AS "check", count(*) AS n_rows FROM clip_records GROUP BY 1""")
def contract_check(spark: SparkSession, folder: str) -> DataFrame:
    """How many records lack what training needs."""
    rows = table(spark, folder, "clip_records", "transcript", "rights_state", "license_id", "duration_seconds", "audio_path")
    return evidence.unusable_counts(rows, evidence.contract_reasons(F.col("transcript"), F.col("rights_state"), F.col("license_id"), F.col("duration_seconds"), F.col("audio_path")))


_SPLIT = canonical_split_sql("source_split")


@query(f"""WITH c AS (SELECT clip_id, speaker_id, coalesce(metadata.parent_clip_id, clip_id) AS parent, {_SPLIT} AS s FROM clip_records),
 k AS (SELECT 'id' AS fault, clip_id AS value, s FROM c UNION ALL SELECT 'speaker', speaker_id, s FROM c UNION ALL SELECT 'parent', parent, s FROM c)
 SELECT fault, value FROM k WHERE value IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT s) > 1 UNION ALL SELECT 'empty', x FROM (VALUES ('train'), ('validation'), ('test')) v(x) WHERE x NOT IN (SELECT s FROM c WHERE s IS NOT NULL)""")
def split_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Ids, speakers and parents in several splits, and splits without rows."""
    rows = table(spark, folder, "clip_records", "clip_id", "speaker_id", "source_split", "metadata.parent_clip_id").withColumn("source_split", canonical_split(F.col("source_split")))
    return evidence.split_faults(rows, {"speaker": F.col("speaker_id"), "parent": F.coalesce("parent_clip_id", "clip_id")})


@query("""SELECT clip_id, source_dataset, source_version, source_split, source_row_id, transcript, normalized_transcript, language, license_id, round(duration_seconds, 6) AS duration_seconds, sample_rate_hz, sha256, regexp_extract(audio_path, '[^/\\\\]*$') AS source_file FROM clip_records""")
def public_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of records that may be published; paths lose their folders, and speakers and votes stay inside."""
    scaled = F.col("duration_seconds") * 1e6  # rounded as the SQL does, in binary: F.round(x, 6) rounds the decimal digits of x
    return public_view(table(spark, folder, "clip_records")).withColumn("duration_seconds", F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 1e6).otherwise(F.col("duration_seconds")))


@query(f"""WITH c AS (SELECT DISTINCT clip_id, source_dataset, {_SPLIT} AS split, duration_seconds AS d, coalesce(metadata.parent_clip_id, clip_id) AS parent FROM clip_records WHERE source_dataset IS DISTINCT FROM 'kitap-anlatim')
 SELECT split, source_dataset, count(*) AS n_rows, round(sum(CASE WHEN isnan(d) THEN 0 ELSE d END) / 3600, 3) AS hours, count(DISTINCT parent) AS parents FROM c GROUP BY 1, 2""")
def foundation_report(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all sources but one, by split and source."""
    rows = table(spark, folder, "clip_records").distinct().withColumns({"source_split": canonical_split(F.col("source_split")), "duration_seconds": F.when(F.isnan("duration_seconds"), 0.0).otherwise(F.col("duration_seconds"))})
    return datasets.foundation(rows, "kitap-anlatim").report


def _nearest(value: str, share: float) -> str:
    return f"(SELECT v FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS k, count(*) OVER () AS n FROM s) WHERE k = CAST(round_even((n - 1) * {share}, 0) AS BIGINT))"


@query(f"""WITH {_DUAL}, s AS (SELECT cer FROM e WHERE length(a) > 0) SELECT count(*) AS n, round(avg(cer), 6) AS mean_cer, round({_nearest('cer', 0.9)}, 6) AS p90_cer, round({_nearest('cer', 0.1)}, 6) AS p10_cer FROM s""")
def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and nearest-rank percentiles of error rates."""
    s = _pairs(spark, folder).where("length(a) > 0").select(character_error_rate(F.col("a"), F.col("b")).alias("cer"))
    one = s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cer"), 6).alias("mean_cer"))
    at = lambda share, name: reports.nearest_rank(s, "cer", share).select(F.round("nearest_rank", 6).alias(name))
    return one.crossJoin(at(0.9, "p90_cer")).crossJoin(at(0.1, "p10_cer"))


@query(f"""WITH {FLAT}, s AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS d, avg(CASE WHEN abs(v) >= 0.3 THEN 1.0 ELSE 0.0 END) AS c FROM x GROUP BY 1),
 f AS (SELECT a.vec_id, (a.p - 1) // 8 AS f, avg(abs(a.v - b.v)) AS move FROM x a JOIN x b ON b.vec_id = a.vec_id AND b.p = a.p + 8 GROUP BY 1, 2), t AS (SELECT vec_id, avg(CASE WHEN move < 0.1 THEN 1.0 ELSE 0.0 END) AS st FROM f GROUP BY 1)
 SELECT vec_id, round(-(abs(m) + abs(d - 1) + 2 * c + 0.5 * st), 6) AS score FROM s JOIN t USING (vec_id)""")
def mel_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How unlike a normalised spectrogram each vector is, as eight bands a frame."""
    return table(spark, folder, "embeddings").select("vec_id", F.round(signal.mel_score(F.col("embedding"), 8, 0.3, 0.1, (1.0, 1.0, 2.0, 0.5)), 6).alias("score"))


@query(f"""WITH {FLAT}, g AS (SELECT p, avg(v) AS b FROM x GROUP BY 1), t AS (SELECT label, p, round(avg(v) - any_value(b), 9) AS d FROM x JOIN g USING (p) GROUP BY 1, 2),
 r AS (SELECT label, p - 1 AS band, row_number() OVER (PARTITION BY label ORDER BY abs(d) DESC, p) AS rank FROM t) SELECT label, rank, band FROM r WHERE rank <= 3""")
def largest_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The three positions at which a label's mean is furthest from the global one."""
    e = table(spark, folder, "embeddings")
    base = arrays.by_position(e, "embedding").select(F.col("mean").alias("base"))
    d = arrays.by_position(e, "embedding", "label").crossJoin(F.broadcast(base)).select("label", F.zip_with("mean", "base", lambda a, b: F.round(a - b, 9)).alias("d"))
    return d.select("label", F.posexplode(signal.largest_bands(F.col("d"), 3)).alias("rank", "band")).select("label", (F.col("rank") + 1).cast("long").alias("rank"), F.col("band").cast("long").alias("band"))


@query()
def rank_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches over all clips by length, under a budget of frames, dealt to eight ranks in a seeded order."""
    rows = clips(spark, folder, "clip_id", "duration_seconds").withColumn("all", F.lit(None).cast("string"))
    frames = F.greatest(F.lit(1), F.ceil(units() * 24 / 256)).cast("long")
    batches = sampling.duration_batches(rows, "all", "clip_id", frames, 38_400, 32)
    return sampling.ranked_batches(batches.select("clip_id", "batch"), "batch", 8, "7")


@query(f"""WITH e AS (SELECT DISTINCT clip_id, {UNITS} / 1000.0 * least(1.0, greatest(0.0, coalesce(metadata.quality_score, 1.0))) AS s FROM clip_records) SELECT clip_id, round(s, 3) AS active_seconds FROM e""")
def active_seconds(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds of speech of each clip, with the quality score as its active share."""
    rows = clips(spark, folder, "clip_id", "duration_seconds", "metadata.quality_score")
    return rows.select("clip_id", F.round(evidence.active_seconds(units() / 1000.0, F.col("quality_score")), 3).alias("active_seconds")).distinct()


@query("""WITH l AS (SELECT event_type AS level, event_id, epoch(ts) AS started, coalesce(value, 0) / 1000 AS latency, (event_id % 50) / 100.0 AS queued, event_id % 17 <> 0 AS met FROM events)
 SELECT level, count(*) AS requests, round(count(*) / greatest(max(started + latency) - min(started), 1e-9), 6) AS per_second, count_if(NOT met) AS failures, round(quantile_cont(latency, 0.5), 6) AS service_p50, round(quantile_cont(latency, 0.95), 6) AS service_p95,
  round(quantile_cont(CAST(queued AS DOUBLE), 0.5), 6) AS queue_p50, round(quantile_cont(CAST(queued AS DOUBLE), 0.95), 6) AS queue_p95 FROM l GROUP BY 1""")
def concurrency_levels(spark: SparkSession, folder: str) -> DataFrame:
    """A load test made of events, their types as levels."""
    e = table(spark, folder, "events", "event_id", "event_type", "ts", "value")
    rows = e.select(F.col("event_type").alias("level"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("started"), (F.coalesce("value", F.lit(0.0)) / 1000).alias("latency"), (F.col("event_id") % 50 / 100.0).alias("queued"), (F.col("event_id") % 17 != 0).alias("met"))
    return synthesis.level_summary(rows, met=F.col("met"))


@query()
def scripted_report(spark: SparkSession, folder: str) -> DataFrame:
    """Words, exact matches and accepted segments of clips whose recognised words are spread evenly over their speech."""
    asr = table(spark, folder, "asr_results", "clip_id", "text", "speech_seconds").where("text is not null and speech_seconds > 0").distinct()
    words = F.split(F.trim("text"), r"\s+")
    step = F.col("speech_seconds") / F.size(words)
    timed = F.transform(words, lambda w, i: F.struct(w.alias("text"), (i * step).alias("start"), ((i + 1) * step).alias("end")))
    rows = table(spark, folder, "clip_records", "clip_id", "transcript").where("transcript is not null").distinct().join(asr, "clip_id")
    return scripted.parent_reports(scripted.with_script_reasons(scripted.scripted_segments(rows.withColumn("timed", timed), "clip_id", "transcript", "timed")))
