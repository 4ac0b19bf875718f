"""Composite pipelines, ordered state and incremental stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import anonymous_id, language_code
from corpusloom.operators import gates
from corpusloom.plans import pipelines
from corpusloom.queries.registry import query
from corpusloom.queries.reports import GATED, gated
from corpusloom.queries.splitting import _FOLD, BUCKET, UNITS, units
from corpusloom.sources.tables import table
from corpusloom.streaming import incremental


@query(f"""WITH {GATED}, e AS (SELECT DISTINCT g.clip_id, g.source_dataset AS source, g.speaker_id AS speaker, c.session_id, CASE WHEN c.source_split IN ('train', 'validation', 'test') THEN c.source_split END AS split,
  {UNITS.replace('duration_seconds', 'g.duration_seconds')} AS s, coalesce(g.metadata.quality_score, 0) AS q, sha256(g.clip_id) AS h FROM gated g JOIN clip_records c USING (clip_id) WHERE len(g.reasons) = 0),
 one AS (SELECT source || '|' || speaker AS o, unnest({_FOLD.format(order='q DESC, h, clip_id', cap=60000)}) AS clip_id FROM e WHERE speaker IS NOT NULL AND s <= 60000 GROUP BY 1),
 k AS (SELECT * FROM e WHERE speaker IS NULL OR clip_id IN (SELECT clip_id FROM one)),
 two AS (SELECT source, unnest({_FOLD.format(order='q DESC, h, clip_id', cap=3600000)}) AS clip_id FROM k WHERE s <= 3600000 GROUP BY source)
 SELECT k.clip_id, k.source, coalesce(k.split, CASE WHEN {BUCKET.format(x='coalesce(session_id, clip_id)', m=100)} < 90 THEN 'train' WHEN {BUCKET.format(x='coalesce(session_id, clip_id)', m=100)} < 95 THEN 'validation' ELSE 'test' END) AS split
 FROM k JOIN two USING (clip_id)""")
def combined_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted clips under two caps, with splits."""
    own = table(spark, folder, "clip_records", "clip_id", "session_id", "source_split").distinct()
    split = F.when(F.col("source_split").isin("train", "validation", "test"), F.col("source_split"))
    rows = gated(spark, folder).join(own, "clip_id").select(
        "clip_id", F.col("source_dataset").alias("source"), F.col("speaker_id").alias("speaker"), F.col("session_id").alias("session"), split.alias("split"),
        units().alias("units"), F.col("metadata.quality_score").alias("quality"), "reasons",
    )
    return pipelines.combined_dataset(rows, 60_000, 3_600_000)


@query("""SELECT p.id, g.config, CAST(g.scale AS DOUBLE) AS scale, s.seed FROM evaluation_prompts p CROSS JOIN (VALUES ('base', 1.0), ('warm', 1.1)) g(config, scale) CROSS JOIN (SELECT range AS seed FROM range(4)) s""")
def param_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with every configuration and seed."""
    prompts = table(spark, folder, "evaluation_prompts", "id")
    return pipelines.parameter_grid(prompts, 4, [{"config": "base", "scale": 1.0}, {"config": "warm", "scale": 1.1}]).select("id", "config", "scale", "seed")


@query("""WITH m AS (SELECT event_id, user_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WHERE value IS NOT NULL),
 b AS (SELECT *, coalesce(value > best * 1.5, false) AS bad FROM m), i AS (SELECT *, sum(CASE WHEN NOT bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM b)
 SELECT event_id, round(best, 6) AS best, CASE WHEN bad THEN CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) ELSE 0 END AS streak FROM i""")
def degradation_streak(spark: SparkSession, folder: str) -> DataFrame:
    """How many values in a row were far above the best so far."""
    e = table(spark, folder, "events", "event_id", "user_id", "value").where("value is not null")
    return incremental.degradation_streaks(e, "user_id", "event_id", "value", 1.5).select("event_id", F.round("best", 6).alias("best"), F.col("streak").cast("long").alias("streak"))


@query("""WITH s AS (SELECT event_id, user_id, value, event_type = 'purchase' AS d, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM events)
 SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event, round(avg(value), 6) AS mean FROM s WHERE NOT d GROUP BY 1, 2""")
def delimiter_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Events between purchases."""
    e = table(spark, folder, "events", "event_id", "user_id", "value", "event_type")
    s = incremental.sessions(e, "user_id", "event_id", F.col("event_type") == "purchase")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH c AS (SELECT DISTINCT clip_id, metadata.parent_clip_id AS parent FROM clip_records WHERE metadata.parent_clip_id IS NOT NULL)
 SELECT clip_id, parent, row_number() OVER (PARTITION BY parent ORDER BY clip_id) - 1 AS segment FROM c""")
def segment_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each segment in its parent, from 0."""
    c = table(spark, folder, "clip_records", "clip_id", "metadata.parent_clip_id").where("parent_clip_id is not null").distinct()
    return c.select("clip_id", F.col("parent_clip_id").alias("parent"), (F.row_number().over(Window.partitionBy("parent_clip_id").orderBy("clip_id")) - 1).cast("long").alias("segment"))


@query("""SELECT metadata.parent_clip_id AS parent, count(DISTINCT clip_id) AS segments, count(DISTINCT CASE WHEN rights_state = 'allowed' THEN clip_id END) AS allowed FROM clip_records WHERE metadata.parent_clip_id IS NOT NULL GROUP BY 1""")
def parent_report(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of each parent."""
    c = table(spark, folder, "clip_records", "clip_id", "metadata.parent_clip_id", "rights_state").where("parent_clip_id is not null").distinct()
    return c.groupBy(F.col("parent_clip_id").alias("parent")).agg(F.countDistinct("clip_id").alias("segments"), F.countDistinct(F.when(F.col("rights_state") == "allowed", F.col("clip_id"))).alias("allowed"))


@query("""SELECT update, round(CASE WHEN update < 100 THEN 0.001 * (update + 1) / 100 ELSE 0.001 * 0.5 * (1 + cos(pi() * (update - 100) / 900.0)) END, 9) AS rate FROM (SELECT range AS update FROM range(1000))""")
def learning_rate(spark: SparkSession, folder: str) -> DataFrame:
    """A schedule with a linear warm-up and a cosine."""
    u = spark.range(1000).withColumnRenamed("id", "update")
    cosine = 0.001 * 0.5 * (1 + F.cos(F.pi() * (F.col("update") - 100) / 900.0))
    return u.select("update", F.round(F.when(F.col("update") < 100, 0.001 * (F.col("update") + 1) / 100).otherwise(cosine), 9).alias("rate"))


@query("SELECT id, least(2400, greatest(40, CAST(ceil(length(text) * 8.5e-2 * 24000 / 256) AS BIGINT))) AS frames FROM evaluation_prompts WHERE text IS NOT NULL")
def rate_floor(spark: SparkSession, folder: str) -> DataFrame:
    """The least number of frames for a prompt's characters."""
    p = table(spark, folder, "evaluation_prompts", "id", "text").where("text is not null")
    return p.select("id", F.least(F.lit(2400).cast("long"), F.greatest(F.lit(40).cast("long"), F.ceil(F.length("text") * 0.085 * 24000 / 256).cast("long"))).alias("frames"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour; the same function serves a stream with a watermark."""
    e = table(spark, folder, "events", "ts", "event_type", "value")
    w = incremental.windowed_counts(e, "ts", "event_type", "1 hour", "10 minutes")
    return w.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT 'cv-' || substr(sha256('v1:' || client_id), 1, 20) AS speaker, path, nullif(trim(sentence), '') AS sentence, up_votes, CASE WHEN lower(replace(trim(locale), '_', '-')) IN ('tr', 'tr-tr', 'tur') THEN 'tr' ELSE locale END AS locale
 FROM (SELECT DISTINCT * FROM cv_validated) WHERE path IS NOT NULL AND trim(sentence) <> ''""")
def raw_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Upstream rows as records."""
    rows = table(spark, folder, "cv_validated").distinct().where("path is not null and trim(sentence) <> ''")
    return rows.select(anonymous_id("cv-", "v1", F.col("client_id")).alias("speaker"), "path", F.nullif(F.trim("sentence"), F.lit("")).alias("sentence"), "up_votes", language_code(F.col("locale")).alias("locale"))


@query("""WITH l AS (SELECT clip_id, arg_max(text, received_at) AS text, max(received_at) AS received_at FROM asr_results WHERE received_at IS NOT NULL GROUP BY 1) SELECT count(*) AS clips, count(text) AS texts, CAST(floor(epoch(max(received_at))) AS BIGINT) AS latest FROM l""")
def latest_results(spark: SparkSession, folder: str) -> DataFrame:
    """The last transcript of each clip: late rows replace earlier ones."""
    a = table(spark, folder, "asr_results", "clip_id", "text", "received_at").where("received_at is not null")
    last = a.groupBy("clip_id").agg(F.max_by("text", "received_at").alias("text"), F.max("received_at").alias("received_at"))
    return last.agg(F.count(F.lit(1)).alias("clips"), F.count("text").alias("texts"), F.unix_seconds(F.max("received_at").cast("timestamp")).alias("latest"))


@query(f"""WITH {GATED} SELECT g.clip_id, coalesce(a.n, 0) AS transcripts, len(g.reasons) = 0 AND coalesce(a.n, 0) = 0 AS pending FROM (SELECT DISTINCT clip_id, reasons FROM gated) g LEFT JOIN (SELECT clip_id, count(*) AS n FROM asr_results GROUP BY 1) a USING (clip_id)""")
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Which accepted clips a recogniser still has to see."""
    rows = gated(spark, folder).select("clip_id", "reasons").distinct()
    done = table(spark, folder, "asr_results", "clip_id").groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    j = rows.join(done, "clip_id", "left")
    return j.select("clip_id", F.coalesce("n", F.lit(0)).alias("transcripts"), (gates.accepted(F.col("reasons")) & F.col("n").isNull()).alias("pending"))


