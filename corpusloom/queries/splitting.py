"""Duplicates, splits, samples, caps and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.identity import canonical_id
from corpusloom.functions.text import character_error_rate, comparison_form
from corpusloom.operators import dedup, joins, sampling, splits
from corpusloom.operators.vocabulary import character_vocabulary, encoded, speaker_vocabulary
from corpusloom.queries.registry import query
from corpusloom.queries.text import COMPARABLE, distance_sql
from corpusloom.sources.tables import table

DISTINCT = "c AS (SELECT DISTINCT clip_id, source_dataset, source_split, audio_path, speaker_id, session_id, sha256, normalized_transcript, transcript, collection_format, duration_seconds, metadata FROM clip_records)"
UNITS = "CAST(round((CASE WHEN duration_seconds IS NULL OR isnan(duration_seconds) THEN 0.0 ELSE duration_seconds END) * 1000) AS BIGINT)"
BUCKET = "CAST(('0x' || substr(sha256({x}), 1, 8)) AS BIGINT) % {m}"


def clips(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Distinct clips, with a few columns."""
    return table(spark, folder, "clip_records", *columns).distinct()


def units() -> F.Column:
    """Known milliseconds."""
    return F.round(F.when(F.col("duration_seconds").isNull() | F.isnan("duration_seconds"), 0.0).otherwise(F.col("duration_seconds")) * 1000).cast("long")


@query(f"""WITH {DISTINCT} SELECT clip_id, CASE WHEN sha256 IS NOT NULL AND min(clip_id) OVER (PARTITION BY sha256) <> clip_id
 THEN min(clip_id) OVER (PARTITION BY sha256) END AS duplicate_of FROM (SELECT DISTINCT clip_id, sha256 FROM c)""")
def exact_dup_mark(spark: SparkSession, folder: str) -> DataFrame:
    """The first clip of each digest stays."""
    return dedup.mark_duplicates(clips(spark, folder, "clip_id", "sha256"), "sha256", ["clip_id"]).select("clip_id", "duplicate_of")


@query(f"""WITH {DISTINCT}, e AS (SELECT DISTINCT clip_id, normalized_transcript AS t, audio_path, coalesce(metadata.quality_score >= 0.5, false) AS fine FROM c),
 m AS (SELECT *, arg_min(clip_id, (audio_path, clip_id)) OVER (PARTITION BY t) AS first_id FROM e WHERE fine)
 SELECT clip_id, CASE WHEN t IS NOT NULL AND first_id <> clip_id THEN first_id END AS duplicate_of FROM m UNION ALL SELECT clip_id, NULL FROM e WHERE NOT fine""".replace("arg_min(clip_id, (audio_path, clip_id)) OVER (PARTITION BY t)", "first_value(clip_id) OVER (PARTITION BY t ORDER BY clip_id)"))
def accepted_only_dup_mark(spark: SparkSession, folder: str) -> DataFrame:
    """The same among good clips, by text."""
    rows = clips(spark, folder, "clip_id", "normalized_transcript", "metadata.quality_score").withColumn("fine", F.coalesce(F.col("quality_score") >= 0.5, F.lit(False)))
    return dedup.mark_accepted_duplicates(rows, "normalized_transcript", ["clip_id"], F.col("fine")).select("clip_id", "duplicate_of")


@query("""SELECT 'clip_id' AS key, clip_id AS value, count(*) AS n_rows FROM clip_records WHERE clip_id IS NOT NULL GROUP BY clip_id HAVING count(*) > 1
 UNION ALL SELECT 'audio_path', audio_path, count(*) FROM clip_records WHERE audio_path IS NOT NULL GROUP BY audio_path HAVING count(*) > 1""")
def unique_identity_check(spark: SparkSession, folder: str) -> DataFrame:
    """Values that should be unique and are not."""
    return dedup.not_unique(table(spark, folder, "clip_records", "clip_id", "audio_path"), "clip_id", "audio_path")


@query(f"SELECT speaker_id, CASE WHEN b < 9000 THEN 'train' WHEN b < 9500 THEN 'validation' ELSE 'test' END AS split FROM (SELECT DISTINCT speaker_id, {BUCKET.format(x=chr(39) + 'common-voice-split-v1:' + chr(39) + ' || speaker_id', m=10000)} AS b FROM clip_records WHERE speaker_id IS NOT NULL)")
def hash_split_10000(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers split by salted hash."""
    speakers = table(spark, folder, "clip_records", "speaker_id").where("speaker_id is not null").distinct()
    return speakers.select("speaker_id", splits.speaker_split(F.col("speaker_id")).alias("split"))


@query(f"SELECT session_id, CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'validation' ELSE 'test' END AS split FROM (SELECT DISTINCT session_id, {BUCKET.format(x='session_id', m=100)} AS b FROM clip_records WHERE session_id IS NOT NULL)")
def hash_split_100(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions split by hash."""
    return table(spark, folder, "clip_records", "session_id").where("session_id is not null").distinct().select("session_id", splits.parent_split(F.col("session_id")).alias("split"))


@query("""WITH p AS (SELECT DISTINCT session_id AS parent FROM clip_records WHERE session_id IS NOT NULL), n AS (SELECT count(*) AS n FROM p),
 r AS (SELECT parent, row_number() OVER (ORDER BY sha256(parent), parent) AS k, n, greatest(1, CAST(round_even(n * 0.05, 0) AS INT)) AS h FROM p, n)
 SELECT parent, CASE WHEN n < 3 THEN 'train' WHEN k <= h THEN 'validation' WHEN k <= 2 * h THEN 'test' ELSE 'train' END AS split FROM r""")
def parent_ranked_split(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions split by rank in hash order."""
    return splits.ranked_split(table(spark, folder, "clip_records", "session_id"), "session_id")


@query("""WITH p AS (SELECT DISTINCT session_id AS parent FROM clip_records WHERE source_dataset = 'kitap-anlatim' AND session_id IS NOT NULL), n AS (SELECT count(*) AS n FROM p),
 r AS (SELECT parent, row_number() OVER (ORDER BY sha256('kitap-anlatim:' || parent), parent) AS k, n, greatest(1, CAST(round_even(n * 0.1, 0) AS INT)) AS h FROM p, n)
 SELECT parent, CASE WHEN n < 3 THEN 'train' WHEN k <= h THEN 'validation' WHEN k <= 2 * h THEN 'test' ELSE 'train' END AS split FROM r""")
def target_holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of one source, a tenth held out twice."""
    rows = table(spark, folder, "clip_records", "source_dataset", "session_id").where("source_dataset = 'kitap-anlatim'")
    return splits.ranked_split(rows, "session_id", 0.1, 0.1, "kitap-anlatim:")


@query("""WITH e AS (SELECT DISTINCT clip_id, speaker_id FROM clip_records WHERE speaker_id IS NOT NULL),
 r AS (SELECT clip_id, speaker_id, row_number() OVER (PARTITION BY speaker_id ORDER BY sha256('h:' || clip_id), clip_id) AS k, count(*) OVER (PARTITION BY speaker_id) AS n FROM e)
 SELECT clip_id, k <= CASE WHEN n = 1 THEN 0 ELSE least(n - 1, greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT))) END AS held FROM r""")
def stratified_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of each speaker's clips."""
    rows = clips(spark, folder, "clip_id", "speaker_id").where("speaker_id is not null")
    return splits.stratified_holdout(rows, "speaker_id", "clip_id", 0.1, "h").select("clip_id", "held")


@query("""SELECT source_split, CASE WHEN k IN ('train', 'training') THEN 'train' WHEN k IN ('validation', 'valid', 'val', 'dev', 'development') THEN 'validation' WHEN k IN ('test', 'testing') THEN 'test' END AS split, count(*) AS n_rows
 FROM (SELECT source_split, regexp_replace(lower(translate(source_split, 'Iıİ', 'iii')), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM clip_records) GROUP BY 1, 2""")
def split_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling of a split and what it means."""
    return table(spark, folder, "clip_records", "source_split").groupBy("source_split", splits.split_names(F.col("source_split")).alias("split")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT speaker_id AS value, array_to_string(list_sort(list(DISTINCT source_split)), ',') AS splits FROM clip_records WHERE speaker_id IS NOT NULL AND source_split IS NOT NULL
 GROUP BY speaker_id HAVING count(DISTINCT source_split) > 1""")
def split_overlap_check(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers in more than one split."""
    found = splits.crossing(table(spark, folder, "clip_records", "speaker_id", "source_split"), "speaker_id", "source_split")
    return found.select("value", F.array_join("splits", ",").alias("splits"))


@query(f"""WITH f AS (SELECT session_id AS parent, min(source_split) AS split FROM clip_records WHERE session_id IS NOT NULL AND source_split IN ('train', 'validation', 'test') AND collection_format = 'scripted' GROUP BY 1),
 e AS (SELECT DISTINCT clip_id, session_id FROM clip_records WHERE session_id IS NOT NULL)
 SELECT clip_id, coalesce(f.split, CASE WHEN {BUCKET.format(x='session_id', m=100)} < 90 THEN 'train' WHEN {BUCKET.format(x='session_id', m=100)} < 95 THEN 'validation' ELSE 'test' END) AS split FROM e LEFT JOIN f ON f.parent = e.session_id""")
def fixed_split_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed splits of some sessions, hashed ones of the others."""
    rows = table(spark, folder, "clip_records", "clip_id", "session_id", "source_split", "collection_format")
    some = rows.where("session_id is not null and source_split in ('train', 'validation', 'test') and collection_format = 'scripted'")
    fixed = some.groupBy(F.col("session_id").alias("parent")).agg(F.min("source_split").alias("split"))
    return splits.fixed_or_hashed(rows.where("session_id is not null").select("clip_id", "session_id").distinct(), fixed, "session_id").select("clip_id", "split")


@query("SELECT clip_id FROM (SELECT DISTINCT clip_id FROM clip_records) ORDER BY sha256('v1:' || clip_id), clip_id LIMIT 100")
def hash_sample_topn(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of 100 clips by hash order."""
    return sampling.hash_sample(clips(spark, folder, "clip_id"), "clip_id", 100, "v1")


@query(f"""WITH c AS (SELECT DISTINCT clip_id, {COMPARABLE.format(x="coalesce(transcript, '')")} AS a, metadata.estimated_snr_db AS s FROM clip_records), r AS (SELECT DISTINCT clip_id, {COMPARABLE.format(x='text')} AS b FROM asr_results WHERE text IS NOT NULL),
 e AS (SELECT clip_id, any_value(s) AS s, min(CASE WHEN b IS NULL THEN NULL WHEN length(a) = 0 THEN 1.0 ELSE {distance_sql('a', 'b')} / length(a) END) AS cer FROM c LEFT JOIN r USING (clip_id) GROUP BY clip_id)
 SELECT clip_id FROM e ORDER BY round(coalesce(cer, 0), 9), coalesce(s, 0) DESC, sha256(clip_id) LIMIT 50""")
def quality_order_top(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best clips by error rate, then noise distance, then hash; unknown values count as 0."""
    a = clips(spark, folder, "clip_id", "transcript", "metadata.estimated_snr_db").withColumn("a", comparison_form(F.coalesce("transcript", F.lit(""))))
    b = table(spark, folder, "asr_results", "clip_id", "text").where("text is not null").select("clip_id", comparison_form(F.col("text")).alias("b")).distinct()
    cer = F.when(F.col("b").isNotNull(), character_error_rate(F.col("a"), F.col("b")))
    rows = a.join(b, "clip_id", "left").groupBy("clip_id").agg(F.min(cer).alias("cer"), F.max("estimated_snr_db").alias("snr"))
    return rows.orderBy(F.round(F.coalesce("cer", F.lit(0.0)), 9), F.coalesce("snr", F.lit(0.0)).desc(), F.sha2("clip_id", 256)).limit(50).select("clip_id")


_FOLD = """list_reduce(list_prepend({{'t': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'k': CAST([] AS VARCHAR[])}}, list({{'t': CAST(0 AS BIGINT), 'n': s, 'k': [clip_id]}} ORDER BY {order})),
 lambda a, x: CASE WHEN a.t + x.n <= {cap} THEN {{'t': a.t + x.n, 'n': CAST(0 AS BIGINT), 'k': list_concat(a.k, x.k)}} ELSE a END).k"""
CAPPED = f"SELECT speaker_id, unnest({_FOLD.format(order='q DESC, h, clip_id', cap=120000)}) AS clip_id FROM e WHERE s <= 120000 GROUP BY speaker_id"


@query(f"""WITH e AS (SELECT DISTINCT clip_id, speaker_id, {UNITS} AS s, coalesce(metadata.quality_score, 0) AS q, sha256(clip_id) AS h FROM clip_records WHERE speaker_id IS NOT NULL)
 {CAPPED}""")
def greedy_duration_cap(spark: SparkSession, folder: str) -> DataFrame:
    """At most two minutes of each speaker, best clips first, smaller ones after one that does not fit."""
    rows = clips(spark, folder, "clip_id", "speaker_id", "duration_seconds", "metadata.quality_score").where("speaker_id is not null")
    order = [-F.coalesce("quality_score", F.lit(0.0)), F.sha2("clip_id", 256)]
    return sampling.greedy_cap(rows, "speaker_id", "clip_id", units(), order, 120_000)


@query(f"""WITH e AS (SELECT DISTINCT clip_id, speaker_id, source_dataset, {UNITS} AS s, coalesce(metadata.quality_score, 0) AS q, sha256(clip_id) AS h FROM clip_records WHERE speaker_id IS NOT NULL),
 one AS ({CAPPED}), two AS (SELECT e.* FROM e JOIN one USING (clip_id))
 SELECT source_dataset, unnest({_FOLD.format(order='q DESC, h, clip_id', cap=1800000)}) AS clip_id FROM two WHERE s <= 1800000 GROUP BY source_dataset""")
def two_level_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Two minutes of a speaker, then half an hour of a source."""
    rows = clips(spark, folder, "clip_id", "speaker_id", "source_dataset", "duration_seconds", "metadata.quality_score").where("speaker_id is not null")
    order = [-F.coalesce("quality_score", F.lit(0.0)), F.sha2("clip_id", 256)]
    one = sampling.greedy_cap(rows, "speaker_id", "clip_id", units(), order, 120_000)
    return sampling.greedy_cap(rows.join(one.select("clip_id"), "clip_id"), "source_dataset", "clip_id", units(), order, 1_800_000)


@query(f"""WITH e AS (SELECT DISTINCT clip_id, {UNITS} AS s, sha256('replay:' || clip_id) AS h FROM clip_records),
 r AS (SELECT clip_id, s, sum(s) OVER (ORDER BY h, clip_id ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT clip_id FROM r WHERE run - s < 3600000""")
def replay_until_seconds(spark: SparkSession, folder: str) -> DataFrame:
    """Clips in hash order until an hour is reached."""
    rows = clips(spark, folder, "clip_id", "duration_seconds")
    return sampling.until_reached(rows, [F.sha2(F.concat(F.lit("replay:"), "clip_id"), 256), F.col("clip_id")], units(), 3_600_000).select("clip_id")


@query("""WITH e AS (SELECT DISTINCT clip_id FROM clip_records), n AS (SELECT CAST(round_even(count(*) * 0.01, 0) AS BIGINT) AS k FROM e)
 SELECT clip_id FROM (SELECT clip_id, row_number() OVER (ORDER BY sha256('ratio:' || clip_id), clip_id) AS r FROM e) CROSS JOIN n WHERE r <= k""")
def replay_count_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """A hundredth of the clips, by hash order."""
    rows = clips(spark, folder, "clip_id")
    n = rows.agg(F.bround(F.count(F.lit(1)) * 0.01).cast("int")).first()[0]
    return sampling.hash_sample(rows, "clip_id", n, "ratio")


@query()
def duration_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of clips of like length, session by session, under a budget of frames; clips without a session are one group."""
    rows = clips(spark, folder, "clip_id", "session_id", "duration_seconds").withColumn("session_id", canonical_id(F.col("session_id")))
    return sampling.duration_batches(rows, "session_id", "clip_id", units(), 30_000, 8)


@query("""SELECT round(greatest(0.35, least(0.9, quantile_cont(q, 0.01) - 0.03)), 6) AS least_quality, round(greatest(3.0, least(30.0, quantile_cont(s, 0.05) - 1.0)), 6) AS least_snr, count(*) AS n
 FROM (SELECT clip_id, metadata.quality_score AS q, metadata.estimated_snr_db AS s FROM clip_records WHERE metadata.quality_score >= 0.5)""")
def calibrate_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds from percentiles of clean clips, with a margin, within limits."""
    rows = table(spark, folder, "clip_records", "metadata.quality_score", "metadata.estimated_snr_db").where("quality_score >= 0.5")
    p = rows.agg(F.percentile("quality_score", 0.01).alias("q"), F.percentile("estimated_snr_db", 0.05).alias("s"), F.count(F.lit(1)).alias("n"))
    return p.select(F.round(sampling.clamped(F.col("q") - 0.03, 0.35, 0.9), 6).alias("least_quality"), F.round(sampling.clamped(F.col("s") - 1.0, 3.0, 30.0), 6).alias("least_snr"), "n")


@query("""WITH ch AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM evaluation_prompts) SELECT ch, row_number() OVER (ORDER BY ch) + 1 AS id FROM ch WHERE ch <> ''""")
def char_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of the prompts, numbered in order after two reserved ids."""
    return character_vocabulary(table(spark, folder, "evaluation_prompts", "text"), "text")


@query("""WITH v AS (SELECT ch, row_number() OVER (ORDER BY ch) + 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM evaluation_prompts WHERE category = 'general') WHERE ch <> ''),
 e AS (SELECT id AS prompt, generate_subscripts(string_split(text, ''), 1) AS p, unnest(string_split(text, '')) AS ch FROM evaluation_prompts WHERE text IS NOT NULL AND text <> '')
 SELECT prompt, array_to_string(list(coalesce(v.id, 1) ORDER BY p), ' ') AS ids FROM e LEFT JOIN v USING (ch) GROUP BY prompt""")
def token_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts as ids of the characters of one category; 1 for others."""
    prompts = table(spark, folder, "evaluation_prompts", "id", "category", "text")
    vocabulary = character_vocabulary(prompts.where("category = 'general'"), "text")
    return encoded(prompts.where("text <> ''"), "text", vocabulary).select(F.col("id").alias("prompt"), F.array_join("ids", " ").alias("ids"))


@query("""SELECT DISTINCT speaker_id FROM clip_records WHERE source_split IN ('validation', 'test') AND speaker_id <> '' AND speaker_id NOT IN (SELECT speaker_id FROM clip_records WHERE source_split = 'train' AND speaker_id <> '')""")
def unknown_speakers(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers of the held-out splits that the vocabulary of the training split lacks."""
    rows = table(spark, folder, "clip_records", "speaker_id", "source_split").where("speaker_id <> ''")
    known = speaker_vocabulary(rows.where("source_split = 'train'"), "speaker_id")
    return rows.where("source_split in ('validation', 'test')").select("speaker_id").distinct().join(known, F.col("speaker_id") == F.col("speaker"), "left_anti")


@query("SELECT kind, name, balance FROM (SELECT 'supplier' AS kind, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT 'customer', c_name, c_acctbal FROM customer)")
def union_schema_checked(spark: SparkSession, folder: str) -> DataFrame:
    """A bag union of two inputs whose columns must be the same."""
    a = table(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return joins.same_schema_union(a, b)


@query("SELECT * FROM (VALUES ('general'), ('numeric'), ('long_form'), ('singing')) t(category) WHERE category NOT IN (SELECT category FROM evaluation_prompts WHERE category IS NOT NULL)")
def required_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Required categories that no prompt has."""
    need = spark.createDataFrame([("general",), ("numeric",), ("long_form",), ("singing",)], "category string")
    return need.join(table(spark, folder, "evaluation_prompts", "category").distinct(), "category", "left_anti")


