"""Text functions over transcripts and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import alignment, phonemes, spelling, text
from corpusloom.operators import gates
from corpusloom.queries.registry import query
from corpusloom.sources.tables import table

LOWER = "replace(lower(translate({x}, 'Iİ', 'ıi')), chr(775), '')"
COMPARABLE = "trim(regexp_replace(regexp_replace(" + LOWER.format(x="translate(translate({x}, '’‘`´', ''''''''''), '\"“”„«»', '')") + ", '[^0-9a-zçöüğış'']+', ' ', 'g'), '\\s+', ' ', 'g'))"
CLIPS = "c AS (SELECT DISTINCT clip_id, transcript FROM clip_records WHERE transcript IS NOT NULL)"


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct clips with a transcript."""
    return table(spark, folder, "clip_records", "clip_id", "transcript").where("transcript is not null").distinct()


@query(f"WITH {CLIPS} SELECT clip_id, {LOWER.format(x='transcript')} AS lowered FROM c")
def turkish_lower(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts in Turkish lower case."""
    return transcripts(spark, folder).select("clip_id", text.turkish_lower(F.col("transcript")).alias("lowered"))


@query(f"WITH {CLIPS} SELECT clip_id, {COMPARABLE.format(x='transcript')} AS form FROM c")
def comparison_form(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts in native comparison form."""
    return transcripts(spark, folder).select("clip_id", text.comparison_form(F.col("transcript")).alias("form"))


@query(f"WITH {CLIPS} SELECT clip_id, trim(regexp_replace(regexp_replace({COMPARABLE.format(x='transcript')}, '[^a-zçöüğış ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS form FROM c")
def letters_form(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts in letters only."""
    return transcripts(spark, folder).select("clip_id", text.letters_form(F.col("transcript")).alias("form"))


@query()
def scoring_form(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts in scoring form, numbers in words."""
    return transcripts(spark, folder).select("clip_id", spelling.scorable_form("transcript").alias("form"))


@query()
def model_form(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts as a speech model reads them."""
    return table(spark, folder, "evaluation_prompts", "id", "text").select("id", spelling.spoken_form("text").alias("form"))


@query()
def phonetic_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts in phonetic symbols."""
    return table(spark, folder, "evaluation_prompts", "id", "text").select("id", phonemes.phonetic_form(spelling.spoken_form("text")).alias("symbols"))


_BELOW = "list_element(['bir','iki','üç','dört','beş','altı','yedi','sekiz','dokuz'], CAST({u} AS BIGINT))"
_TEN = "list_element(['on','yirmi','otuz','kırk','elli','altmış','yetmiş','seksen','doksan'], CAST({t} AS BIGINT))"


_HUNDRED = "CASE WHEN {h} = 1 THEN 'yüz' WHEN {h} > 1 THEN list_element(['iki','üç','dört','beş','altı','yedi','sekiz','dokuz'], CAST({h} - 1 AS BIGINT)) || ' yüz' END"


def _group(x: str) -> str:
    """The SQL list of the words of a number below 1000."""
    return f"[{_HUNDRED.format(h=f'({x}) // 100')}, {_TEN.format(t=f'({x}) % 100 // 10')}, {_BELOW.format(u=f'({x}) % 10')}]"


@query(f"""SELECT o_orderkey, array_to_string(list_filter(list_concat(CASE WHEN o_orderkey // 1000000 > 0 THEN list_append({_group('o_orderkey // 1000000')}, 'milyon') ELSE [] END,
  CASE WHEN o_orderkey // 1000 % 1000 = 1 THEN ['bin'] WHEN o_orderkey // 1000 % 1000 > 0 THEN list_append({_group('o_orderkey // 1000 % 1000')}, 'bin') ELSE [] END, {_group('o_orderkey % 1000')}), lambda x: x IS NOT NULL), ' ') || CASE WHEN o_orderkey = 0 THEN 'sıfır' ELSE '' END AS words FROM orders""")
def number_words(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys in words."""
    return table(spark, folder, "orders", "o_orderkey").select("o_orderkey", spelling.number_words("o_orderkey").alias("words"))


_EDGE, _END = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"
_GAP = "([^\\p{L}\\p{N}_\\n]|[^\\p{L}\\p{N}_\\n][^\\n]{0,38}[^\\p{L}\\p{N}_\\n])"
_CATEGORIES = f"""list_sort(list_filter([
 CASE WHEN regexp_matches(transcript, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+(\\.[\\p{{L}}\\p{{N}}_-]+)*\\.\\p{{L}}{{2,}}{_END}') THEN 'email' END,
 CASE WHEN regexp_matches(transcript, '(?i)(^|[^A-Za-z0-9_])TR\\s*\\d(\\s*\\d){{23}}($|\\D)') THEN 'iban' END,
 CASE WHEN regexp_matches(transcript, '(^|\\D)(\\+?90\\s*)?\\(?0?5\\d\\d\\)?([-.\\s]*\\d){{7}}($|\\D)') THEN 'phone_number' END,
 CASE WHEN regexp_matches(transcript, '(^|\\W)@\\w{{3,30}}($|\\W)') THEN 'social_handle' END,
 CASE WHEN regexp_matches(translate(transcript, 'Iİı', 'iii'), '(?i){_EDGE}({"|".join(text.PLACE_WORDS).replace("ı", "i")}){_GAP}\\d{{1,4}}{_END}') THEN 'street_address' END,
 CASE WHEN len(list_filter(list_transform(list_filter(regexp_extract_all(transcript, '\\d+'), lambda x: length(x) = 11 AND x[1] <> '0'), lambda x: list_transform(range(1, 12), lambda i: CAST(x[CAST(i AS INT)] AS INT))),
   lambda d: (((d[1] + d[3] + d[5] + d[7] + d[9]) * 7 - (d[2] + d[4] + d[6] + d[8])) % 10 + 10) % 10 = d[10] AND (d[1] + d[2] + d[3] + d[4] + d[5] + d[6] + d[7] + d[8] + d[9] + d[10]) % 10 = d[11])) > 0 THEN 'turkish_identity_number' END,
 CASE WHEN regexp_matches(lower(transcript), '(^|\\W)(https?://|www\\.)\\S') THEN 'url' END], lambda x: x IS NOT NULL))"""


@query(f"SELECT clip_id, array_to_string({_CATEGORIES}, ',') AS categories FROM (SELECT DISTINCT clip_id, transcript FROM clip_records WHERE transcript IS NOT NULL)")
def contact_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The categories of structured personal information in each clip."""
    return transcripts(spark, folder).select("clip_id", F.array_join(text.pii_categories(F.col("transcript")), ",").alias("categories"))


@query(f"""WITH c AS (SELECT clip_id, transcript, normalized_transcript, len({_CATEGORIES}) > 0 AS hit FROM (SELECT DISTINCT clip_id, transcript, normalized_transcript FROM clip_records))
 SELECT clip_id, CASE WHEN hit IS NULL OR NOT hit THEN transcript END AS transcript, CASE WHEN hit IS NULL OR NOT hit THEN normalized_transcript END AS normalized_transcript,
  CASE WHEN hit THEN ['pii_detected'] ELSE CAST([] AS VARCHAR[]) END AS reasons FROM c""")
def structured_pii(spark: SparkSession, folder: str) -> DataFrame:
    """All categories of structured personal information; both texts of such clips are nulled."""
    clips = table(spark, folder, "clip_records", "clip_id", "transcript", "normalized_transcript").distinct()
    found = clips.withColumn("categories", text.pii_categories(F.col("transcript")))
    hit = F.size("categories") > 0
    return found.select("clip_id", F.when(~hit, F.col("transcript")).alias("transcript"), F.when(~hit, F.col("normalized_transcript")).alias("normalized_transcript"), F.when(hit, F.array(F.lit("pii_detected"))).otherwise(F.array().cast("array<string>")).alias("reasons"))


@query("""WITH n AS (SELECT CAST(10000000000 + (event_id * 7919 % 89999999999) AS VARCHAR) AS x, event_id FROM events),
 d AS (SELECT event_id, x, list_transform(range(1, 12), lambda i: CAST(substr(x, CAST(i AS INT), 1) AS INT)) AS d FROM n)
 SELECT event_id, x AS number, (((d[1] + d[3] + d[5] + d[7] + d[9]) * 7 - (d[2] + d[4] + d[6] + d[8])) % 10 + 10) % 10 = d[10] AND (d[1] + d[2] + d[3] + d[4] + d[5] + d[6] + d[7] + d[8] + d[9] + d[10]) % 10 = d[11] AS valid FROM d""")
def national_id_checksum(spark: SparkSession, folder: str) -> DataFrame:
    """Check digits of numbers made of event ids."""
    n = table(spark, folder, "events", "event_id").withColumn("number", (F.lit(10_000_000_000) + F.col("event_id") * 7919 % 89_999_999_999).cast("string"))
    return n.select("event_id", "number", text.national_id_valid(F.col("number")).alias("valid"))


@query("""SELECT p.id, CASE WHEN strpos(p.text, '?') > 0 THEN 'question' WHEN regexp_matches(replace(lower(translate(p.text, 'Iİ', 'ıi')), chr(775), ''), 'üzgün|özür|maalesef|anlıyorum|merak etmeyin') THEN 'empathy' END AS style FROM evaluation_prompts p""")
def style_router(spark: SparkSession, folder: str) -> DataFrame:
    """The style of each prompt."""
    return table(spark, folder, "evaluation_prompts", "id", "text").select("id", text.chat_style(F.col("text")).alias("style"))


def distance_sql(a: str, b: str) -> str:
    """The SQL of the edit distance of two comparison forms: one byte a letter, as the function counts bytes."""
    plain = "translate({x}, 'çöüğış', 'COUGIS')"
    return f"levenshtein({plain.format(x=a)}, {plain.format(x=b)})"


_CODED = "array_to_string(list_transform({x}, lambda w: chr(CAST(list_position(u, w) + 32 AS INT))), '')"


@query(f"""WITH {CLIPS}, p AS (SELECT c.clip_id, {COMPARABLE.format(x='c.transcript')} AS a, {COMPARABLE.format(x='r.text')} AS b FROM c JOIN (SELECT DISTINCT clip_id, text FROM asr_results WHERE text IS NOT NULL) r USING (clip_id)),
 w AS (SELECT *, list_filter(string_split(a, ' '), lambda w: w <> '') AS x, list_filter(string_split(b, ' '), lambda w: w <> '') AS y FROM p), u AS (SELECT *, list_distinct(list_concat(x, y)) AS u FROM w)
 SELECT clip_id, round(CASE WHEN length(a) = 0 THEN 1.0 ELSE {distance_sql('a', 'b')} / length(a) END, 6) AS cer,
  round(CASE WHEN len(x) = 0 THEN 1.0 ELSE levenshtein({_CODED.format(x='x')}, {_CODED.format(x='y')}) / len(x) END, 6) AS wer FROM u""")
def cer_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Character and word error rates of transcripts against recognised texts."""
    asr = table(spark, folder, "asr_results", "clip_id", "text").where("text is not null").distinct()
    j = transcripts(spark, folder).join(asr, "clip_id").select("clip_id", text.comparison_form(F.col("transcript")).alias("a"), text.comparison_form(F.col("text")).alias("b"))
    return j.select("clip_id", F.round(text.character_error_rate(F.col("a"), F.col("b")), 6).alias("cer"), F.round(text.word_error_rate(F.col("a"), F.col("b")), 6).alias("wer"))


@query()
def clause_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts, as a speech model reads them, in chunks of at most 90 characters."""
    read = table(spark, folder, "evaluation_prompts", "id", "text").select("id", spelling.spoken_form("text").alias("text"))
    return read.select("id", F.posexplode(text.clause_chunks(F.col("text"), 90)).alias("place", "chunk"))


@query()
def word_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of a transcript with the recognised word it is aligned to."""
    asr = table(spark, folder, "asr_results", "clip_id", "text").where("text is not null").distinct()
    return alignment.aligned_words(transcripts(spark, folder).join(asr, "clip_id"), "clip_id", "transcript", "text")


@query("SELECT DISTINCT 'cv-' || substr(sha256('v1:' || client_id), 1, 20) AS speaker, trim(sentence) AS sentence FROM cv_validated WHERE client_id IS NOT NULL")
def anonymised_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with anonymous speakers."""
    return table(spark, folder, "cv_validated", "client_id", "sentence").where("client_id is not null").select(text.anonymous_id("cv-", "v1", F.col("client_id")).alias("speaker"), F.trim("sentence").alias("sentence")).distinct()


@query("""SELECT DISTINCT clip_id, regexp_extract(audio_path, '([^/]*)$', 1) AS file, CASE WHEN lower(replace(trim(language), '_', '-')) IN ('tr', 'tr-tr', 'tur') THEN 'tr' ELSE language END AS language,
 coalesce(nullif(regexp_replace(regexp_replace(source_dataset, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'sample') AS source, metadata.quality_score AS quality FROM clip_records""")
def public_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The public columns of a clip, without its local path and speaker."""
    clips = table(spark, folder, "clip_records", "clip_id", "audio_path", "language", "source_dataset", "metadata")
    return clips.select("clip_id", F.element_at(F.split("audio_path", "/"), -1).alias("file"), text.language_code(F.col("language")).alias("language"), text.safe_name(F.col("source_dataset")).alias("source"), F.col("metadata.quality_score").alias("quality")).distinct()


@query("SELECT event_id, round(CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0 ELSE greatest(0, least(1, exp(-value / 100))) END, 6) AS p FROM events")
def probability(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities as probabilities."""
    return table(spark, folder, "events", "event_id", "value").select("event_id", F.round(text.probability(-F.col("value") / 100), 6).alias("p"))


@query(f"SELECT clip_id, CASE WHEN q >= 0.5 THEN {COMPARABLE.format(x='transcript')} END AS form FROM (SELECT DISTINCT clip_id, transcript, metadata.quality_score AS q FROM clip_records)")
def reject_first(spark: SparkSession, folder: str) -> DataFrame:
    """A costly step for eligible rows only: the others pass unchanged."""
    rows = table(spark, folder, "clip_records", "clip_id", "transcript", "metadata.quality_score").distinct()
    return gates.with_eligible(rows, F.col("quality_score") >= 0.5, lambda d: d.withColumn("form", text.comparison_form(F.col("transcript")))).select("clip_id", "form")
