"""Queries of the nine problems over the tables of a folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.identity import EMPTY_DIGESTS, canonical_id_sql, canonical_split_sql
from corpusloom.llm.capping import cap_contributors
from corpusloom.llm.disclosure import find_personal, sanitise
from corpusloom.llm.leakage import leaked_prompts
from corpusloom.llm.lookalikes import consistent_forms, same_looking_pairs
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.overlap import cross_split_overlap, overlap_report
from corpusloom.llm.packing import pack, packing_report
from corpusloom.llm.splitting import assign_splits, related_groups
from corpusloom.llm.stuffing import find_stuffed
from corpusloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of the speakers over 40 clips or 600 seconds."""
    capped = cap_contributors(table(spark, folder, "clip_records"))
    return capped.spellings.where("over_cap").select(F.col("spelling").alias("speaker_id")).distinct()


def p1_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The clips that are kept under these caps."""
    return cap_contributors(table(spark, folder, "clip_records")).kept


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot give their share of the total size."""
    mix = mix_sources(table(spark, folder, "clip_records"), table(spark, folder, "mixture_targets"), budget="all")
    return mix.sources.where("short").select("source_dataset")


def p2_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mix with exact shares: clips and the number of their uses."""
    return mix_sources(table(spark, folder, "clip_records"), table(spark, folder, "mixture_targets")).records


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of that mix."""
    return mix_sources(table(spark, folder, "clip_records"), table(spark, folder, "mixture_targets")).sources


def p2_tempered(spark: SparkSession, folder: str) -> DataFrame:
    """A mix as large as all clips of these sources: the exponent is bisected to the limits on repetition."""
    return mix_sources(table(spark, folder, "clip_records"), table(spark, folder, "mixture_targets"), budget="targets").records


def p2_tempered_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of that mix."""
    return mix_sources(table(spark, folder, "clip_records"), table(spark, folder, "mixture_targets"), budget="targets").sources


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Clips of groups with at least two speakers."""
    found = related_groups(table(spark, folder, "clip_records")).records
    return found.where("speakers >= 2").select(F.col("id").alias("clip_id"), "group_id").distinct()


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every clip."""
    return assign_splits(table(spark, folder, "clip_records"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    clips = table(spark, folder, "clip_records").select(F.col("clip_id").alias("id"), F.col("transcript").alias("text"))
    return clips.unionByName(table(spark, folder, "evaluation_prompts").select("id", "text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of clips and prompts that look the same but differ."""
    return same_looking_pairs(consistent_forms(_texts(spark, folder)).forms)


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every transcript and prompt."""
    return consistent_forms(_texts(spark, folder)).forms.select(F.col("key").alias("id"), "form")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of clips that recur across splits."""
    pairs = cross_split_overlap(table(spark, folder, "clip_records")).pairs
    return pairs.select(F.col("id_a").alias("clip_id_a"), F.col("id_b").alias("clip_id_b")).distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """These pairs by split and source."""
    return overlap_report(cross_split_overlap(table(spark, folder, "clip_records")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Clips and the types of personal information in their transcripts."""
    found = find_personal(table(spark, folder, "clip_records"), table(spark, folder, "given_names"), "clip_id", "transcript").found
    return found.select(F.col("id").alias("clip_id"), F.explode("spans.type").alias("pii_type")).distinct()


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every transcript with placeholders in place of personal information."""
    return sanitise(table(spark, folder, "clip_records"), table(spark, folder, "given_names"), "clip_id", "transcript")


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    return pack(table(spark, folder, "documents"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers that takes, and how full they are."""
    return packing_report(pack(table(spark, folder, "documents")))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_prompts(table(spark, folder, "documents"), table(spark, folder, "evaluation_prompts"), table(spark, folder, "given_names"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the prompts of which they hold at least half in one run."""
    found = _leaks(spark, folder).where("run_words >= 6 and 2 * run_words >= prompt_words")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "id").distinct()


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """The same with re-parameterised prompts, and the length of each run."""
    return _leaks(spark, folder)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of keywords, links or product tags."""
    return find_stuffed(table(spark, folder, "documents", "doc_id", "text", "lang")).documents.where("stuffed").select("doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of such passages in every document."""
    return find_stuffed(table(spark, folder, "documents", "doc_id", "text", "lang")).documents


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_capped, p2_found, p2_mix, p2_shares, p2_tempered, p2_tempered_shares, p3_found, p3_clean, p4_found, p4_splits, p5_found, p5_forms,
        p6_found, p6_report, p7_pack, p7_report, p8_found, p8_leaks, p9_found, p9_shares,
    )
}


MICROS_SQL = "(CASE WHEN duration_seconds IS NULL OR isnan(duration_seconds) OR duration_seconds <= 0 THEN 0 ELSE CAST(round(duration_seconds * 1e6) AS BIGINT) END)"

SQL: dict[str, str] = {
    "p1_found": f"""
        WITH c AS (SELECT DISTINCT clip_id, speaker_id, duration_seconds, {canonical_id_sql("speaker_id")} AS g, {MICROS_SQL} AS s FROM clip_records),
        over_cap AS (SELECT g FROM c WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 40 OR sum(s) > 600000000)
        SELECT DISTINCT speaker_id FROM c WHERE g IN (SELECT g FROM over_cap)""",
    "p1_capped": f"""
        WITH c AS (SELECT DISTINCT clip_id, speaker_id, duration_seconds, metadata.quality_score AS quality, {canonical_id_sql("speaker_id")} AS g, {MICROS_SQL} AS s FROM clip_records),
        r AS (SELECT *, count(*) OVER w AS n, sum(s) OVER w AS t FROM c WINDOW w AS (PARTITION BY g ORDER BY CASE WHEN isnan(quality) THEN NULL ELSE quality END DESC NULLS LAST, substr(sha256(clip_id), 1, 15), clip_id ROWS UNBOUNDED PRECEDING))
        SELECT clip_id, speaker_id, g AS contributor, duration_seconds, quality FROM r WHERE g IS NULL OR (n <= 40 AND t <= 600000000)""",
    "p2_found": f"""
        WITH c AS (SELECT DISTINCT clip_id, source_dataset, {canonical_id_sql("source_dataset")} AS g, {MICROS_SQL} AS s FROM clip_records),
        t AS (SELECT sum(s) AS total FROM c),
        per AS (SELECT g, sum(s) AS s FROM c GROUP BY g)
        SELECT m.source_dataset FROM mixture_targets m CROSS JOIN t LEFT JOIN per p ON p.g = {canonical_id_sql("m.source_dataset")}
        WHERE coalesce(p.s, 0) * m.max_repeats < m.target_share * t.total""",
    "p4_found": f"""
        WITH RECURSIVE c AS (SELECT DISTINCT clip_id, 'p' || {canonical_id_sql("speaker_id")} AS p, 's' || {canonical_id_sql("session_id")} AS e FROM clip_records),
        l AS (SELECT DISTINCT p AS a, e AS b FROM c WHERE p IS NOT NULL AND e IS NOT NULL), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT w.b, r.seen FROM reach r JOIN both_ways w ON w.a = r.node),
        root AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
        k AS (SELECT c.*, coalesce(r.root, p, e) AS root FROM c LEFT JOIN root r ON r.node = coalesce(p, e) WHERE coalesce(p, e) IS NOT NULL),
        g AS (SELECT root, min(clip_id) AS group_id FROM k GROUP BY root HAVING count(DISTINCT p) >= 2)
        SELECT DISTINCT clip_id, group_id FROM k JOIN g USING (root)""",
    "p6_found": f"""
        WITH c AS (SELECT DISTINCT clip_id, {canonical_split_sql("source_split")} AS s, regexp_extract(lower(sha256), '([0-9a-f]{{32,}})[^0-9a-z]*$', 1) AS h,
          trim(regexp_replace(regexp_replace(replace(lower(translate(normalized_transcript, 'Iİ', 'ıi')), chr(775), ''), '\\p{{P}}', '', 'g'), '[\\p{{Z}}\\s]+', ' ', 'g')) AS t FROM clip_records),
        d AS (SELECT clip_id, s, CASE WHEN h <> '' AND h NOT IN ({", ".join(repr(x) for x in EMPTY_DIGESTS)}) AND replace(h, h[1], '') <> '' THEN h END AS h,
          CASE WHEN length(t) >= 30 THEN translate(t, 'çöüğışâîû', 'COUGISAEV') END AS t FROM c WHERE s IS NOT NULL),
        texts AS (SELECT t, bool_or(s = 'train') AS train, bool_or(s <> 'train') AS held FROM d WHERE t IS NOT NULL GROUP BY t),
        near AS (SELECT a.t AS a, b.t AS b FROM texts a JOIN texts b ON a.held AND b.train AND abs(length(a.t) - length(b.t)) <= 0.1 * greatest(length(a.t), length(b.t)) WHERE a.t = b.t OR levenshtein(a.t, b.t) * 10 <= greatest(length(a.t), length(b.t))),
        pairs AS (SELECT x.clip_id AS i, y.clip_id AS j FROM near n JOIN d x ON x.t = n.a AND x.s <> 'train' JOIN d y ON y.t = n.b AND y.s = 'train'
          UNION SELECT x.clip_id, y.clip_id FROM d x JOIN d y ON x.h = y.h WHERE x.s <> 'train' AND y.s = 'train')
        SELECT DISTINCT least(i, j) AS clip_id_a, greatest(i, j) AS clip_id_b FROM pairs WHERE i <> j""",
}
