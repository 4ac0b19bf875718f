"""Joins with contracts, selection and listening tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import joins, select
from corpusloom.plans import datasets
from corpusloom.queries.registry import query
from corpusloom.queries.text import COMPARABLE
from corpusloom.sources.tables import table


@query(f"""WITH t AS (SELECT DISTINCT {COMPARABLE.format(x="coalesce(nullif(trim(normalized_transcript), ''), nullif(trim(transcript), ''))")} AS k FROM clip_records)
 SELECT id FROM evaluation_prompts WHERE {COMPARABLE.format(x="text")} IN (SELECT k FROM t WHERE k <> '')""")
def contamination_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts whose text, in comparison form, is that of a clip."""
    training = table(spark, folder, "clip_records", "normalized_transcript", "transcript")
    return datasets.contaminated(table(spark, folder, "evaluation_prompts", "id", "text"), training).select("id")


@query("""WITH a AS (SELECT o_orderkey AS k, count(*) AS a FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS b FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
 SELECT count_if(b IS NULL) AS left_only, count_if(a IS NULL) AS right_only, count_if(a IS NOT NULL AND b IS NOT NULL) AS "both", count_if(coalesce(a, 0) > 1 OR coalesce(b, 0) > 1) AS repeated FROM a FULL JOIN b USING (k)""")
def strict_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    """Whether orders and their first items pair one to one."""
    a = table(spark, folder, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "k")
    b = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    return joins.strict_pairs(a, b, "k")


@query("""WITH r AS (SELECT event_type AS run, user_id % 50 AS k, min(event_id % 7) AS place FROM events GROUP BY 1, 2), n AS (SELECT count(DISTINCT run) AS n FROM r)
 SELECT k, count(DISTINCT run) AS runs, count(DISTINCT place) AS places FROM r, n GROUP BY k, n HAVING count(DISTINCT run) <> n OR count(DISTINCT place) <> 1""")
def aligned_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that not every run lists at the same place."""
    r = table(spark, folder, "events", "event_type", "user_id", "event_id").groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 50).alias("k")).agg(F.min(F.col("event_id") % 7).alias("place"))
    return joins.aligned_runs(r, "run", "k", "place")


@query("SELECT c_mktsegment, count(*) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS excluded FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def lookup_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by segment, with the number that have no customer."""
    o, c = table(spark, folder, "orders", "o_custkey"), table(spark, folder, "customer", "c_custkey", "c_mktsegment")
    marked = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    per = marked.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"))
    lost = per.agg(F.coalesce(F.sum(F.when(F.col("c_mktsegment").isNull(), F.col("n_orders"))), F.lit(0)).alias("excluded"))
    return per.where("c_mktsegment is not null").crossJoin(F.broadcast(lost))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def inconsistent_map(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with more than one supplier."""
    return joins.consistent_map(table(spark, folder, "lineitem", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("""WITH t AS (SELECT vec_id, embedding FROM embeddings WHERE label < 5), v AS (SELECT vec_id, list_reverse(embedding) AS embedding FROM embeddings WHERE label % 2 = 0)
 SELECT e.vec_id, round(CAST(coalesce(v.embedding, t.embedding)[1] AS DOUBLE), 6) AS first_value, v.vec_id IS NOT NULL AS overridden FROM embeddings e LEFT JOIN t USING (vec_id) LEFT JOIN v USING (vec_id) WHERE coalesce(v.vec_id, t.vec_id) IS NOT NULL""")
def feature_override(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors looked up in two maps, the second of which overrides the first."""
    e = table(spark, folder, "embeddings")
    t = e.where("label < 5").select("vec_id", F.col("embedding").alias("first_map"))
    v = e.where("label % 2 = 0").select("vec_id", F.reverse("embedding").alias("second_map"))
    rows = e.select("vec_id").join(t, "vec_id", "left").join(v, "vec_id", "left")
    found = F.coalesce("second_map", "first_map")
    return rows.where(found.isNotNull()).select("vec_id", F.round(F.get(found, F.lit(0)).cast("double"), 6).alias("first_value"), F.col("second_map").isNotNull().alias("overridden"))


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS run, value - 0.5 * (event_id % 10) AS score FROM events WHERE value IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS k FROM s) SELECT user_id, event_id, round(score, 6) AS score FROM r WHERE k = 1""")
def best_of_n(spark: SparkSession, folder: str) -> DataFrame:
    """The event with the best score of each user, the earliest in a tie."""
    e = table(spark, folder, "events", "user_id", "event_id", "value").where("value is not null")
    best = select.best_of(e, "user_id", F.col("value") - 0.5 * (F.col("event_id") % 10), "event_id")
    return best.select("user_id", "event_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT user_id, max(value - 0.5 * (event_id % 10)) AS score FROM events WHERE value IS NOT NULL GROUP BY 1)
 SELECT count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.9), 4) AS p90, round(quantile_cont(score, 0.1), 4) AS p10 FROM s""")
def selection_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and percentiles of the best scores."""
    e = table(spark, folder, "events", "user_id", "event_id", "value").where("value is not null")
    s = e.groupBy("user_id").agg(F.max(F.col("value") - 0.5 * (F.col("event_id") % 10)).alias("score"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.percentile("score", 0.9), 4).alias("p90"), F.round(F.percentile("score", 0.1), 4).alias("p10"))


@query("""SELECT p_brand, rank, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey) AS rank FROM part) WHERE rank <= 3""")
def topk_per_category(spark: SparkSession, folder: str) -> DataFrame:
    """The three dearest parts of each brand."""
    p = table(spark, folder, "part", "p_brand", "p_partkey", "p_retailprice", "p_size")
    return select.top_k(p, "p_brand", [F.col("p_retailprice").desc(), F.col("p_size"), F.col("p_partkey")], 3).select("p_brand", F.col("rank").cast("long").alias("rank"), "p_partkey")


@query("""WITH c AS (SELECT DISTINCT speaker_id, clip_id FROM clip_records WHERE speaker_id IS NOT NULL) SELECT speaker_id, clip_id FROM
 (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY clip_id) AS k, count(*) OVER (PARTITION BY speaker_id) AS n FROM c) WHERE k <= 3 AND n >= 2""")
def top3_per_speaker(spark: SparkSession, folder: str) -> DataFrame:
    """The first three clips of speakers with at least two: no group is held whole, only its three least ids."""
    c = table(spark, folder, "clip_records", "speaker_id", "clip_id").where("speaker_id is not null").distinct()
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("speaker_id").orderBy("clip_id"))).where("rank <= 3")
    per = ranked.groupBy("speaker_id").agg(F.collect_list("clip_id").alias("ids")).where("size(ids) >= 2")
    return per.select("speaker_id", F.explode("ids").alias("clip_id"))


@query("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 20),
 b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) QUALIFY rank <= 20),
 c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a UNION ALL SELECT o_orderkey FROM b) QUALIFY rank <= 20)
 SELECT 'dear' AS list, rank, o_orderkey FROM a UNION ALL SELECT 'late', rank, o_orderkey FROM b UNION ALL SELECT 'cheap', rank, o_orderkey FROM c""")
def worst_k_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Three lists of twenty orders, each without those of the lists before."""
    o = table(spark, folder, "orders", "o_orderkey", "o_totalprice", "o_orderdate")
    key = F.col("o_orderkey")
    lists = [("dear", [F.col("o_totalprice").desc(), key]), ("late", [F.col("o_orderdate").desc(), key]), ("cheap", [F.col("o_totalprice"), key])]
    return select.worst_chain(o, "o_orderkey", lists, 20).select("list", F.col("rank").cast("long").alias("rank"), "o_orderkey")


@query("SELECT o_orderpriority, count(*) AS n, round(min(l_discount), 6) AS least, round(max(l_discount), 6) AS most FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def candidate_spread(spark: SparkSession, folder: str) -> DataFrame:
    """The spread of discounts by priority."""
    j = table(spark, folder, "orders", "o_orderkey", "o_orderpriority").join(table(spark, folder, "lineitem", "l_orderkey", "l_discount"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("l_discount"), 6).alias("least"), F.round(F.max("l_discount"), 6).alias("most"))


def rated(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings, key and categories of thirty trials, made of events: users as listeners."""
    last = e.groupBy(F.concat(F.lit("u"), "user_id").alias("listener"), (F.col("event_id") % 30 + 1).cast("int").alias("trial")).agg(F.max("event_id").alias("event_id"))
    ratings = last.select("listener", "trial", (F.col("event_id") % 7 - 3).cast("int").alias("cmos"), F.when(F.col("event_id") % 3 == 0, "E").otherwise("H").alias("same_person"))
    trials = e.sparkSession.range(1, 31).select(F.col("id").cast("int").alias("trial"))
    kind = F.when(F.col("trial") % 10 == 0, "catch").when(F.col("trial") % 2 == 0, "ab").otherwise("anchored")
    key = trials.select("trial", kind.alias("type")).withColumn("B", F.when(F.col("trial") % 3 == 0, "plain").when(F.col("type") == "ab", "gated").otherwise("synth"))
    return ratings, key, trials.select("trial", F.concat(F.lit("c"), F.col("trial") % 4).alias("category"))


RATED = """WITH e AS (SELECT 'u' || user_id AS listener, CAST(event_id % 30 + 1 AS INT) AS trial, max(event_id) AS event_id FROM events GROUP BY 1, 2),
 t AS (SELECT *, CASE WHEN trial % 10 = 0 THEN 'catch' WHEN trial % 2 = 0 THEN 'ab' ELSE 'anchored' END AS pool, event_id % 7 - 3 AS cmos FROM e),
 bad AS (SELECT listener FROM t WHERE pool = 'catch' AND cmos <> 0 GROUP BY 1 HAVING count(*) > 1),
 r AS (SELECT listener, trial, pool, 'c' || (trial % 4) AS category, CASE WHEN trial % 3 = 0 THEN -cmos ELSE cmos END AS score, event_id % 3 = 0 AS same FROM t WHERE pool <> 'catch' AND listener NOT IN (SELECT listener FROM bad)),
 rep AS (SELECT 'all' AS level, '*' AS name, round(avg(score), 6) AS mean, round(CASE WHEN count(*) > 1 THEN 1.96 * sqrt(var_samp(score) / count(*)) END, 6) AS half_interval, count(*) AS n FROM r
 UNION ALL SELECT 'pool', pool, round(avg(score), 6), round(CASE WHEN count(*) > 1 THEN 1.96 * sqrt(var_samp(score) / count(*)) END, 6), count(*) FROM r GROUP BY pool
 UNION ALL SELECT 'category', category, round(avg(score), 6), round(CASE WHEN count(*) > 1 THEN 1.96 * sqrt(var_samp(score) / count(*)) END, 6), count(*) FROM r GROUP BY category
 UNION ALL SELECT 'same_person', 'anchored', round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6), NULL, count(*) FROM r WHERE pool = 'anchored')"""
