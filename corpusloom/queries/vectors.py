"""Statistics of vectors and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.operators import joins
from corpusloom.plans.joins import sent
from corpusloom.queries.registry import query
from corpusloom.sources.tables import table

FLAT = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
CENTRE = f"""{FLAT}, m AS (SELECT label, p, avg(v) AS m FROM x GROUP BY 1, 2), cen AS (SELECT label, p, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-8) AS c FROM m)"""


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """(label, centroid) of unit length, from the mean vector of each label."""
    return arrays.by_position(table(spark, folder, "embeddings"), "embedding", "label").select("label", arrays.unit(F.col("mean")).alias("centroid"))


@query(f"WITH {CENTRE} SELECT label, p - 1 AS position, round(c, 6) AS value FROM cen")
def centroid_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """The centroid of each label, position by position."""
    return centroids(spark, folder).select("label", F.posexplode("centroid").alias("position", "v")).select("label", F.col("position").cast("long").alias("position"), F.round("v", 6).alias("value"))


@query(f"""WITH {CENTRE}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT x.vec_id, x.label, sum(x.v * c.c) / greatest(sqrt(sum(x.v * x.v)), 1e-8) AS sim FROM x JOIN cen c ON c.label = x.label AND c.p = x.p GROUP BY 1, 2)
 SELECT vec_id, CASE WHEN n > 1 THEN round(sim, 6) END AS similarity, n > 1 AS assessed, coalesce(n > 1 AND round(sim, 6) < 0.35, false) AS inconsistent FROM s JOIN n USING (label)""")
def centroid_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """The cosine of each vector and its label's centroid; labels of one vector are not assessed."""
    e = table(spark, folder, "embeddings")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = e.join(sent(centroids(spark, folder).join(n, "label")), "label")
    sim = F.round(arrays.dot(F.col("embedding"), F.col("centroid")) / F.greatest(arrays.norm(F.col("embedding")), F.lit(1e-8)), 6)
    many = F.col("n") > 1
    return rows.select("vec_id", F.when(many, sim).alias("similarity"), many.alias("assessed"), F.coalesce(many & (sim < 0.35), F.lit(False)).alias("inconsistent"))


@query(f"""WITH {CENTRE}, l AS (SELECT label, coalesce(lead(label) OVER (ORDER BY label), min(label) OVER ()) AS next_label FROM (SELECT DISTINCT label FROM embeddings))
 SELECT l.label, l.next_label, round(sum(a.c * b.c), 6) AS similarity FROM l JOIN cen a ON a.label = l.label JOIN cen b ON b.label = l.next_label AND b.p = a.p GROUP BY 1, 2""")
def ring_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """The similarity of each centroid and the next one, around the ring."""
    r = joins.ring(centroids(spark, folder), "label")
    return r.select("label", "next_label", F.round(arrays.dot(F.col("centroid"), F.col("next_centroid")), 6).alias("similarity"))


@query(f"WITH {FLAT} SELECT label, p - 1 AS position, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS deviation FROM x GROUP BY 1, 2")
def vector_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and standard deviation by label and position."""
    s = arrays.by_position(table(spark, folder, "embeddings"), "embedding", "label")
    return s.select("label", F.posexplode(F.arrays_zip("mean", "deviation")).alias("position", "x")).select("label", F.col("position").cast("long").alias("position"), F.round("x.mean", 6).alias("mean"), F.round("x.deviation", 6).alias("deviation"))


@query(f"""WITH {FLAT}, f AS (SELECT p, avg(v) AS m, stddev_pop(v) AS s FROM x WHERE vec_id % 10 <> 0 GROUP BY 1)
 SELECT vec_id, round(sum(greatest(-5, least(5, (v - m) / s))), 5) AS total, round(max(greatest(-5, least(5, (v - m) / s))), 5) AS most FROM x JOIN f USING (p) GROUP BY 1""")
def train_fit_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors in standard scores of nine tenths of them."""
    e = table(spark, folder, "embeddings")
    fit = arrays.by_position(e.where("vec_id % 10 <> 0"), "embedding", sample=False)
    z = e.crossJoin(F.broadcast(fit)).select("vec_id", arrays.standardised(F.col("embedding"), F.col("mean"), F.col("deviation")).alias("z"))
    return z.select("vec_id", F.round(arrays.total(F.col("z")), 5).alias("total"), F.round(F.array_max("z"), 5).alias("most"))


@query(f"""WITH {FLAT}, q AS (SELECT vec_id, quantile_cont(v, 0.3) AS cut FROM x GROUP BY 1) SELECT label, (p - 1) // 8 AS band, count(*) AS n, round(avg(v), 6) AS mean FROM x JOIN q USING (vec_id) WHERE v >= cut GROUP BY 1, 2""")
def quantile_gated_band_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of each band without the lowest three tenths of each vector."""
    e = table(spark, folder, "embeddings").withColumn("d", F.transform("embedding", lambda v: v.cast("double")))
    cut = e.withColumn("cut", arrays.percentile_of(F.col("d"), 0.3))
    each = cut.select("label", "cut", F.posexplode("d").alias("p", "v")).where("v >= cut")
    return each.groupBy("label", F.floor(F.col("p") / 8).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query(f"""WITH {FLAT}, s AS (SELECT label, p, avg(v) AS m, stddev_samp(v) AS d FROM x GROUP BY 1, 2)
 SELECT vec_id, round(sqrt(avg(power((v - m) / greatest(0.5, d), 2))), 6) AS penalty FROM x JOIN s USING (label, p) GROUP BY 1""")
def zscore_penalty(spark: SparkSession, folder: str) -> DataFrame:
    """How far each vector is from its label, in floored deviations."""
    e = table(spark, folder, "embeddings")
    rows = e.join(sent(arrays.by_position(e, "embedding", "label")), "label")
    return rows.select("vec_id", F.round(arrays.penalty(F.col("embedding"), F.col("mean"), F.col("deviation")), 6).alias("penalty"))


@query(f"""WITH {FLAT}, fr AS (SELECT vec_id, (p - 1) // 8 AS f, sqrt(avg(v * v)) AS r FROM x GROUP BY 1, 2),
 q AS (SELECT vec_id, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM fr GROUP BY 1),
 a AS (SELECT vec_id, avg(CASE WHEN r >= greatest(power(10, -45 / 20.0), lo * 2) THEN 1.0 ELSE 0.0 END) AS active FROM fr JOIN q USING (vec_id) GROUP BY 1),
 b AS (SELECT vec_id, max(abs(v)) AS peak, 20 * log10(greatest(sqrt(avg(v * v)), 1e-12)) AS rms, avg(CASE WHEN abs(v) >= 0.995 THEN 1.0 ELSE 0.0 END) AS clip FROM x GROUP BY 1)
 SELECT vec_id, round(peak, 6) AS peak, round(rms, 4) AS rms_db, round(clip, 6) AS clipping, round(active, 6) AS active, round(20 * log10((hi + 1e-8) / (lo + 1e-8)), 4) AS snr_db FROM b JOIN a USING (vec_id) JOIN q USING (vec_id)""")
def signal_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Peak, level, clipping, activity and estimated noise distance of each vector as a signal."""
    m = table(spark, folder, "embeddings").select("vec_id", arrays.signal_metrics(F.col("embedding"), 8).alias("m"))
    return m.select("vec_id", F.round("m.peak", 6).alias("peak"), F.round("m.rms_db", 4).alias("rms_db"), F.round("m.clipping", 6).alias("clipping"), F.round("m.active", 6).alias("active"), F.round("m.snr_db", 4).alias("snr_db"))


@query(f"""WITH {FLAT}, g AS (SELECT p, avg(v) AS b FROM x GROUP BY 1), t AS (SELECT label, p, avg(v) AS t FROM x GROUP BY 1, 2)
 SELECT label, round(sum(greatest(-5, least(5, b + 1.5 * (t - b)))), 5) AS total FROM t JOIN g USING (p) GROUP BY 1""")
def preset_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Label means pushed away from the global mean."""
    e = table(spark, folder, "embeddings")
    base = arrays.by_position(e, "embedding").select(F.col("mean").alias("base"))
    t = arrays.by_position(e, "embedding", "label").select("label", "mean").crossJoin(F.broadcast(base))
    return t.select("label", F.round(arrays.total(arrays.blended(F.col("base"), F.col("mean"), 1.5)), 5).alias("total"))


@query(f"""WITH {FLAT}, d AS (SELECT a.vec_id, (a.p - 1) // 8 AS f, avg(abs(a.v - b.v)) AS move FROM x a JOIN x b ON b.vec_id = a.vec_id AND b.p = a.p + 8 GROUP BY 1, 2)
 SELECT vec_id, round(avg(CASE WHEN move < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS static_share FROM d GROUP BY 1""")
def static_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """The share of frames that hardly differ from the next."""
    return table(spark, folder, "embeddings").select("vec_id", F.round(arrays.static_share(F.col("embedding"), 8, 0.1), 6).alias("static_share"))


@query(f"""WITH {FLAT}, f AS (SELECT vec_id, (p - 1) // 8 AS f, max(v) AS m, arg_max((p - 1) % 8, v) AS best FROM x GROUP BY 1, 2)
 SELECT vec_id, round(coalesce(avg(CASE WHEN best <> 0 THEN exp(m) END), 0), 6) AS confidence FROM f GROUP BY 1""")
def ctc_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The mean probability of the best symbol over frames whose best symbol is not the blank."""
    f = arrays.frames(F.transform("embedding", lambda v: v.cast("double")), 8)
    best = F.filter(F.transform(f, lambda x: F.struct(F.array_max(x).alias("m"), F.array_position(x, F.array_max(x)).alias("at"))), lambda s: s["at"] != 1)
    mean = F.when(F.size(best) > 0, arrays.total(F.transform(best, lambda s: F.exp(s["m"]))) / F.size(best)).otherwise(0.0)
    return table(spark, folder, "embeddings").select("vec_id", F.round(mean, 6).alias("confidence"))
