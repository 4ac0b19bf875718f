"""Problem 6: records that recur, exactly or almost, across the train, validation and test splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let
from corpusloom.functions.identity import canonical_digest, canonical_id, canonical_split
from corpusloom.llm.minhash import BANDS, ROWS, SHINGLE, buckets, may_be_near
from corpusloom.plans.joins import hot_keys, salted_join
from corpusloom.session import cut

LEAST_CHARS = 30
MOST_EDITS = 0.1


def compared_text(text: Column) -> Column:
    """Lower case by Turkish rules, without punctuation, single spaces."""
    lower = F.replace(F.lower(F.translate(text, "Iİ", "ıi")), F.lit("̇"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(lower, r"\p{P}", ""), r"[\p{Z}\s]+", " "))


@dataclass(frozen=True)
class Overlap:
    """links: pairs (a, b) of text keys, a of a validation or test text, b of a train text, that are near or equal.
    held, train: the records of either side, with text_key and digest. pairs: pairs (id_a, id_b) of records, smaller id
    first, with the held-out one, its split and the two sources."""

    links: DataFrame
    held: DataFrame
    train: DataFrame
    pairs: DataFrame


def cross_split_overlap(
    records: DataFrame,
    id_col: str = "clip_id",
    split_col: str = "source_split",
    source_col: str = "source_dataset",
    digest_col: str = "sha256",
    text_col: str = "normalized_transcript",
    least_chars: int = LEAST_CHARS,
    most_edits: float = MOST_EDITS,
    least_jaccard: float | None = None,
    bands: int = BANDS,
    rows: int = ROWS,
    shingle: int = SHINGLE,
) -> Overlap:
    """All pairs of one train and one validation or test record with one digest or near texts.

    Method: each distinct text gets minwise hashes of its character shingles, which are told apart by the stretch of the
    text that they lie in, banded into buckets; only buckets that meet across the splits give candidates. Candidates
    whose profiles of length and characters rule them out are dropped in the join itself. The rest are verified exactly
    by the Jaccard similarity of their shingle sets: at least what most_edits leaves of it, after which the edit distance
    decides; or, where least_jaccard is given, at least that. Texts are compared once however many records have them;
    verified links are then spelled out to records. With the shingles of two characters and 28 bands of 4 rows, pairs at
    exactly 10 % of edits are candidates with a probability of 0.99 or more from 30 to 150 characters, whether the edits
    are evenly spread, at random places or mixed with insertions and deletions (tests/llm measures it); there is no exact
    path for the rest, as pieces that survive 10 % of edits are only eight characters long and every fortieth pair
    of texts shares one. A hot bucket is split by adaptive execution.

    Defined cases: repeated rows count once. Splits are read in any spelling; other and null ones take part nowhere.
    Null, empty and stand-in digests match nothing; null texts and those under least_chars in compared form match
    nothing. Equal long texts match. Rows without an id are ignored. An empty table gives no pairs. Other columns are
    not read. Texts are keyed by 128 bits.
    """
    base = records.select(
        F.col(id_col).alias("id"), canonical_split(F.col(split_col)).alias("split"), canonical_id(F.col(source_col)).alias("source"),
        canonical_digest(F.col(digest_col)).alias("digest"), compared_text(F.col(text_col)).alias("text"),
    ).where("id is not null and split is not null").withColumn("text", F.when(F.length("text") >= least_chars, F.col("text"))).distinct()
    base = cut(base.withColumn("text_key", F.unhex(F.md5("text"))).withColumn("side", F.when(F.col("split") == "train", 1).otherwise(2)))
    texts = base.where("text is not null").groupBy("text_key").agg(F.first("text").alias("text"), F.bit_or("side").cast("int").alias("side"))
    texts = cut(texts.withColumn("key", F.monotonically_increasing_id()))  # written before it is used, so the keys are fixed
    reach = most_edits if least_jaccard is None else 1 - least_jaccard
    hashed = lambda side, reach: buckets(texts.where(F.col("side").bitwiseAND(F.lit(side)) > 0), reach, shingle, bands, rows)
    a = hashed(2, reach).select("bucket", F.col("key").alias("a"), F.col("p0").alias("a0"), F.col("p1").alias("a1"))
    b = hashed(1, 0.0).select("bucket", F.col("key").alias("b"), F.col("p0").alias("b0"), F.col("p1").alias("b1"))
    likely = F.lit(True) if least_jaccard is not None else may_be_near((F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1")), most_edits)
    near = a.join(b, "bucket").where((F.col("a") != F.col("b")) & likely).select("a", "b").distinct()
    side = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}"), F.col("text_key").alias(f"key_{x}"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    gram = lambda c: F.expr(f"array_distinct(transform(sequence(1, greatest(1, length({c}) - {shingle} + 1)), i -> substr({c}, i, {shingle})))")
    met = let(F.struct(gram("text_a").alias("a"), gram("text_b").alias("b")), lambda g: F.struct(F.size(F.array_intersect(g["a"], g["b"])).alias("common"), F.size(g["a"]).alias("a"), F.size(g["b"]).alias("b")))
    limit = F.floor(F.greatest(F.length("text_a"), F.length("text_b")) * most_edits + 1e-9).cast("int")
    if least_jaccard is None:
        # an edit takes at most `shingle` shingles away and brings at most as many
        most, lost = lambda g: F.greatest(g["a"], g["b"]), limit * shingle
        alike = let(met, lambda g: g["common"] * (most(g) + lost) >= (g["a"] + g["b"] - g["common"]) * (most(g) - lost))
        close = both.where(alike).withColumn("limit", limit).where(F.expr("levenshtein(text_a, text_b, limit) >= 0"))
    else:
        close = both.where(let(met, lambda g: g["common"] >= least_jaccard * (g["a"] + g["b"] - g["common"])))
    same = texts.where("side = 3").select(F.col("text_key").alias("a"), F.col("text_key").alias("b"))
    links = cut(close.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).unionByName(same))
    held = base.where("side = 2").select(F.col("id").alias("held_id"), F.col("split").alias("held_split"), F.col("source").alias("held_source"), "text_key", "digest")
    train = base.where("side = 1").select(F.col("id").alias("train_id"), F.col("source").alias("train_source"), "text_key", "digest")
    names = ["held_id", "held_split", "held_source", "train_id", "train_source"]
    held_t = held.where("text_key is not null").select(F.col("text_key").alias("a"), "held_id", "held_split", "held_source")
    hot_a = hot_keys(held_t.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", "n")
    held_l = salted_join(held_t, links, "a", hot_a, F.xxhash64("held_id"))
    hot_b = hot_keys(held_l.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b", "n")
    train_t = train.where("text_key is not null").select(F.col("text_key").alias("b"), "train_id", "train_source")
    by_text = salted_join(held_l, train_t, "b", hot_b, F.xxhash64("held_id")).select(*names)
    d_held = held.where("digest is not null").select("digest", "held_id", "held_split", "held_source")
    d_train = train.where("digest is not null").select("digest", "train_id", "train_source")
    hot_d = hot_keys(d_held.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest", "n")
    by_digest = salted_join(d_held, d_train, "digest", hot_d, F.xxhash64("held_id")).select(*names)
    pairs = by_text.unionByName(by_digest).where("held_id <> train_id").distinct()
    return Overlap(links, held, train, pairs.withColumns({"id_a": F.least("held_id", "train_id"), "id_b": F.greatest("held_id", "train_id")}))


def overlap_report(found: Overlap) -> DataFrame:
    """Overlapping pairs, held-out records and train records by split and source of the held-out record.

    Computed from counts per text, digest, split and source, never from the pairs themselves: pairs by text, plus pairs
    by digest, less those by both. A record listed twice with other values counts as two.
    """
    by = ["held_split", "held_source"]
    held = found.held.groupBy("text_key", "digest", *by).agg(F.count(F.lit(1)).alias("held"))
    train = found.train.groupBy("text_key", "digest").agg(F.count(F.lit(1)).alias("train"))
    links = found.links.withColumnRenamed("a", "text_key")

    def of(df: DataFrame, key: str, size: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key, *[c for c in by if c in df.columns]).agg(F.sum(size).alias(size))

    text = of(held, "text_key", "held").join(links, "text_key").join(of(train, "text_key", "train").withColumnRenamed("text_key", "b"), "b")
    digest = of(held, "digest", "held").join(of(train, "digest", "train"), "digest")
    both = held.where("digest is not null").join(links, "text_key").join(train.where("digest is not null").withColumnRenamed("text_key", "b"), ["b", "digest"])
    pairs = None
    for part, sign in ((text, 1), (digest, 1), (both, -1)):
        one = part.groupBy(*by).agg((F.sum(F.col("held") * F.col("train")) * sign).alias("pairs"))
        pairs = one if pairs is None else pairs.unionByName(one)
    mark = lambda df, key: df.select(key).distinct()
    hit = held.join(mark(links, "text_key").withColumn("t", F.lit(True)), "text_key", "left").join(mark(train.where("digest is not null"), "digest").withColumn("d", F.lit(True)), "digest", "left")
    records = hit.where("t or d").groupBy(*by).agg(F.sum("held").alias("held_records"))
    of_text = text.select("b", *by).distinct().withColumnRenamed("b", "text_key")
    of_digest = held.where("digest is not null").select("digest", *by).distinct()
    seen = train.join(of_text, "text_key").select("text_key", "digest", *by, "train").unionByName(train.join(of_digest, "digest").select("text_key", "digest", *by, "train")).distinct()
    trained = seen.groupBy(*by).agg(F.sum("train").alias("train_records"))
    key = lambda df: df.withColumn("held_source", F.coalesce("held_source", F.lit("")))
    out = key(pairs).groupBy(*by).agg(F.sum("pairs").alias("pairs")).join(key(records), by).join(key(trained), by)
    return out.withColumn("held_source", F.nullif("held_source", F.lit(""))).select(*by, "pairs", "held_records", "train_records")
