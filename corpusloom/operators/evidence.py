"""Gates on measured evidence, evidence in metadata, and contracts that a data set must meet before it is used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.gates import accepted, merged, reasons, require

SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class SignalLimits:
    """What a clip must meet; values at a limit pass."""

    least_seconds: float = 1.0
    most_seconds: float = 20.0
    least_level_db: float = -45.0
    most_clipping: float = 0.01
    least_active: float = 0.25
    least_snr_db: float = 6.0
    mono: bool = True


def signal_gate(seconds: Column, channels: Column, level_db: Column, clipping: Column, active: Column, snr_db: Column, limits: SignalLimits = SignalLimits()) -> Column:
    """The codes of a signal, in a fixed order. An unknown measure fails nothing."""
    return reasons(
        (seconds < limits.least_seconds, "duration_too_short"),
        (seconds > limits.most_seconds, "duration_too_long"),
        ((channels != 1) & F.lit(limits.mono), "not_mono"),
        (level_db < limits.least_level_db, "level_too_low"),
        (clipping > limits.most_clipping, "excessive_clipping"),
        (active < limits.least_active, "insufficient_active_audio"),
        (snr_db < limits.least_snr_db, "low_estimated_snr"),
    )


def audited(codes: Column, error: Column) -> Column:
    """The codes of an audit: of the signal, or that it could not be read."""
    return F.when(error.isNotNull(), F.array(F.lit("audio_decode_failed"))).otherwise(codes)


@dataclass(frozen=True)
class LabelLimits:
    """Thresholds of the gate on two recognisers and an alignment."""

    least_confidence: float
    most_disagreement: float
    least_rate: float
    most_rate: float
    least_probability: float
    most_leading: float
    most_trailing: float


def agreement_gate(first: Column, second: Column, confidence: Column, seconds: Column, probability: Column, leading: Column, trailing: Column, limits: LabelLimits | dict[str, Column]) -> Column:
    """The codes of a pseudo-label: first and second are comparison forms. Without an alignment (a null probability) one
    code stands for its three checks. limits: numbers, or columns of a one-row table of thresholds."""
    at = (lambda n: F.lit(getattr(limits, n))) if isinstance(limits, LabelLimits) else limits.__getitem__
    distance = F.when(F.length(first) == 0, F.when(F.length(second) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(first, second) / F.length(first))
    known = F.when(seconds.isNull() | F.isnan(seconds) | (seconds == 0), 1.0).otherwise(seconds)
    rate = F.length(F.replace(first, F.lit(" "), F.lit(""))) / known
    aligned = probability.isNotNull()
    return reasons(
        (second == "", "ctc_empty"),
        (confidence < at("least_confidence"), "ctc_low_confidence"),
        (distance > at("most_disagreement"), "dual_asr_disagreement"),
        ((rate < at("least_rate")) | (rate > at("most_rate")), "implausible_transcript_rate"),
        (~aligned, "forced_alignment_failed"),
        (aligned & (probability < at("least_probability")), "low_alignment_probability"),
        (aligned & (leading > at("most_leading")), "speech_before_transcript"),
        (aligned & (trailing > at("most_trailing")), "speech_after_transcript"),
    )


def label_gate(text: Column, failed: Column) -> Column:
    """The codes of a first transcript: whisper_failed where the model failed, whisper_empty where nothing is left of it."""
    return reasons((failed, "whisper_failed"), (~failed & (F.coalesce(F.trim(text), F.lit("")) == ""), "whisper_empty"))


def with_evidence(df: DataFrame, codes: Column, stage: str, version: str, reasons_col: str = "reasons", metadata: str = "metadata", overwrite: bool = False, **fields: Column) -> DataFrame:
    """df whose metadata struct has further fields, the stage and its version, and whose reasons are the sorted union with
    the codes, or the codes alone with overwrite."""
    now = F.array_sort(F.array_distinct(codes)) if overwrite else merged(F.col(reasons_col), codes)
    own = F.col(metadata)
    for name, value in {**fields, "quality_stage": F.lit(stage), "quality_version": F.lit(version)}.items():
        own = own.withField(name, value)
    return df.withColumns({reasons_col: now, metadata: own})


def redacted(df: DataFrame, hit: Column, texts: list[str], metadata: str = "metadata", inner: dict[str, list[str]] | None = None) -> DataFrame:
    """df whose texts are null and whose metadata lacks the named inner fields where hit; inner: struct -> fields."""
    out = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    for struct, names in (inner or {}).items():
        part = F.col(f"{metadata}.{struct}")
        for name in names:
            kind = out.select(part[name]).schema[0].dataType
            part = part.withField(name, F.when(~F.col("__hit"), F.col(f"{metadata}.{struct}.{name}")).otherwise(F.lit(None).cast(kind)))
        out = out.withColumn(metadata, F.col(metadata).withField(struct, F.when(F.col(f"{metadata}.{struct}").isNotNull(), part)))
    return out.withColumns({t: F.when(~F.col("__hit"), F.col(t)) for t in texts}).drop("__hit")


def number_in(metadata: Column, default: float | None = None) -> Column:
    """A number that may be missing or no number; without a default, what is no number fails."""
    return metadata.cast("double") if default is None else F.coalesce(F.try_to_number(metadata.cast("string"), F.lit("S999999999.999999")).cast("double"), metadata.try_cast("double"), F.lit(default))


def active_seconds(seconds: Column, active: Column) -> Column:
    """Seconds of speech: the duration times its active share, which is 1 where unknown."""
    return seconds * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(active, F.lit(1.0))))


def usable_records(df: DataFrame, source: str, evidence: list[Column], reasons_col: str = "reasons") -> DataFrame:
    """df, which fails on reading a record that is not of the source, not allowed, without licence, rejected, without a
    text, or without a piece of the evidence."""
    fine = (F.col("source_dataset") == source) & (F.col("rights_state") == "allowed") & (F.coalesce(F.col("license_id"), F.lit("")) != "") & accepted(F.col(reasons_col)) & (F.coalesce(F.trim("transcript"), F.lit("")) != "")
    for piece in evidence:
        fine = fine & piece
    return require(df, fine, f"a record of {source} lacks rights, a text or evidence")


def unusable_counts(df: DataFrame, reasons: Column) -> DataFrame:
    """(check, n_rows): how many records fail each check of a contract; must be empty."""
    return df.select(F.explode(reasons).alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("n_rows"))


def contract_reasons(text: Column, rights: Column, license_id: Column, seconds: Column, path: Column) -> Column:
    """What a training record lacks, in order."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return reasons(
        (~F.coalesce(rights == "allowed", F.lit(False)), "no_training_rights"), (empty(license_id), "no_licence"), (empty(text), "no_text"),
        (F.coalesce(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), F.lit(True)), "no_duration"), (empty(path), "no_audio"),
    )


def trainable(df: DataFrame, most_seconds: float, most_characters: int, most_reference: float) -> DataFrame:
    """Rows a trainer can use: a text, a known length, and together with the reference within the limits. Fails where
    only some of the reference's fields are given, or where they are not positive.

    text and reference_text may be strings or lists of characters."""
    joined = lambda c: F.array_join(c, "") if df.schema[c].dataType.typeName() == "array" else F.col(c)
    rows = df.withColumns({"text": joined("text"), "reference_text": joined("reference_text")})
    given = [F.col(c).isNotNull() for c in ("reference_audio_path", "reference_text", "reference_duration")]
    none = ~given[0] & ~given[1] & (F.coalesce("reference_duration", F.lit(0.0)) == 0)
    whole = given[0] & given[1] & given[2] & (F.col("reference_text") != "") & (F.col("reference_duration") > 0)
    second, extra = F.coalesce("reference_duration", F.lit(0.0)), F.coalesce(F.length("reference_text") + 1, F.lit(0))
    fits = (F.col("text") != "") & (F.col("duration") > 0) & (F.col("duration") <= most_seconds)
    checked = require(rows.where(fits), none | whole, "reference fields must be given together and be positive")
    return checked.where((second <= most_reference) & (F.col("duration") + second <= most_seconds) & (F.length("text") + extra <= most_characters))


def split_faults(df: DataFrame, keys: dict[str, Column], split: str = "source_split", row_id: str = "clip_id") -> DataFrame:
    """(fault, value) of a data set's splits; must be empty: splits without rows, ids in several splits, and values of each
    key, such as speakers of one source or parents, in several splits. Nulls of a key are ignored."""
    spark = df.sparkSession
    want = spark.createDataFrame([(s,) for s in SPLITS], "value string")
    faults = want.join(df.select(F.col(split).alias("value")).distinct(), "value", "left_anti").select(F.lit("empty").alias("fault"), "value")
    for name, key in {"id": F.col(row_id), **keys}.items():
        crossing = df.select(key.cast("string").alias("value"), F.col(split).alias("s")).where("value is not null and s is not null").groupBy("value").agg(F.countDistinct("s").alias("n")).where("n > 1")
        faults = faults.unionByName(crossing.select(F.lit(name).alias("fault"), "value"))
    return faults


def stamped(df: DataFrame, version: str, split: str = "source_split") -> DataFrame:
    """df with the split of training and where it came from, in columns of their own."""
    return df.withColumns({"original_source_split": F.col(split), "training_split": F.col(split), "training_corpus_version": F.lit(version)})


def decorated(df: DataFrame, **constants: str) -> DataFrame:
    """df with constant columns: licence, terms, attribution."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """df with each named column rounded to its own number of places."""
    return df.withColumns({name: F.round(name, n) for name, n in places.items()})


def by_path(df: DataFrame, path: str, token: str) -> DataFrame:
    """Rows whose path contains a token; fails where there are none."""
    some = df.where(F.contains(F.col(path), F.lit(token)))
    if some.isEmpty():
        raise ValueError(f"no {path} contains {token}")
    return some


def finite_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows that have a vector; fails on one that is not finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return require(df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)), fine, f"{vector} is not finite")


def speakable(text: Column, alphabet: Column, most: int) -> Column:
    """struct(text, error): the text without characters that the alphabet, an array, lacks; error for unprintable
    characters, and for texts that are empty then or longer than `most`."""
    kept = F.array_join(F.filter(F.split(text, ""), lambda c: F.array_contains(alphabet, c)), "")
    error = F.when(text.isNull() | text.rlike(r"[\p{Cc}&&[^\n\t\r]]"), "unprintable").when(F.trim(kept) == "", "empty").when(F.length(kept) > most, "too_long")
    return F.struct(kept.alias("text"), error.alias("error"))
