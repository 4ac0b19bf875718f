"""Canonical forms of ids, splits, digests and durations, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for "not known", in canonical form (lower case, no separators, dotless i as i).
UNKNOWN_WORDS = (
    "anonim", "anonymous", "belirsiz", "bilinmeyen", "bilinmiyor", "missing", "na", "nan", "nil", "none", "null",
    "undefined", "unknown", "unspecified", "yok",
)
# Names of the three splits, in canonical form.
SPLIT_NAMES = {
    "train": ("train", "training"),
    "validation": ("validation", "valid", "val", "dev", "development"),
    "test": ("test", "testing"),
}
# Digests of no bytes (MD5, SHA-1, SHA-256).
EMPTY_DIGESTS = (
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)

ASCII = "".join(map(chr, range(0x21, 0x7F)))
FULL_WIDTH = "".join(chr(ord(c) + 0xFEE0) for c in ASCII)


def fold_width(text: Column) -> Column:
    """Full-width ASCII forms and the ideographic space as plain ones."""
    return F.translate(text, FULL_WIDTH + "　", ASCII + " ")


def squeezed(text: Column) -> Column:
    """Letters and digits only, in one case and width; every kind of i is one letter."""
    return F.regexp_replace(F.lower(F.translate(fold_width(text), "Iıİ", "iii")), r"[^\p{L}\p{N}]", "")


def canonical_id(text: Column) -> Column:
    """One form for ids that differ in case, separators, white space or width; null for what is no id."""
    key = squeezed(text)
    return F.when((key != "") & ~key.isin(*UNKNOWN_WORDS), key)


def canonical_split(text: Column) -> Column:
    """train, validation, test or null."""
    key = squeezed(text)
    out = F.lit(None).cast("string")
    for name, spellings in SPLIT_NAMES.items():
        out = F.when(key.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def canonical_digest(text: Column) -> Column:
    """The hex digest without case, prefix and padding; null for stand-ins of missing or empty audio."""
    key = F.regexp_extract(F.lower(fold_width(text)), r"([0-9a-f]{32,})[^0-9a-z]*$", 1)
    return F.when((key != "") & ~key.isin(*EMPTY_DIGESTS) & ~key.rlike(r"^(.)\1*$"), key)


def micros(seconds: Column) -> Column:
    """Whole microseconds of a duration, so that sums are exact; 0 for null, NaN, negative and infinite ones."""
    known = seconds.isNotNull() & ~F.isnan(seconds) & (seconds > 0) & (seconds < 1e12)
    return F.when(known, F.round(seconds * 1e6).cast("long")).otherwise(F.lit(0).cast("long"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_id_sql(column: str) -> str:
    """The SQL of canonical_id."""
    wide = f"translate({column}, {_quoted(FULL_WIDTH)}, {_quoted(ASCII)})"
    key = f"regexp_replace(lower(translate({wide}, 'Iıİ', 'iii')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return f"(CASE WHEN {key} NOT IN ('', {', '.join(map(_quoted, UNKNOWN_WORDS))}) THEN {key} END)"


def canonical_split_sql(column: str) -> str:
    """The SQL of canonical_split."""
    key = f"regexp_replace(lower(translate({column}, 'Iıİ', 'iii')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return "(CASE " + " ".join(f"WHEN {key} IN ({', '.join(map(_quoted, names))}) THEN {_quoted(split)}" for split, names in SPLIT_NAMES.items()) + " END)"
