"""Turkish letters to phonetic symbols."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.spelling import lower

# The symbol of each letter that has one in all places; front and back vowels; long vowels.
SYMBOLS = {
    "a": "a", "b": "b", "c": "dʒ", "ç": "tʃ", "d": "d", "e": "e", "f": "f", "h": "h", "ı": "ɯ", "i": "i", "j": "ʒ", "m": "m",
    "n": "n", "o": "o", "ö": "œ", "p": "p", "q": "k", "r": "ɾ", "s": "s", "ş": "ʃ", "t": "t", "u": "u", "ü": "y", "v": "v",
    "w": "v", "x": "ks", "y": "j", "z": "z", "â": "aː", "î": "iː", "û": "uː",
}
FRONT, BACK, SOUNDED = "eiöü", "aıou", "aeıioöuü"
# Symbols of single letters in timed tokens, where context is not known; those that are not the letter itself.
TOKEN_SYMBOLS = {"c": "dʒ", "ç": "tʃ", "ğ": "ɰ", "ı": "ɯ", "j": "ʒ", "ö": "œ", "q": "k", "r": "ɾ", "ş": "ʃ", "ü": "y", "w": "v", "x": "ks", "y": "j"}

_RULES = re.compile(rf"(?P<long>(?<=[{SOUNDED}])ğ+)|(?P<mute>ğ)|(?P<soft>[kg](?=[{FRONT}]))|(?P<hard>[kg])|(?P<dark>(?<=[{BACK}])l)|(?P<clear>l)|(?P<plain>[{''.join(SYMBOLS)}])")


def _symbol(m: re.Match) -> str:
    match m.lastgroup:
        case "long":
            return "ː"
        case "mute":
            return ""
        case "soft":
            return "c" if m[0] == "k" else "ɟ"
        case "hard":
            return "k" if m[0] == "k" else "ɡ"
        case "dark":
            return "ɫ"
        case "clear":
            return "l"
    return SYMBOLS[m[0]]


def phonetic(text: str) -> str:
    """Symbols in place of letters; punctuation stays, apostrophes go, spaces are single."""
    return " ".join(_RULES.sub(_symbol, lower(text).replace("'", "")).split(" ")).strip() if text else ""


@F.pandas_udf(T.StringType())
def phonetic_form(texts: pd.Series) -> pd.Series:
    """phonetic, of a column."""
    return texts.map(lambda t: None if t is None else re.sub(" +", " ", phonetic(t)))


def token_symbol(grapheme: Column) -> Column:
    """The symbol of one letter of a timed token; native."""
    table = F.create_map(*[F.lit(x) for kv in TOKEN_SYMBOLS.items() for x in kv])
    return F.coalesce(F.element_at(table, grapheme), grapheme)


def inventory() -> list[str]:
    """Every symbol that phonetic() can give, sorted."""
    return sorted({*SYMBOLS.values(), "ː", "c", "ɟ", "k", "ɡ", "ɫ", "l"})
