"""Problem 5: one consistent form for texts that look the same but differ in their characters."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.identity import ASCII, FULL_WIDTH
from corpusloom.functions.text import turkish_lower
from corpusloom.plans.joins import hot_keys, salted_join, small
from corpusloom.session import cut

# Letters of other scripts, and the Latin letters that they look like.
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανυιρ", "ABEZHIKMNOPTYXoavuıp"),
}
SCRIPTS = ("Latin", *LOOKALIKES)
OTHER = "".join(a for a, _ in LOOKALIKES.values())
LATIN = "".join(b for _, b in LOOKALIKES.values())
# Characters that are not seen, as a class of Java's regular expressions.
UNSEEN = r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠍ㅤ︀-️ﾠ]"
# Half-width punctuation and signs, with their usual forms.
SIGNS = ("￠￡￢￣￤￥￦‐‑", "¢£¬¯¦¥₩--")
# Ranges with characters for several letters at once (ligatures, digraphs, Roman numerals, presentation forms
# of other scripts) or for one letter in another place (radicals, half-width letters), all drawn like the letters themselves.
DRAWN_ALIKE = (
    (0x0132, 0x0133), (0x013F, 0x0140), (0x0149, 0x0149), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0E33, 0x0E33), (0x0EB3, 0x0EB3),
    (0x0EDC, 0x0EDD), (0x2135, 0x2138), (0x2160, 0x217F), (0x2F00, 0x2FD5), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB20, 0xFB28),
    (0xFB4F, 0xFBB1), (0xFBD3, 0xFD3D), (0xFE80, 0xFEFC), (0xFF66, 0xFF9F), (0xFFA1, 0xFFDC),
)
# What a text without any such character is made of, as a class of Java's regular expressions.
USUAL = r"\x20-\x7E\u00A1-\u00AC\u00AE-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u01C3\u01CD-\u01F0\u01F4-\u024F\u2013\u2014\u2018-\u201D\u2026\u20AC\u20BA"
FOREIGN = r"[\p{IsCyrillic}\p{IsGreek}]"
#: Bytes of a side that is sent to every task.
BROADCAST = 16_000_000


def _plain_letters() -> dict[int, str]:
    """The letters that each character of DRAWN_ALIKE stands for: one step of its decomposition, which keeps a long s."""
    steps = {c: unicodedata.decomposition(chr(c)).split() for low, high in DRAWN_ALIKE for c in range(low, high + 1)}
    return {c: "".join(chr(int(x, 16)) for x in step[1:]) for c, step in steps.items() if step and step[0].startswith("<")}


PLAIN_LETTERS = _plain_letters()


def unusual(text: Column) -> Column:
    """Whether the form may differ from the text: one native look at most texts instead of all the steps."""
    return text.rlike(f"[^{USUAL}]|  |^ | $")


def plain_form(text: Column) -> Column:
    """Width, spaces and unseen characters in one form; native."""
    wide = F.translate(text, FULL_WIDTH + SIGNS[0], ASCII + SIGNS[1])
    seen = F.regexp_replace(wide, UNSEEN, "")
    return F.trim(F.regexp_replace(seen, r"[\p{Z}\s]+", " "))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Ligatures and their like as plain letters, and NFC, with no second dot on a small i."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.translate(PLAIN_LETTERS).replace("i̇", "i")))


def letters_of(script: str, text: Column) -> Column:
    """How many letters of a script a text has."""
    return F.length(F.regexp_replace(text, rf"[^\p{{Is{script}}}]", ""))


def dominant(counts: Column, preferred: Column | None = None) -> Column:
    """The script with most letters in a struct of counts; in a tie the preferred one, or else Latin."""
    most = F.greatest(*[counts[s] for s in SCRIPTS])
    first = F.coalesce(*[F.when(counts[s] == most, F.lit(s)) for s in SCRIPTS])
    if preferred is None:
        return first
    return F.coalesce(*[F.when((preferred == s) & (counts[s] == most), F.lit(s)) for s in SCRIPTS], first)


def into_script(token: Column, script: Column) -> Column:
    """The token with look-alikes of the other scripts replaced by letters of this one; null where one has none, or
    where nothing changes."""
    out = F.lit(None).cast("string")
    for name in SCRIPTS:
        turned = token
        for other, (own, latin) in LOOKALIKES.items():  # by way of Latin
            if other != name:
                turned = F.translate(turned, own, latin)
        if name != "Latin":
            turned = F.translate(turned, LOOKALIKES[name][1], LOOKALIKES[name][0])
        whole = ~turned.rlike(rf"[\p{{L}}&&[^\p{{Is{name}}}]]")
        out = F.when((script == name) & whole & (turned != token), turned).otherwise(out)
    return out


@dataclass(frozen=True)
class Forms:
    """forms: key, text, form for every row. repairs: the tokens that were repaired, with the script of their text and
    their repaired form."""

    forms: DataFrame
    repairs: DataFrame


def consistent_forms(texts: DataFrame, key_col: str = "id", text_col: str = "text") -> Forms:
    """The consistent form of each text.

    Method: script-aware repair. Width, spaces, ligatures and unseen characters are unified and marks composed; case,
    diacritics, dotless i, punctuation and quotes stay as they are. In every token with Cyrillic or Greek letters the
    letters of each script are counted. A token of several scripts has the dominant one, in a tie that of its text; its
    other letters are replaced by look-alikes of that script, if each has one and the result is a word of the corpus,
    in any case, written in that script alone. Where it is none, the same is tried with the dominant script of the
    text. A token of one script is touched only where it could be of the text's dominant script letter by letter, such
    as a Cyrillic "o" in a Latin text, under the same condition; so "cop" spelled in Cyrillic stays in a Cyrillic
    sentence, and true words of other scripts stay everywhere.

    Defined cases: null texts have a null form, empty texts and texts of unseen characters only an empty one.
    Repeated rows stay repeated rows. Other columns are not passed on. The words that are asked for are broadcast where
    they take at most BROADCAST bytes, which is checked, and joined otherwise.
    """
    rows = texts.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    usual = rows.where("text is null").unionByName(rows.where(~unusual(F.col("text")))).withColumn("form", F.col("text"))
    odd = rows.where(unusual(F.col("text"))).withColumn("form", plain_form(F.col("text")))
    odd = cut(odd.withColumn("form", composed("form")))
    foreign = F.col("form").rlike(FOREIGN)
    counts = lambda c: F.struct(*[letters_of(s, F.col(c)).alias(s) for s in SCRIPTS])
    strange = odd.where(foreign).withColumn("script", dominant(counts("form")))
    edge = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    core = lambda c: F.regexp_replace(c, edge, "")
    tokens = lambda df, *keep: df.select(*keep, F.explode(F.split("form", " ")).alias("token")).select(*keep, core(F.col("token")).alias("spelling"))
    seen = cut(tokens(strange, "script").where(F.col("spelling").rlike(FOREIGN)).distinct())
    own = dominant(F.col("n"), F.col("script"))
    tried = seen.withColumn("n", counts("spelling")).select("spelling", "script", F.explode(F.array(F.struct(F.lit(0).alias("turn"), own.alias("to")), F.struct(F.lit(1).alias("turn"), F.col("script").alias("to")))).alias("x"))
    tried = tried.select("spelling", "script", "x.turn", into_script(F.col("spelling"), F.col("x.to")).alias("repair")).where("repair is not null").withColumn("word", turkish_lower(F.col("repair")))
    tried = cut(tried)
    asked = cut(tried.select("word").distinct())
    # words of one script: of texts without foreign letters, and the tokens of others that are not mixed
    plain = tokens(rows.where(~unusual(F.col("text"))).select(F.col("text").alias("form")).unionByName(odd.where(~foreign).select("form")))
    pure = tokens(strange)
    for one in SCRIPTS:
        pure = pure.where(~(F.col("spelling").rlike(rf"\p{{Is{one}}}") & F.col("spelling").rlike(rf"[\p{{L}}&&[^\p{{Is{one}}}]]")))
    words = plain.unionByName(pure).select(turkish_lower(F.col("spelling")).alias("word"))
    known = words.join(F.broadcast(asked), "word", "left_semi").distinct() if small(asked, BROADCAST) else words.distinct().join(asked, "word", "left_semi")
    repairs = cut(tried.join(known, "word").groupBy("spelling", "script").agg(F.min_by("repair", "turn").alias("repair")))
    # put the repairs back: position by position, only in the texts that hold foreign letters
    at = cut(strange.select(F.monotonically_increasing_id().alias("row"), "key", "text", "form", "script"))
    each = at.select("row", "script", F.posexplode(F.split("form", " ")).alias("pos", "token")).withColumn("spelling", core(F.col("token")))
    fixed = each.join(repairs, ["spelling", "script"], "left").withColumn("token", F.when(F.col("repair").isNotNull(), F.expr("replace(token, spelling, repair)")).otherwise(F.col("token")))
    joined = fixed.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("repaired"))
    done = at.join(joined, "row").select("key", "text", F.col("repaired").alias("form"))
    return Forms(usual.unionByName(odd.where(~foreign)).unionByName(done), repairs)


def same_looking_pairs(forms: DataFrame) -> DataFrame:
    """(id_a, id_b) of all rows of forms (key, text, form) with one form but different characters, the smaller first.

    Rows without key, text or with an empty form pair with none. Of two different texts of one form at least one
    differs from it, so only the forms of such texts are looked for: by broadcast of at most BROADCAST bytes of their
    hashes, otherwise by a join. Within a form the different texts are paired, and only these pairs are spelled out to
    rows, salted for texts that many rows have: what is made is what is asked for, every pair of rows whose texts differ.
    """
    key = lambda c: F.xxhash64(c)
    rows = forms.where("key is not null and text is not null and form <> ''").withColumn("h", key("form"))
    changed = cut(rows.where("form <> text").select("h").distinct())
    few = small(changed, BROADCAST)
    near = rows.join(F.broadcast(changed) if few else changed, "h", "left_semi")
    near = cut(near.select("key", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("text")).distinct())
    classes = near.groupBy("form", "text").agg(F.count(F.lit(1)).alias("n"))
    a = classes.select("form", F.col("text").alias("a"))
    b = classes.select("form", F.col("text").alias("b"))
    links = a.join(b, "form").where("a <> b")
    hot = hot_keys(classes, "text", "n", least=1000)
    left = salted_join(near.select("key", F.col("text").alias("a")), links.select("a", "b"), "a", hot.select(F.col("text").alias("a")), F.xxhash64("key"))
    right = near.select(F.col("key").alias("other"), F.col("text").alias("b"))
    pairs = salted_join(left, right, "b", hot.select(F.col("text").alias("b")), F.xxhash64("key"))
    return pairs.where("key < other").select(F.col("key").alias("id_a"), F.col("other").alias("id_b")).distinct()
