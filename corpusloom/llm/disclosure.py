"""Problem 3: personal information in free text, found and replaced with typed placeholders."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.identity import ASCII, FULL_WIDTH
from corpusloom.llm.lookalikes import LATIN, OTHER
from corpusloom.plans.joins import bounded, hot_keys, salted_join
from corpusloom.session import cut

MAX_NAMES = 100_000
BITS = 0.0
CAPITALS = 4.0
# Turkish number words.
UNITS = {"sıfır": 0, "bir": 1, "iki": 2, "üç": 3, "dört": 4, "beş": 5, "altı": 6, "yedi": 7, "sekiz": 8, "dokuz": 9}
TENS = {"on": 10, "yirmi": 20, "otuz": 30, "kırk": 40, "elli": 50, "altmış": 60, "yetmiş": 70, "seksen": 80, "doksan": 90}
HUNDRED = "yüz"
PLACEHOLDERS = {"email": "[EMAIL]", "phone_number": "[PHONE]", "identity_number": "[IDENTITY]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}

SPACES = "".join(c for c in map(chr, range(0xA0, 0x3001)) if unicodedata.category(c) == "Zs")
ONE_TO_ONE = str.maketrans(FULL_WIDTH + OTHER + SPACES, ASCII + LATIN + " " * len(SPACES))
ODD = re.compile("[" + "".join(map(re.escape, FULL_WIDTH + OTHER + SPACES)) + "]")
LOOSE = re.compile(r"[̀-ͯ­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
WORD = re.compile(r"[^\W\d_]+")
NUMBER = "(?:" + "|".join([*UNITS, *TENS, HUNDRED]) + ")"
NUMBERS = rf"{NUMBER}(?:\s+{NUMBER})*"
DOT = r"[ \t]?\.[ \t]?"
EMAIL = re.compile(r"[\w.+\-]*\w[ ]?@[ ]?[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}")
PART = r"[\w\-]+"
JOINT = r"\s(?:nokta|alt çizgi|tire|artı)\s"
SPOKEN_EMAIL = re.compile(rf"{PART}(?:{JOINT}{PART})*\s(?:et işareti|kuyruklu a)\s{PART}(?:\s(?:tire|alt çizgi)\s{PART})*(?:\snokta\s{PART})+")
VEILED_AT, VEILED_DOT = r"\s?[\[({](?:at|et)[\])}]\s?", r"(?:\s?[\[({](?:dot|nokta)[\])}]\s?|\s(?:nokta|dot)\s|\.)"
VEILED_EMAIL = re.compile(rf"[\w.+\-]*\w(?:{JOINT}[\w.+\-]+)*{VEILED_AT}[\w\-]+(?:{VEILED_DOT}[\w\-]+)+")
VEILED = re.compile(r"[\[({](?:at|et)[\])}]")
PHONE = re.compile(r"(?<![\w+])(?<!\d[ .\-])(?:\+?90[ .\-]{0,2}|0[ .\-]{0,2})?(?:\([2-5]\d{2}\)|[2-5]\d{2})[ .\-]{0,2}\d{3}[ .\-]{0,2}\d{2}[ .\-]{0,2}\d{2}(?!\w)(?![ .\-]\d)")
SPACED_PHONE = re.compile(r"(?<![\w+])(?<!\d[ .\-])(?:\+?9 0 |0 )?[2-5](?: \d){9}(?!\w)(?! \d)")
IDENTITY = re.compile(r"(?<!\w)(?<!\d[ .\-])[1-9](?:[ .\-]?\d){10}(?!\w)(?![ .\-]\d)")
STREET = r"(?:sokak|sokağı|sokagı|sokagi|sok\.|sok|sk\.|sk|caddesi|cadde|cad\.|cad|cd\.|cd|bulvarı|bulvari|bulvar|blv\.|blv|bul\.)"
HOUSE = rf"(?:\s*(?:no|numara|num)\s*[:.]?\s*\d+\w?|\s*\d+\s*/\s*\d+|\s+(?:{NUMBERS}|\d+)\s+numara|\s+numara\s+{NUMBERS}|\s*\d+(?=\s*(?:daire|kat|d[:.]|$|[.,;])))"
ADDRESS = re.compile(rf"(?:\w+\s(?:mahallesi|mah\.?)\s+)?\w+\s{STREET}{HOUSE}(?:[\s,]*(?:daire|kat|d|k)\s*[:.]?\s*(?:\d+|{NUMBERS}))*", re.S)
STREET_WORD = re.compile(rf"\b{STREET}(?!\w)")
MANY_DIGITS = re.compile(r"\d(?:[ .()\-]{0,3}\d){9}")
NUMBER_WORDS = frozenset([*UNITS, *TENS, HUNDRED])
RUN = re.compile(rf"(?<!\w){NUMBERS}(?!\w)")


def turkish_lower(text: str) -> str:
    """Lower case with as many characters as before."""
    plain = text.replace("I", "ı").replace("İ", "i")
    low = plain.lower()
    return low if len(low) == len(plain) else "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text with width, spaces and look-alike letters in plain form, composed, without unseen characters, and the
    place of each of its characters in the text; None where places are the same."""
    plain = text.translate(ONE_TO_ONE) if ODD.search(text) else text
    if not LOOSE.search(plain):
        return plain, None
    out, places = [], []
    for k, c in enumerate(plain):
        if unicodedata.combining(c) and out:
            both = unicodedata.normalize("NFC", out[-1] + c)
            if len(both) == 1:
                out[-1] = both
            continue
        if LOOSE.match(c):
            continue
        out.append(c)
        places.append(k)
    return "".join(out), places


def spoken_digits(words: list[str]) -> str:
    """The digits of a run of number words: each number is as long as it can be."""
    out, value, used = [], 0, 4  # used: the lowest place that is filled, 3 hundreds, 2 tens, 1 units
    for k, w in enumerate(words):
        if w == HUNDRED:
            if used == 1 and 0 < value < 10:
                value, used = value * 100, 3
            else:
                if used < 4:
                    out.append(str(value))
                value, used = 100, 3
        elif w in TENS:
            if used > 2 and used < 4:
                value, used = value + TENS[w], 2
            else:
                if used < 4:
                    out.append(str(value))
                value, used = TENS[w], 2
        else:
            unit = UNITS[w]
            follows = k + 1 < len(words) and words[k + 1] == HUNDRED and unit > 1
            if unit and 1 < used < 4 and not follows:
                value, used = value + unit, 1
            else:
                if used < 4:
                    out.append(str(value))
                value, used = unit, 1
    if used < 4:
        out.append(str(value))
    return "".join(out)


#: What the first nine digits weigh in the tenth; the eleventh is the sum of the ten before it.
IDENTITY_WEIGHTS = (7, -1, 7, -1, 7, -1, 7, -1, 7)


def valid_identity(digits: str) -> bool:
    """Eleven digits with the two check digits of the Turkish identity number."""
    if not re.fullmatch(r"[1-9]\d{10}", digits):
        return False
    values = list(map(int, digits))
    checks = sum(w * v for w, v in zip(IDENTITY_WEIGHTS, values)), sum(values[:10])
    return [c % 10 for c in checks] == values[9:]


#: A phone number read out in numbers, where a pair with a leading zero may have lost it.
SHORT_PHONE = re.compile(r"0[2-5]\d{7,8}")


def phone_digits(digits: str) -> bool:
    """Ten national digits, with or without trunk or country code."""
    return bool(re.fullmatch(r"(?:90|0)?[2-5]\d{9}", digits))


def _blank(text: str, spans: Iterable[tuple]) -> str:
    chars = list(text)
    for _, a, b in spans:
        chars[a:b] = "\n" * (b - a)
    return "".join(chars)


def scan(text: str, names: frozenset[str]) -> tuple[list[tuple], list[tuple]]:
    """(spans, candidates) of a text, both in its own places.

    spans: (type, start, end) of e-mail addresses, phone and identity numbers and addresses. candidates: (start, end,
    left word, word, ending, right word, case) of a given name, or several, and the next word; a mark that stands
    between counts as the left or right word; case is 1 where both words have a capital, 0 where not, and -1 where the
    whole text is in capitals.
    """
    plain, places = folded(text)
    low = turkish_lower(plain)
    spans: list[tuple] = []

    def take(kind: str, a: int, b: int) -> None:
        if not any(x < b and a < y for _, x, y in spans):
            spans.append((kind, a, b))

    if "@" in low:
        for m in EMAIL.finditer(plain):
            take("email", *m.span())
    if VEILED.search(low):
        for m in VEILED_EMAIL.finditer(low):
            take("email", *m.span())
    if "işareti" in low or "kuyruklu" in low:
        for m in SPOKEN_EMAIL.finditer(low):
            take("email", *m.span())
    if STREET_WORD.search(low):
        clear = _blank(low, spans)
        for m in ADDRESS.finditer(clear):
            head = re.match(rf"(?:\w+\s(?:mahallesi|mah\.?)\s+)?(\w+)\s({STREET})", m[0])
            named = head is not None and not head[1].isdigit()
            if named:
                take("street_address", m.start(), m.end())
    if MANY_DIGITS.search(low):
        clear = _blank(low, spans)
        for m in IDENTITY.finditer(clear):
            if valid_identity(re.sub(r"\D", "", m[0])):
                take("identity_number", *m.span())
        clear = _blank(low, spans)
        for pattern in (PHONE, SPACED_PHONE):
            for m in pattern.finditer(clear):
                take("phone_number", *m.span())
    words = WORD.findall(low)
    if sum(map(NUMBER_WORDS.__contains__, words)) >= 5:
        for m in RUN.finditer(_blank(low, spans)):
            number = spoken_digits(m[0].split())
            if valid_identity(number):
                take("identity_number", *m.span())
            elif phone_digits(number) or SHORT_PHONE.fullmatch(number):
                take("phone_number", *m.span())
    candidates = []
    if not names.isdisjoint(words):
        clear = list(WORD.finditer(_blank(low, spans)))
        capitals = sum(c.isupper() for c in plain) > 0.6 * max(1, sum(c.isalpha() for c in plain))
        k = 0
        while k < len(clear):
            if clear[k][0] not in names:
                k += 1
                continue
            first = k
            while k + 1 < len(clear) and clear[k + 1][0] in names and plain[clear[k].end() : clear[k + 1].start()].isspace():
                k += 1
            last = k + 1
            near = last < len(clear) and plain[clear[k].end() : clear[last].start()] in (" ", "  ")
            if not near and k > first:  # a given name may be the surname
                last, near = k, True
            if near:
                a, b = clear[first].start(), clear[last].end()
                before = plain[clear[first - 1].end() : a].strip() if first else "^"
                after = plain[b : clear[last + 1].start()].strip() if last + 1 < len(clear) else plain[b:].strip() or "$"
                left = before[:1] or clear[first - 1][0]
                right = after[:1] or clear[last + 1][0]
                word = clear[last][0]
                case = -1 if capitals else int(plain[a].isupper() and plain[clear[last].start()].isupper())
                candidates.append((a, b, left, word, word[-4:], right, case))
            k += 1
    if places is not None:
        place = lambda a, b: (places[a], places[b - 1] + 1)
        spans = [(t, *place(a, b)) for t, a, b in spans]
        candidates = [(*place(c[0], c[1]), *c[2:]) for c in candidates]
    return spans, candidates


def sanitised(text: str, spans: Iterable[tuple]) -> str:
    """The text with each span (type, start, end) replaced by the placeholder of its type."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
    return "".join(out) + text[at:]


SPAN = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("word", pa.string()), ("ending", pa.string()), ("right", pa.string()), ("upper", pa.int32())])


@dataclass(frozen=True)
class Disclosures:
    """found: id, text, spans of the rows that hold personal information. terms: what the corpus says of each term."""

    found: DataFrame
    terms: DataFrame


def find_personal(texts: DataFrame, given_names: DataFrame, id_col: str = "id", text_col: str = "text", name_col: str = "given_name", bits: float = BITS) -> Disclosures:
    """Personal information in every text.

    Method: information-theoretic sanitisation. E-mail addresses, phone numbers, identity numbers and street
    addresses have a form of their own, in digits or in words, and are matched by it, identity numbers with their
    check digits. For names the corpus is asked: next to every given name, the words before and after, the word in the
    place of a surname and its ending are counted over all texts, apart by whether both words are capitalised; the
    logarithm of the ratio of the two shares says how many bits a term reveals of a protected name. The sum of the
    bits of an occurrence's terms decides; where it exceeds `bits`, the name is removed. So "yağmur sesi" stays and
    "Yağmur Ulvatmaz" goes, in capitals or not, though both words of either occur elsewhere.

    Defined cases: null and empty texts hold nothing. Rows equal in id and text count once. Given names are compared
    in lower case; null and empty ones are ignored; they are sent to every task, at most MAX_NAMES of them, which is
    checked. A name inside an e-mail or a street address is no name. Other columns are not read.
    """
    if not bounded(given_names, MAX_NAMES):
        raise ValueError(f"more than {MAX_NAMES} given names")
    names = frozenset(turkish_lower(unicodedata.normalize("NFC", r[0].strip())) for r in given_names.select(name_col).distinct().collect() if r[0] and r[0].strip())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, candidates = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                s, c = scan(text, names)
                if s or c:
                    kept.append(k)
                    spans.append([{"type": t, "start": a, "end": b} for t, a, b in s])
                    candidates.append([dict(zip(("start", "end", "left", "word", "ending", "right", "upper"), x)) for x in c])
            part = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, pa.list_(SPAN)), pa.array(candidates, pa.list_(CANDIDATE))], names=["id", "text", "spans", "candidates"])

    rows = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    schema = "id string, text string, spans array<struct<type:string,start:int,end:int>>, candidates array<struct<start:int,end:int,left:string,word:string,ending:string,right:string,upper:int>>"
    hits = cut(rows.mapInArrow(run, schema).distinct())
    each = hits.where("size(candidates) > 0").select("id", "text", F.explode("candidates").alias("c")).select("id", "text", "c.*")
    kinds = ("left", "word", "ending", "right")
    melted = each.select("id", "text", "start", "end", "upper", F.explode(F.array(*[F.concat(F.lit(f"{k}:"), F.col(k)) for k in kinds])).alias("term"))
    terms = melted.groupBy("term").agg(F.sum(F.when(F.col("upper") == 1, 1).otherwise(0)).alias("names"), F.sum(F.when(F.col("upper") == 0, 1).otherwise(0)).alias("others"), F.count(F.lit(1)).alias("n"))
    sums = each.agg(F.sum(F.when(F.col("upper") == 1, 1).otherwise(0)).alias("all_names"), F.sum(F.when(F.col("upper") == 0, 1).otherwise(0)).alias("all_others"))
    # one pseudo-occurrence in the proportion of the whole corpus: a term that was never seen reveals 0 bits
    usual = F.col("all_names") / (F.col("all_names") + F.col("all_others"))
    ratio = (F.col("names") + usual) / (F.col("others") + 1 - usual)
    odds = F.col("all_names") / F.col("all_others")
    terms = terms.join(F.broadcast(sums.select((F.col("all_names") + 0.5).alias("all_names"), (F.col("all_others") + 0.5).alias("all_others"))))
    terms = cut(terms.withColumn("bits", F.log2(ratio / odds)).withColumn("prior", F.log2(odds)))
    hot = hot_keys(terms, "term", "n")
    scored = salted_join(melted, terms.select("term", "bits", "n", "prior"), "term", hot, F.xxhash64("id", "start"))
    kind = F.substring_index("term", ":", 1)
    of = lambda k, c: F.max(F.when(kind == k, F.col(c)))
    total = scored.groupBy("id", "text", "start", "end", "upper").agg(
        (of("left", "bits") + of("right", "bits")
         + F.when(of("word", "n") >= 5, of("word", "bits")).otherwise(of("ending", "bits"))).alias("evidence"),
        F.max("prior").alias("prior"),
    )
    # a name in plain sight need not make up for the prior: two capitals are CAPITALS bits
    judged = total.withColumn("total", F.col("evidence") + F.when(F.col("upper") == 1, F.lit(CAPITALS)).otherwise(F.least(F.col("prior"), F.lit(0.0))))
    people = judged.where(F.col("total") > bits).groupBy("id", "text").agg(F.collect_set(F.struct(F.lit("person_name").alias("type"), "start", "end")).alias("people"))
    people = people.select(F.col("id").alias("person_id"), F.col("text").alias("person_text"), "people")
    same = F.col("id").eqNullSafe(F.col("person_id")) & (F.col("text") == F.col("person_text"))
    found = hits.join(people, same, "left").select("id", "text", F.concat("spans", F.coalesce("people", F.array().cast("array<struct<type:string,start:int,end:int>>"))).alias("spans"))
    return Disclosures(found.where("size(spans) > 0"), terms)


def sanitise(texts: DataFrame, given_names: DataFrame, id_col: str = "id", text_col: str = "text", name_col: str = "given_name", bits: float = BITS) -> DataFrame:
    """(id, text, found): every distinct row of texts, with placeholders in place of personal information and the sorted types found.

    Cases as in find_personal; a null or empty text stays as it is.
    """
    found = find_personal(texts, given_names, id_col, text_col, name_col, bits).found.select(F.col("id").alias("found_id"), F.col("text").alias("found_text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            clean = [t if s is None else sanitised(t, [(x["type"], x["start"], x["end"]) for x in s]) for t, s in zip(batch.column(1).to_pylist(), spans)]
            kinds = [sorted({x["type"] for x in s or ()}) for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["id", "text", "found"])

    rows = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text") == F.col("found_text"))
    joined = rows.join(found, same, "left").select("id", "text", "spans")
    plain = joined.where("spans is null").select("id", "text", F.array().cast("array<string>").alias("found"))
    return plain.unionByName(joined.where("spans is not null").mapInArrow(run, "id string, text string, found array<string>"))
