"""Problem 9: pages of repeated keywords, links or product tags instead of sentences."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.disclosure import LOOSE, ODD, ONE_TO_ONE
from corpusloom.session import cut

SHORT_LINE, PASSAGE, LONG_LINE = 8, 40, 60
#: A language's statistics count n / (n + BLEND) beside those of all, n being its passages.
BLEND = 200
#: Squared distance of an outlier: the 0.999 quantile of chi-square with 8 degrees of freedom.
OUTLIER = 26.12
#: Least length of an outlier's projection on the spam direction, in robust deviations of at most WINSOR each.
DIRECTED, WINSOR = 2.5, 6.0
SHARE = 2 / 3

#: Function words of a language are its words that the largest share of its documents has, at least COMMON of them and
#: LEAST in number, and at most FEW words.
COMMON, LEAST, FEW = 0.1, 10, 60
# Turkish numerals, folded to plain letters.
NUMERALS = frozenset(["sifir", "bir", "iki", "uc", "dort", "bes", "alti", "yedi", "sekiz", "dokuz", "on", "yirmi", "otuz", "kirk", "elli", "altmis", "yetmis", "seksen", "doksan", "yuz", "bin"])
PLAIN = (("I", "i"), ("İ", "i"), ("ı", "i"), ("ş", "s"), ("ç", "c"), ("ğ", "g"), ("ü", "u"), ("ö", "o"), ("Ş", "s"), ("Ç", "c"), ("Ğ", "g"), ("Ü", "u"), ("Ö", "o"))
LINES = re.compile(r"[\r\n]+|</?(?:p|br|li|div|tr|ul|ol|h\d)\b[^<>]*>")
LINK = re.compile(r"<a\b[^<>]*>[^<>]*</a>|\[[^\[\]]*\]\([^()\s]*\)|https?://\S+|www\.\S+|^[^\n»>]{0,60}(?:»|>>)\s*[\w\-]+(?:\.[\w\-]+)+", re.M)
LINK_MARKS = ("http", "www.", ">>", "»")
TOKEN = re.compile(r"[^\W_]+")
CODE = re.compile(r"\b[a-z]{1,4}-\d{1,5}\b")
SEPARATORS = (",", "|", "·", "•", ";", " / ", " - ", " + ", "*", "#")
STOP = re.compile(r"[.!?…]+(?=\s|$)")
ENTRY = re.compile(r"→|=>|(?<!\S)/\w+/|\[\d+\]|^\W*[\w ]{1,30}:\s", re.M)

FEATURES = ("link", "tag", "separator", "repeat", "order", "function", "sentence", "entry")
#: Which way spam lies, feature by feature.
DIRECTION = np.array([1, 1, 1, 1, 1, -1, -1, -2], float)
#: Least scale of each feature, so that one that hardly varies does not make every page an outlier.
FLOOR = np.array([0.05, 0.05, 0.12, 0.08, 0.05, 0.05, 0.2, 0.03])


def plain(text: str) -> str:
    """Lower case, plain letters, no unseen characters."""
    if not text.isascii():
        if ODD.search(text):
            text = text.translate(ONE_TO_ONE)
        if LOOSE.search(text):
            text = LOOSE.sub("", text)
        for a, b in PLAIN:
            text = text.replace(a, b)
    return text.lower()


def passages(text: str) -> list[tuple[str, list[str]]]:
    """(passage, tokens): lines, with runs of short lines joined and long ones cut."""
    out: list[tuple[str, list[str]]] = []
    short: list[str] = []
    words: list[str] = []
    for line in LINES.split(text):
        found = TOKEN.findall(line)
        if not found:
            continue
        if len(found) < SHORT_LINE:
            short.append(line)
            words += found
            if len(words) >= PASSAGE:
                out.append(("\n".join(short), words))
                short, words = [], []
            continue
        if short:
            out.append(("\n".join(short), words))
            short, words = [], []
        if len(found) <= LONG_LINE:
            out.append((line, found))
            continue
        spots = [m.start() for m in TOKEN.finditer(line)]
        marks = [*range(0, len(spots) - PASSAGE // 2, PASSAGE)]
        for a, b in zip(marks, [*marks[1:], len(spots)]):
            out.append((line[spots[a] : spots[b] if b < len(spots) else len(line)], found[a:b]))
    if short:
        out.append(("\n".join(short), words))
    return out


def sentence_ends(passage: str) -> int:
    """Marks that end a sentence, after a letter."""
    return sum(passage[m.start() - 1].isalpha() for m in STOP.finditer(passage) if m.start())


def features(text: str, function_words: frozenset[str]) -> tuple[list[int], list[list[float]]]:
    """(words, features) of each passage of a text."""
    parts = passages(plain(text))
    pairs: Counter = Counter()
    kept = []
    for _, words in parts:
        own = [w for w in words if w not in NUMERALS and w[0] > "9"]
        kept.append(own)
        pairs.update(zip(own, own[1:]))
    often = {p for p, c in pairs.items() if c >= 3}
    sizes, rows = [], []
    for (passage, words), own in zip(parts, kept):
        n, m = len(words), len(own)
        again = 0
        if often:
            last = -1
            for k in range(m - 1):
                if (own[k], own[k + 1]) in often:
                    again += 2 if last < k else 1
                    last = k + 1
        counts = Counter(own)
        alike = sum(c * math.log(c) for c in counts.values() if c > 1)
        linked = sum(map(len, LINK.findall(passage))) if any(x in passage for x in LINK_MARKS) else 0
        tags = passage.count("#") - passage.count("# ")
        if "-" in passage:
            tags += len(CODE.findall(passage))
        rows.append(
            [
                min(1.0, linked / len(passage)),
                min(1.0, 2 * tags / n),
                min(1.0, sum(map(passage.count, SEPARATORS)) / n),
                again / n,
                alike / (m * math.log(m)) if m > 2 else 0.0,
                sum(map(function_words.__contains__, words)) / n,
                min(1.0, 10 * sentence_ends(passage) / n),
                min(1.0, 2 * len(ENTRY.findall(passage)) / n) if ("→" in passage or ":" in passage or "/" in passage or "[" in passage) else 0.0,
            ]
        )
        sizes.append(n)
    return sizes, rows


def language(lang: Column) -> Column:
    """A two-letter code for the usual spellings; "und" for none."""
    key = F.lower(F.trim(lang))
    return F.when(key.rlike("^(tr|tur|turk|türk)"), "tr").when(key.rlike("^en(g|$|[-_])"), "en").otherwise(F.coalesce(F.regexp_extract(key, "^[a-z]{2}", 0), F.lit("und")))


def folded_words(text: Column) -> Column:
    """The distinct words of a text, as plain() gives them for texts without look-alike letters."""
    letters, to = "".join(a for a, _ in PLAIN), "".join(b for _, b in PLAIN)
    return F.array_distinct(F.split(F.lower(F.translate(text, letters, to)), r"[\s\p{Punct}\u00A0\u00AB\u00BB\u2000-\u206F\u3000]+"))


def function_words(documents: DataFrame) -> frozenset[str]:
    """The function words of all languages of documents (lang, text): of each language the FEW words that most of its
    documents have, where these are at least LEAST and a COMMON part of them. Which language a document says it is does
    not matter then, as it may say nothing or a wrong one. Collected are at most FEW words a language."""
    each = documents.where("text is not null and text <> ''")
    sizes = each.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    per = each.select("lang", F.explode(folded_words(F.col("text"))).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df"))
    often = per.where(F.col("df") >= LEAST).join(F.broadcast(sizes), "lang").where(F.col("df") >= COMMON * F.col("n"))  # a document has few words, so these are few
    top = often.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "word"))).where(F.col("k") <= FEW)
    return frozenset(r.word for r in top.select("word").distinct().collect())


@dataclass(frozen=True)
class Stuffed:
    """documents: doc_id, words, spam_words, spam_share, stuffed. center: the robust statistics of each language."""

    documents: DataFrame
    center: dict[str, dict]


def find_stuffed(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", share: float = SHARE, outlier: float = OUTLIER, directed: float = DIRECTED
) -> Stuffed:
    """The share of each document that is keywords, links or product tags, and whether it passes `share`.

    Method: robust Mahalanobis distance. Every passage (a line, a run of short lines or a piece of a long one) has
    features of density (links, tags and codes, separators), repetition within its document, lack of entropy, function
    words, sentence ends and entries of reference lists. The function words of each language are taken from the corpus: the
    words that most of its documents have. Per language, over all passages, median and quartiles give centre and scale,
    and the covariance of the passages within three deviations gives the metric; each is blended with that of all
    passages by the number of the language's passages, so a rare language leans on all. A passage counts as spam where
    its squared distance is over `outlier` and it lies in the spam direction: more links, tags, separators, repetition,
    less entropy, fewer function words, sentences and entries. Numerals are no repetition, so drills stay; entries keep
    reference pages. A document's share is by words.

    Defined cases: null and empty texts, and texts without words, have 0 words and share 0. Rows of one id count as one
    document. Texts are read whole. An empty table gives an empty result. Collected are statistics and at most FEW words
    of each language; there are at most 678 languages, as language() gives two letters or "und".
    """
    k = len(FEATURES)
    rows = documents.select(F.col(id_col).alias("doc_id"), language(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = [f"f{i}" for i in range(k)]
    common = function_words(rows.select("lang", "text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                at, sizes, values = [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    n, f = features(text or "", common)
                    at += [i] * max(1, len(n))
                    sizes += n or [0]
                    values += f or [[0.0] * k]
                own = batch.take(pa.array(at, pa.int32()))
                table = np.array(values, np.float32).reshape(-1, k)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sizes, pa.int32()), *[pa.array(table[:, j]) for j in range(k)]], names=["doc_id", "lang", "words", *names])

    parts = cut(rows.mapInArrow(measure, f"doc_id {id_type}, lang string, words int, " + ", ".join(f"{n} float" for n in names)))
    real = parts.where("words > 0")
    quartiles = [F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(n) for n in names]
    found = {r.lang or "*": r for r in real.rollup("lang").agg(F.count(F.lit(1)).alias("n"), *quartiles).collect()}
    whole = np.array([found["*"][n] for n in names], float) if found.get("*") and found["*"].n else np.zeros((k, 3))
    center = {}
    for lang, r in found.items():
        weight = r.n / (r.n + BLEND) if lang != "*" else 1.0
        q = weight * np.array([r[n] for n in names], float) + (1 - weight) * whole if r.n else whole
        center[lang] = {"passages": r.n, "weight": weight, "median": q[:, 1], "scale": np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR)}
    center.setdefault("*", {"passages": 0, "weight": 1.0, "median": np.zeros(k), "scale": FLOOR})

    def standard(langs: list[str], table: np.ndarray) -> np.ndarray:
        kinds = sorted(set(langs))
        which = np.searchsorted(kinds, langs)
        return (table - np.array([center[x]["median"] for x in kinds])[which]) / np.array([center[x]["scale"] for x in kinds])[which]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = np.array(batch.column(0).to_pylist(), object)
            table = np.column_stack([batch.column(1 + j).to_numpy() for j in range(k)]).astype(float)
            for group in (langs, np.full(len(langs), "*", object)):  # every passage counts for its language and for all
                z = standard(group.tolist(), table)
                fine = (np.abs(z) <= 3).all(axis=1)
                for x in set(group[fine]):
                    one = np.column_stack([np.ones(int((fine & (group == x)).sum())), z[fine & (group == x)]])
                    sums[x] = sums.get(x, 0) + one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.reshape(-1).tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "m"])

    per_task = real.select("lang", *names).mapInArrow(moments, "lang string, m array<double>")
    wide = per_task.groupBy("lang").agg(*[F.sum(F.col("m")[j]).alias(f"m{j}") for j in range((k + 1) ** 2)])
    for r in wide.collect():
        m = np.array(r[1:], float).reshape(k + 1, k + 1)
        mean = m[0, 1:] / m[0, 0]
        center[r.lang]["covariance"] = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
    of_all = center["*"].get("covariance", np.zeros((k, k)))
    for c in center.values():
        c["covariance"] = c["weight"] * c.get("covariance", of_all) + (1 - c["weight"]) * of_all
        c["metric"] = np.linalg.inv(c["covariance"] + 0.1 * np.eye(k))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = DIRECTION / np.linalg.norm(DIRECTION)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            words = batch.column(2).to_numpy()
            if not langs:
                continue
            langs = [x if x in center else "*" for x in langs]  # a language without words has no statistics
            z = standard(langs, np.column_stack([batch.column(3 + j).to_numpy() for j in range(k)]).astype(float))
            away = np.zeros(len(z))
            for x in set(langs):
                own = np.array([y == x for y in langs])
                away[own] = np.einsum("ij,jk,ik->i", z[own], center[x]["metric"], z[own])
            spam = (away > outlier) & (np.clip(z, -WINSOR, WINSOR) @ unit > directed) & (words > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.where(spam, words, 0).astype(np.int32))], names=["doc_id", "words", "spam_words"])

    judged = parts.mapInArrow(judge, f"doc_id {id_type}, words int, spam_words int")
    per = judged.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum("spam_words").alias("spam_words"))
    part = F.when(F.col("words") > 0, F.col("spam_words") / F.col("words")).otherwise(0.0)
    return Stuffed(per.withColumn("spam_share", part).withColumn("stuffed", F.col("spam_share") > share), center)
