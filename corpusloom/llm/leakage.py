"""Problem 8: evaluation prompts, whole or in part, inside a corpus of documents."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.disclosure import LOOSE, ODD, ONE_TO_ONE
from corpusloom.session import cut

WINDOW = 6
LEAST_WORDS = 10
#: Bytes of prompts that are held against all documents at once.
BLOCK_BYTES = 4_000_000
# Units that fill a slot of a template, folded.
UNITS = frozenset("adet cm dakika derece gb gram hz kg khz kilo km lira litre mb metre mm saat saniye tane tl".split())
TAG = re.compile(r"<[^<>]{0,300}>")
TOKEN = re.compile(r"[^\W_]+")
PLAIN = (("I", "i"), ("İ", "i"), ("ı", "i"), ("ş", "s"), ("ç", "c"), ("ğ", "g"), ("ü", "u"), ("ö", "o"), ("â", "a"), ("î", "i"), ("û", "u"), ("Ş", "s"), ("Ç", "c"), ("Ğ", "g"), ("Ü", "u"), ("Ö", "o"))
NUMBER, UNIT, NAME = 1, 2, 3


def tokens(text: str) -> list[str]:
    """Words in a form in which case, punctuation, spacing, markup, unseen and look-alike characters and Turkish
    letters typed as plain ones make no difference."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if ODD.search(text):
            text = text.translate(ONE_TO_ONE)
        if LOOSE.search(text):
            text = LOOSE.sub("", text)
        for a, b in PLAIN:
            text = text.replace(a, b)
    return TOKEN.findall(text.lower())


def slot(token: str) -> int:
    """NUMBER, UNIT or 0, by the token alone."""
    return NUMBER if token[0].isdigit() or token[-1].isdigit() else UNIT if token in UNITS else 0


class Prompts:
    """Prompts of enough words, with their template windows.

    A window is hashed with its numbers, units and names as slots. Which places of a window are names is its mask; there
    are few masks in use, at most 2 ** window, and a document's windows are hashed once for each, so any word of a
    document may fill a name's place, whatever other prompts there are.
    """

    def __init__(self, rows: list[tuple[str, str]], names: frozenset[str], least_words: int, window: int):
        self.window = window
        self.words: dict[str, int] = {}
        self.known: list[tuple[str, list[str], list[int], int]] = []  # id, tokens, word of each token, words
        self.names = names
        self.places: dict[int, list[tuple[int, int]]] = {}
        masks = set()
        for name, text in rows:
            parts = [tokens(w) for w in text.split()]
            flat = [t for p in parts for t in p]
            if len(parts) < least_words or not flat:
                continue
            for t in flat:
                self.words.setdefault(t, len(self.words) + 4)
            codes, named = self.codes(flat), np.array([self.kind(t) == NAME for t in flat])
            for mask in {self.mask(named[k : k + window]) for k in range(len(flat) - window + 1)} - {2**window - 1}:
                masks.add(mask)
                for at, h in enumerate(self.hashes(codes, mask).tolist()):
                    if self.mask(named[at : at + window]) == mask:
                        self.places.setdefault(h, []).append((len(self.known), at))
            self.known.append((name, flat, [k for k, p in enumerate(parts) for _ in p], len(parts)))
        self.masks = sorted(masks)
        self.sorted = np.array(sorted(self.places), np.int64)

    @staticmethod
    def mask(named: np.ndarray) -> int:
        """The places that are names, as bits."""
        return int(sum(1 << k for k, x in enumerate(named) if x))

    def kind(self, token: str) -> int:
        """The slot that a prompt's token is, 0 for a word."""
        return slot(token) or (NAME if token in self.names else 0)

    def codes(self, flat: list[str]) -> np.ndarray:
        """A number for each token: of its slot, of its word, or 0 for words that no prompt has."""
        get = self.words.get
        return np.fromiter((slot(t) or get(t, 0) for t in flat), np.int64, len(flat))

    def hashes(self, codes: np.ndarray, mask: int) -> np.ndarray:
        """Of each window, with names at the places of the mask."""
        n = len(codes) - self.window + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out = np.full(n, mask, np.uint64)
        c = codes.astype(np.uint64)
        for k in range(self.window):
            out = (out ^ (np.uint64(NAME) if mask >> k & 1 else c[k : k + n])) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def hits(self, documents: list[list[str]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(document, [(place in it, prompt, place in the prompt)]) of the documents that share a window with a prompt."""
        if not len(self.sorted) or not documents:
            return
        lengths = np.array([len(d) for d in documents])
        starts = np.cumsum(lengths) - lengths
        codes = self.codes([t for d in documents for t in d])
        found: dict[int, set] = {}
        for mask in self.masks:
            h = self.hashes(codes, mask)
            spot = np.searchsorted(self.sorted, h)
            spot[spot == len(self.sorted)] = 0
            for at in np.flatnonzero(self.sorted[spot] == h).tolist():
                d = int(np.searchsorted(starts, at, "right")) - 1
                if at + self.window <= starts[d] + lengths[d]:
                    found.setdefault(d, set()).update((at - int(starts[d]), k, p) for k, p in self.places[int(h[at])])
        for d in sorted(found):
            yield d, sorted(found[d], key=lambda x: (x[1], x[0], x[2]))

    def needed(self, words: int) -> int:
        """Words of one unbroken run that make a leak."""
        return max(self.window, -(-words // 2))

    def matches(self, flat: list[str], hits: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, str]]:
        """(prompt, words of the longest exact run, of the longest template run, words of the prompt, slots) of the
        prompts that leak. hits: (place in the document, prompt, place in the prompt)."""
        best: dict[int, list] = {}
        ends: dict[tuple[int, int], int] = {}
        for at, k, p in hits:
            name, own, of, words = self.known[k]
            line = (k, at - p)
            if ends.get(line, -1) >= at:
                continue
            # the same word, the same kind of slot, or any word in the place of a name
            same = lambda a, b: flat[a] == own[b] or slot(flat[a]) == (0 if (kind := self.kind(own[b])) == NAME else kind or -1)
            a, b = at, p
            while a and b and same(a - 1, b - 1):
                a, b = a - 1, b - 1
            n = 0
            while a + n < len(flat) and b + n < len(own) and same(a + n, b + n):
                n += 1
            ends[line] = a + n - 1
            fills: dict[str, set] = {}
            exact, x = 0, 0
            for equal, run in groupby(range(n), key=lambda i: flat[a + i] == own[b + i]):
                size = len(list(run))
                if equal:
                    exact = max(exact, self.covered(of, b + x, b + x + size))
                x += size
            for i in range(n):
                fills.setdefault(own[b + i], set()).add(flat[a + i])
            state = "equal" if all(v == {w} for w, v in fills.items()) else "consistent" if all(len(v) == 1 for v in fills.values()) else "different"
            found = [exact, self.covered(of, b, b + n), words, state]
            if k not in best or found[:2] > best[k][:2]:
                best[k] = found
        return [(self.known[k][0], *v) for k, v in best.items() if max(v[0], v[1] if v[3] != "different" else 0) >= self.needed(v[2])]

    @staticmethod
    def covered(of: list[int], a: int, b: int) -> int:
        """Whole words among tokens a..b-1."""
        if a >= b:
            return 0
        first = of[a] + (a > 0 and of[a - 1] == of[a])
        last = of[b - 1] - (b < len(of) and of[b] == of[b - 1])
        return max(0, last - first + 1)


SCHEMA = "doc_id string, id string, run_words int, template_words int, prompt_words int, slots string"


def leaked_prompts(
    documents: DataFrame, prompts: DataFrame, names: DataFrame | None = None, doc_col: str = "doc_id", text_col: str = "text", id_col: str = "id",
    prompt_col: str = "text", name_col: str = "given_name", least_words: int = LEAST_WORDS, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, id, run_words, template_words, prompt_words, slots) for each document and prompt that leaks into it.

    Method: template canonicalisation. A prompt's numbers, units and given names become typed slots; windows of `window`
    tokens of the templates are matched by hash; around each match the run is extended, in the template and word by
    word, and the slots are checked: "equal", "consistent" (a re-parameterised prompt: each value replaced by one other
    value throughout) or "different". run_words is the longest unbroken run of the prompt's very words, template_words
    that of its template. A prompt leaks where either reaches half of the prompt's words, and at least `window`; template
    runs count only with equal or consistent slots. Any word may stand in a name's place, any number in a number's.

    The prompts are a stated query set: they are held against all documents in blocks of about block_bytes, one pass a
    block, and documents stay where they are. A prompt is judged by its own words only, so blocks change no result.
    Defined cases: null and empty texts, and prompts under least_words words (split at white space), match nothing.
    Documents are compared whole. Repeated rows count once. Other columns are not read.
    """
    docs = documents.select(F.col(doc_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    asked = prompts.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).alias("prompt")).where("id is not null and prompt is not null").where(F.size(F.split(F.trim("prompt"), r"\s+")) >= least_words).distinct()
    size = asked.agg(F.sum(F.octet_length("prompt") + F.octet_length("id"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("id", "prompt"), F.lit(blocks))))
    out = None
    for k in range(blocks):
        some = asked.where(F.col("block") == k) if blocks > 1 else asked
        rows = [(r.id, r.prompt) for r in some.orderBy("id", "prompt").collect()]
        one = _leaked(docs, Prompts(rows, _given(rows, names, name_col, docs), least_words, window))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _given(rows: list[tuple[str, str]], names: DataFrame | None, name_col: str, docs: DataFrame) -> frozenset[str]:
    """The words of these prompts that are given names: only these leave the table of names, however large it is."""
    words = {t for _, text in rows for t in tokens(text)}
    if names is None or not words:
        return frozenset()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for x in batch.column(0).to_pylist() if x for t in tokens(x) if t in words], pa.string())], names=["word"])

    return frozenset(r[0] for r in names.select(F.col(name_col).cast("string")).mapInArrow(folded, "word string").distinct().collect())


def _leaked(docs: DataFrame, index: Prompts) -> DataFrame:
    """leaked_prompts for one block."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, flat = part.column(0).to_pylist(), [tokens(t) for t in part.column(1).to_pylist()]
                for d, hits in index.hits(flat):
                    out += [(ids[d], *m) for m in index.matches(flat[d], hits)]
            yield _batch(out)

    return docs.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = ("doc_id", "id", "run_words", "template_words", "prompt_words", "slots")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))

