"""Language of documents and of their parts by prediction by partial matching.

For every language a tree of byte contexts of up to ORDER bytes is counted on a bounded sample of
labelled documents and then frozen.  The code length of a byte is that of its longest known context,
with the escape of every longer context that did not know it (method C, without exclusion).  The trees
of all languages are kept as sorted arrays of context-and-byte with one resolved code length per language,
so a batch of sentences is scored by binary searches over all its bytes at once.

Labels are partly wrong, so the sample cleans itself: its sentences are scored under the first trees, each
goes to the language that codes it shortest, and the trees are counted again.

A text is cut into sentences; comment and quotation marks before a line are no part of it, pieces of lines that
are code or logs are none (finished sentences before and after them and in comments behind code are), and names,
paths and numbers inside a sentence are left out of the score.  A sentence that no language explains is in none of them (``other``,
confidence 0).  Otherwise a sentence's confidence is its language's share of 2^-bits.  Neighbouring sentences of one language make a segment.

The sample is at most SAMPLE documents of at most SAMPLE_CHARS characters per language, chosen by a hash of
doc_id; everything else runs over all texts, whole, without a shuffle.

Defined results: null, empty and sentence-free texts have no segments; a null, unknown or blank label
names no language; a label may name several, separated by commas, slashes or plus signs; documents are
reported unless their label names exactly the languages found; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = 4
SAMPLE, SAMPLE_CHARS = 300, 20_000
CLEANINGS = 2
SURE = 0.9
#: Bits a byte from which even the best language explains a sentence hardly better than no model does (8 bits); known languages stay far below.
STRANGE = 6.5
OTHER = "other"
LEAST_WORDS = 3
KEPT_SENTENCES = 200_000

#: The languages with their three-letter codes and English names.
LANGUAGES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"), "nl": ("nld", "dut", "dutch"),
}
NAMES = {n: k for k, ns in LANGUAGES.items() for n in (k, *ns)}

_SEPARATORS = re.compile(r"[,;/+&]|\band\b")
_END = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+")
_CODE = re.compile(r"[={}]|\S\t\S|^\d{4}-\d\d-\d\d|^\[\w+\]|;$")
#: Inside a line a log begins with a time or a bracket after a stop; a date or a bracket may as well begin a sentence.
_INSIDE = re.compile(r"[={}]|\S\t\S|^\d{4}-\d\d-\d\dT|;$")
_TAIL = re.compile(r"\s\d{4}-\d\d-\d\dT\d\d:|[.!?…]\s+\[\w+\]")
_PIECES = re.compile(_END.pattern + r"|\s+(?=\d{4}-\d\d-\d\dT\d\d:)")
_COMMENT = re.compile(r"\s(?:#+|//+|/?\*+|--+)\s+")
_EDGE = "\"'`“”„«»().,:;!?…*"
_WORDS = re.compile(rf"(?<!\S)[{re.escape(_EDGE)}]*([^\W\d_]+(?:['’-][^\W\d_]+)*)[{re.escape(_EDGE)}]*(?!\S)")
_CLOSING, _STOPS, _BEFORE_STOP = "\"'”»)", ".!?…", ")\"'”»`_"
_LEAD = " \t>#*-/|+•"


def languages_of(label: str | None) -> frozenset[str]:
    """The languages a label names; a part that names none of the known ones is kept as it is, an empty label names none."""
    out = set()
    for part in _SEPARATORS.split((label or "").lower()):
        code = re.split(r"[-_ ]", part.strip())[0]
        if code:
            out.add(NAMES.get(part.strip(), NAMES.get(code, code)))
    return frozenset(out)


def finished(text: str) -> bool:
    """Whether a text ends as a sentence does: a word or closing mark, perhaps a blank, a stop, perhaps closing marks."""
    t = text.rstrip(_CLOSING)
    if t[-1:] not in _STOPS or not t:
        return False
    before = t[:-2] if t[-2:-1] == " " else t[:-1]
    return before[-1:].isalnum() or (before != "" and before[-1] in _BEFORE_STOP)


def masked(sentence: str) -> str:
    """The plain words of a sentence, lower case, single blanks; names, paths and numbers are left out."""
    return " ".join([w for w in _WORDS.findall(sentence) if w[1:].islower() or w.islower() or w.isupper()]).lower()


def sentences(text: str | None) -> list[str]:
    """The masked whole sentences of a text, in order."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "Ã" in text or "Â" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    out, held = [], []

    def close() -> None:
        if held:
            for s in _END.split(" ".join(held)):
                if finished(s):
                    m = masked(s if s.isascii() else unicodedata.normalize("NFC", s))
                    if m.count(" ") >= LEAST_WORDS - 1:
                        out.append(m)
            held.clear()

    def take(line: str) -> None:
        whole = finished(line)
        if whole or held or masked(line).count(" ") >= LEAST_WORDS - 1:
            held.append(line)
            if whole:
                close()

    for line in text.splitlines():
        line = line.strip().lstrip(_LEAD)
        if not line:
            close()
        elif not _CODE.search(line) and not (("[" in line or ":" in line and "-" in line) and _TAIL.search(line)):
            take(line)
        else:
            for i, piece in enumerate(_PIECES.split(line)):
                code = (_INSIDE if i else _CODE).search(piece) or (i and piece[:1] == "[" and not finished(piece))
                if not code:
                    take(piece)
                    continue
                close()
                comment = _COMMENT.split(piece)[-1]
                if comment != piece and not _CODE.search(comment):
                    take(comment)
    close()
    return out


class ContextTrees:
    """Frozen context trees of several languages."""

    def __init__(self, corpora: dict[str, list[str]]):
        self.names = sorted(k for k, v in corpora.items() if v)
        texts = {k: np.frombuffer(("\n".join(corpora[k]) + "\n").encode(), dtype=np.uint8) for k in self.names}
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        n = len(self.names)
        below_keys, below = np.empty(0, dtype=np.uint64), np.empty((0, n))
        for k in range(ORDER + 1):
            counted = [np.unique(self._windows(texts[x], k + 1), return_counts=True) for x in self.names]
            grams = np.unique(np.concatenate([g for g, _ in counted])) if n else np.empty(0, dtype=np.uint64)
            shift, mask = np.uint64(8), np.uint64((1 << (8 * k)) - 1)
            contexts = np.unique(grams >> shift)
            escape = np.zeros((len(contexts), n))
            # the code length in the shorter context; 8 bits where no context knows the byte
            cost = np.full((len(grams), n), 8.0)
            if k:
                cost = below[np.searchsorted(below_keys, grams & mask)].copy()
            for j, (g, c) in enumerate(counted):
                where = np.searchsorted(contexts, g >> shift)
                total, kinds = np.bincount(where, c, len(contexts)), np.bincount(where, minlength=len(contexts))
                known = total > 0
                escape[known, j] = -np.log2(kinds[known] / (total[known] + kinds[known]))
                at = np.searchsorted(grams, g)
                cost[:, j] += escape[np.searchsorted(contexts, grams >> shift), j]
                cost[at, j] = -np.log2(c / (total[where] + kinds[where]))
            self.grams.append(grams)
            self.costs.append(cost.astype(np.float32))
            self.contexts.append(contexts)
            self.escapes.append(escape.astype(np.float32))
            below_keys, below = grams, cost

    @staticmethod
    def _windows(data: np.ndarray, n: int) -> np.ndarray:
        wide = data.astype(np.uint64)
        out = np.zeros(max(0, len(wide) - n + 1), dtype=np.uint64)
        for j in range(n):
            out = (out << np.uint64(8)) | wide[j : j + len(out)]
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """[text, language]: code length of each text."""
        n = len(self.names)
        # ORDER line ends before each text are its first contexts and are not coded
        bodies = [b"\n" * ORDER + t.encode() for t in texts]
        sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        if not len(sizes) or not n:
            return np.zeros((len(texts), n))
        data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        grams = self._windows(data, ORDER + 1)
        owner = np.repeat(np.arange(len(texts)), sizes)[ORDER:]
        real = np.arange(ORDER, len(data)) - starts[owner] >= ORDER
        # texts repeat few contexts, so each is resolved once
        grams, back = np.unique(grams[real], return_inverse=True)
        cost = np.zeros((len(grams), n), dtype=np.float32)
        open_at = np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            g = grams[open_at] & np.uint64((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(self.grams[k], g), len(self.grams[k]) - 1)
            known = self.grams[k][at] == g
            cost[open_at[known]] += self.costs[k][at[known]]
            open_at, g = open_at[~known], g[~known]
            if not len(open_at):
                break
            c = g >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], c), len(self.contexts[k]) - 1)
            seen = self.contexts[k][at] == c
            cost[open_at[seen]] += self.escapes[k][at[seen]]
        cost[open_at] += 8.0
        out, lengths = np.zeros((len(texts), n)), sizes - ORDER
        some = lengths > 0
        if some.any():
            ends = np.cumsum(lengths[some])
            out[some] = np.add.reduceat(cost[back].astype(np.float64), ends - lengths[some], axis=0)
        return out

    def classify(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, confidence) of each text."""
        if not self.names:
            return [("", 0.0)] * len(texts)
        bits = self.bits(texts)
        p = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -500))
        p /= p.sum(axis=1, keepdims=True)
        best = bits.argmin(axis=1)
        strange = bits.min(axis=1) > STRANGE * np.array([max(1, len(t.encode())) for t in texts])
        return [(OTHER, 0.0) if strange[i] else (self.names[b], float(p[i, b])) for i, b in enumerate(best)]


def label_language(label: Column) -> Column:
    """The one known language a label names, else null, as a column expression."""
    t = F.lower(F.btrim(label))
    code = F.regexp_extract(t, r"^([a-z]+)", 1)
    out = F.lit(None).cast("string")
    for name, k in NAMES.items():
        out = F.when((code == name) & ~t.rlike(r"[,;/+&]"), k).otherwise(out)
    return out


def train(docs: DataFrame, sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> ContextTrees:
    """Trees from at most ``sample`` labelled documents per language."""
    ids = docs.where(F.col("text").isNotNull() & (F.length("text") <= most_chars) & (F.length("text") > 0)).select(
        "doc_id", label_language(F.col("lang")).alias("language"), F.xxhash64("doc_id").alias("h")
    ).where("language is not null")
    first = ids.withColumn("n", F.row_number().over(W.partitionBy("language").orderBy("h", "doc_id"))).where(F.col("n") <= sample)
    chosen = F.broadcast(first.select("doc_id", "language"))  # at most `sample` rows per language
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("language", "text").collect()
    corpora: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["language"], r["text"])):
        corpora.setdefault(r["language"], []).extend(sentences(r["text"]))
    trees = ContextTrees(corpora)
    every = [s for v in corpora.values() for s in v]
    for _ in range(CLEANINGS if every else 0):
        cleaned: dict[str, list[str]] = {}
        for s, (k, p) in zip(every, trees.classify(every)):
            if p >= SURE:
                cleaned.setdefault(k, []).append(s)
        trees = ContextTrees(cleaned)
    return trees


@functools.lru_cache(maxsize=65536)
def _named(label: str | None) -> list[str]:
    return sorted(languages_of(label))


SEGMENTS = "array<struct<lang string, confidence double, sentences int, chars int>>"


def _segments_of(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: ContextTrees = shared.value
        known: dict[str, tuple[str, float]] = {}
        for b in batches:
            parts = [sentences(t) if isinstance(t, str) else [] for t in b["text"]]
            new = list({s for p in parts for s in p} - known.keys())
            if len(known) + len(new) > KEPT_SENTENCES:
                known, new = {}, list({s for p in parts for s in p})
            for i in range(0, len(new), 5000):
                known.update(zip(new[i : i + 5000], trees.classify(new[i : i + 5000])))
            out = []
            for p in parts:
                segments: list[list] = []
                for s in p:
                    k, sure = known[s]
                    if segments and segments[-1][0] == k:
                        g = segments[-1]
                        g[1], g[2], g[3] = g[1] + sure * len(s), g[2] + 1, g[3] + len(s)
                    else:
                        segments.append([k, sure * len(s), 1, len(s)])
                out.append([{"lang": k, "confidence": c / n, "sentences": m, "chars": n} for k, c, m, n in segments])
            yield b.drop(columns="text").assign(named=[_named(x if isinstance(x, str) else None) for x in b["lang"]], segments=out)

    return run


def segments(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """(doc_id, lang, named, segments): every document with its label, the languages that names, and its segments in order; texts are read once."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample
    return docs.select("doc_id", "lang", "text").mapInPandas(_segments_of(shared), f"doc_id long, lang string, named array<string>, segments {SEGMENTS}")


def found_languages(of_segments: DataFrame) -> DataFrame:
    """(doc_id, label, named, langs, confidence): the languages in which a document has sure whole sentences."""
    sure = F.filter("segments", lambda s: s["confidence"] >= SURE)
    chars = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["chars"])
    weighed = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["chars"] * s["confidence"])
    return of_segments.select(
        "doc_id", F.col("lang").alias("label"), "named", F.array_sort(F.array_distinct(F.transform(sure, lambda s: s["lang"]))).alias("langs"),
        F.try_divide(weighed, chars).alias("confidence"),
    )


def mislabelled(found: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of documents whose label does not name exactly them."""
    return found.where((F.size("langs") > 0) & (F.col("named") != F.col("langs"))).select("doc_id", F.explode("langs").alias("lang"))
