"""Thousands of line rules in one pass over the text.

Every rule names words of which each of its matches contains one.  The words of all rules form one automaton (one more for
rules without regard to case), so a batch of lines is searched once whatever the number of rules; only a rule whose word occurs
in a line is tried on it.  Rules that name no word of at least LEAST characters are tried on every line.

The rules go to the executors once (they are configuration, bounded by the packs that are loaded); lines stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.scan import LANGUAGES, Rule, fold, required_literals

LEAST = 3


class Matcher:
    """The compiled rules of a worker; a pattern is compiled when its word first occurs."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.patterns: list[re.Pattern | None] = [None] * len(rules)
        self.always: list[int] = []
        words: dict[bool, dict[str, list[int]]] = {False: {}, True: {}}
        for i, r in enumerate(rules):
            folded, some = required_literals(r.pattern, r.ignore_case)
            if r.needs:
                folded, some = False, frozenset([r.needs])
            if not some or min(map(len, some)) < LEAST:
                self.always.append(i)
            for w in some if some and min(map(len, some)) >= LEAST else ():
                words[folded].setdefault(w, []).append(i)
        self.of_word = {k: list(v.values()) for k, v in words.items()}
        self.automata = {k: self._automaton(list(v)) for k, v in words.items() if v}
        self.scopes = [frozenset(e for e, n in LANGUAGES.items() if e in r.languages or n in r.languages) | frozenset(r.languages) if r.languages else None for r in rules]

    @staticmethod
    def _automaton(words: list[str]):
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, w in enumerate(words):
            a.add_word(w, i)
        a.make_automaton()
        return a

    def _concerns(self, i: int, file: str | None, ext: str) -> bool:
        r = self.rules[i]
        if self.scopes[i] is not None and ext not in self.scopes[i]:
            return False
        return not any(p in (file or "") for p in r.skips) and (not r.paths or any(p in (file or "") for p in r.paths))

    def _matches(self, i: int, text: str) -> bool:
        p = self.patterns[i]
        if p is None:
            p = self.patterns[i] = re.compile(self.rules[i].regex())
        return p.search(text) is not None

    def hits(self, texts: list[str], files: list[str | None] | None) -> tuple[list[int], list[int]]:
        """(line, rule) numbers of all hits, in order of lines."""
        found: set[tuple[int, int]] = set()
        exts = [(f or "").rpartition(".")[2].lower() for f in files] if files else [""] * len(texts)
        for folded, automaton in self.automata.items():
            some = [fold(t) for t in texts] if folded else texts
            ends, words = [], []
            for end, word in automaton.iter("\n".join(some)):
                ends.append(end)
                words.append(word)
            if not ends:
                continue
            starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in some])[:-1]])
            line = np.searchsorted(starts, np.array(ends), "right") - 1
            pairs = np.unique(line * len(self.of_word[folded]) + np.array(words))
            for at, word in zip((pairs // len(self.of_word[folded])).tolist(), (pairs % len(self.of_word[folded])).tolist()):
                for i in self.of_word[folded][word]:
                    if self._concerns(i, files[at] if files else None, exts[at]) and (at, i) not in found and self._matches(i, texts[at]):
                        found.add((at, i))
        for i in self.always:
            for at, text in enumerate(texts):
                if self._concerns(i, files[at] if files else None, exts[at]) and self._matches(i, text):
                    found.add((at, i))
        order = sorted(found)
        return [a for a, _ in order], [b for _, b in order]


_KEPT: dict[int, Matcher] = {}


def many_hits(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per line and rule that matches it, with rule_id, severity and confidence; one narrow pass."""
    shared = lines.sparkSession.sparkContext.broadcast(rules)
    key = hash(tuple(rules))
    names = lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _KEPT.get(key)
        if matcher is None:
            _KEPT.clear()
            matcher = _KEPT[key] = Matcher(shared.value)
        ids, severities = pa.array([r.rule_id for r in matcher.rules]), pa.array([r.severity for r in matcher.rules])
        confidences = pa.array([r.confidence for r in matcher.rules], pa.float64())
        for batch in batches:
            texts = [t or "" for t in batch.column(names.index("text")).to_pylist()]
            files = batch.column(names.index("file")).to_pylist() if "file" in names else None
            at, of = matcher.hits(texts, files)
            if at:
                rows, of = batch.take(pa.array(at)), pa.array(of)
                yield pa.RecordBatch.from_arrays([*rows.columns, ids.take(of), severities.take(of), confidences.take(of)], names=[*names, "rule_id", "severity", "confidence"])

    types = ", ".join(f"`{n}` {t}" for n, t in lines.dtypes)
    return lines.where(F.col("text").isNotNull()).mapInArrow(run, f"{types}, rule_id string, severity string, confidence double")
