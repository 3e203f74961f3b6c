"""Matching records of two sources that share no identifier, by regularised Gaussian mixtures.

Candidates are pairs in the same named file at most NEAR lines apart, found by an equi-join on file
name and line band.  A pair is a vector of similarities: lines, path from its end, function, affinity of
the rules, affinity of the weakness numbers, and shared names in the wording; an attribute that one side
lacks is left out of the pair's likelihood.  The affinities are learnt from the candidates themselves: how
often two rules meet where file and function agree, against how often each meets its best partner.

Two Gaussian components, matched and unmatched, with one block per attribute and a regularised variance,
are fitted by expectation-maximisation without labels.  After every expectation the transitivity
constraint is enforced: two right records that are different defects cannot both match the same left
record, so their posteriors may not add up to more than one; at the end the same holds from the right.

Repeated rows form classes first, so copies do not multiply candidates; the result is expanded to rows.
The vectors are exchanged once, so that the candidates of a left record lie together, and kept by the executors; a lost part is
computed again from the stored vectors.  A round reads them where they are and returns one row of sums per task.

Defined results: a row without file or line matches nothing; a missing rule, number, function or wording
is no evidence either way; repeated ids are reported once; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm import findings
from siftline.runtime import materialise

NEAR, BAND = 3, 8
TAIL = 3
EDITS = 3
REGULAR = 0.04
ROUNDS, CLOSE = 30, 1e-4
FEATURES = ("x_line", "x_path", "x_function", "x_rule", "x_cwe", "x_words")
PART_SCHEMA = "id long, base string, tail string, line int, kind string, cwe string, name string, words string"

_NAMES = re.compile(r"[a-z_][a-z0-9_]*")
_DIGITS = re.compile(r"\d+")
_PAIR = re.compile(r"\(([A-Za-z0-9_]+), ([A-Za-z0-9_]+)\)")
_QUOTED = re.compile(r"['`]([A-Za-z_][A-Za-z0-9_]*)['`]")


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, file, line, rule, cwe, text in zip(b["id"], b["file"], b["line"], b["rule_id"], b["cwe"], b["text"]):
            if pd.isna(line) or not isinstance(file, str):
                continue
            parts = findings.path_parts(file)
            if not parts:
                continue
            digits = _DIGITS.search(cwe) if isinstance(cwe, str) else None
            text = text if isinstance(text, str) else None
            pair = _PAIR.search(text or "")
            # the name of the value a finding speaks of, where the wording marks it
            words = pair.group(2) if pair else next((w for w in _QUOTED.findall(text or "") if findings.squeeze(w) != findings.function_of(text)), "")
            out.append((
                i, parts[-1], "/".join(parts[-TAIL:]), int(line), findings.kind_of(rule if isinstance(rule, str) else None),
                digits.group().lstrip("0") if digits else "", findings.function_of(text), findings.squeeze(words),
            ))
        if out:
            yield pd.DataFrame(out, columns=["id", "base", "tail", "line", "kind", "cwe", "name", "words"])


def parts(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Comparable attributes of a source's rows; blank where missing."""
    chosen = rows.select(
        F.col(id_column).cast("long").alias("id"), "file", F.col("line").cast("int").alias("line"), "rule_id", "cwe", F.col(text_column).alias("text")
    )
    return chosen.mapInPandas(_parts, PART_SCHEMA)


ATTRIBUTES = ("base", "tail", "line", "kind", "cwe", "name", "words")


def classes(of: DataFrame, path: str) -> DataFrame:
    """One row per distinct attributes, numbered; written, so that the numbers stay."""
    return materialise(of.select(*ATTRIBUTES).distinct().withColumn("c", F.monotonically_increasing_id()), path)


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    band = lambda x: F.floor(x / BAND).cast("int")
    a = left.select(*[F.col(x).alias(f"a_{x}") for x in ("c", *ATTRIBUTES)]).withColumn(
        "band", F.explode(F.array_distinct(F.array(band(F.col("a_line") - NEAR), band(F.col("a_line") + NEAR))))
    )
    b = right.select(*[F.col(x).alias(f"b_{x}") for x in ("c", *ATTRIBUTES)]).withColumn("band", band(F.col("b_line")))
    return a.join(b, (F.col("a_base") == F.col("b_base")) & (a["band"] == b["band"])).where(
        F.abs(F.col("a_line") - F.col("b_line")) <= NEAR
    ).drop("band")


def _tail_share(a, b):
    """Share of the shorter path's last TAIL segments that both paths end with."""
    x, y = F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/"))
    n = F.least(F.size(x), F.size(y))
    same = F.lit(0)
    for i in reversed(range(TAIL)):
        same = F.when((F.lit(i) < n) & (F.get(x, F.lit(i)) == F.get(y, F.lit(i))), 1 + same).otherwise(0)
    return same / n


def affinities(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(a, b, score): how often two values meet where file and function agree, against each one's best partner; 1 for partners."""
    met = pairs.where("x_path = 1 and x_function > 0.8").where((F.col(a) != "") & (F.col(b) != "")).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    best = lambda c: F.max("n").over(W.partitionBy(c))  # noqa: E731  one row per pair of values
    return met.withColumn(score, F.col("n") / F.sqrt(best(a) * best(b))).select(a, b, score)


def vectors(pairs: DataFrame) -> DataFrame:
    """Candidate pairs with their similarities, null where a side lacks the attribute."""
    longest = F.greatest(F.length("a_name"), F.length("b_name"))
    both = lambda x: (F.col(f"a_{x}") != "") & (F.col(f"b_{x}") != "")
    p = pairs.withColumns({
        "x_line": 1 - F.abs(F.col("a_line") - F.col("b_line")) / (NEAR + 1),
        "x_path": _tail_share(F.col("a_tail"), F.col("b_tail")),
        "x_function": F.when(both("name"), 1 - F.levenshtein("a_name", "b_name") / longest),
        "x_words": F.when(both("words"), F.when(F.col("a_words") == F.col("b_words"), 1.0).otherwise(0.0)),
    })
    rules, cwes = affinities(p, "a_kind", "b_kind", "x_rule"), affinities(p, "a_cwe", "b_cwe", "x_cwe")
    p = p.join(rules, ["a_kind", "b_kind"], "left").join(cwes, ["a_cwe", "b_cwe"], "left")
    return p.withColumns({
        "x_rule": F.when(both("kind"), F.coalesce("x_rule", F.lit(0.0))),
        "x_cwe": F.when(both("cwe"), F.coalesce("x_cwe", F.lit(0.0))),
    }).select("a_c", "b_c", F.xxhash64("b_kind", "b_name").alias("b_thing"), F.xxhash64("a_kind", "a_name").alias("a_thing"), *FEATURES)


class Mixture:
    """Matched (1) and unmatched (0) Gaussians with a diagonal of attribute blocks."""

    def __init__(self):
        k = len(FEATURES)
        self.share = 0.4
        self.mean = np.array([np.full(k, 0.3), np.full(k, 0.9)])
        self.var = np.full((2, k), 0.1)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(x)
        log = []
        for j, prior in ((0, 1 - self.share), (1, self.share)):
            d = -0.5 * ((x - self.mean[j]) ** 2 / self.var[j] + np.log(self.var[j]))
            log.append(np.log(prior) + np.where(seen, d, 0.0).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def transitive(gamma: np.ndarray, owner: np.ndarray, thing: np.ndarray) -> np.ndarray:
    """Cap posteriors of an owner's other things at what its best thing leaves; rows come sorted by owner and thing."""
    if not len(gamma):
        return gamma
    new_owner = np.ones(len(owner), dtype=bool)
    new_owner[1:] = owner[1:] != owner[:-1]
    new_thing = new_owner.copy()
    new_thing[1:] |= thing[1:] != thing[:-1]
    group = np.cumsum(new_thing) - 1
    best = np.maximum.reduceat(gamma, np.flatnonzero(new_thing))
    of = (np.cumsum(new_owner) - 1)[new_thing]  # the owner of each thing
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    top = np.maximum.reduceat(best, first)
    # of equally good things the first is the best
    at = np.where(best == top[of], np.arange(len(best)), len(best))
    own = np.minimum.reduceat(at, first)
    return np.where(group == own[of][group], gamma, np.minimum(gamma, 1 - top[of][group]))


def _whole_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut so that no owner's candidates are split; rows come sorted by owner, the first column."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        owner = t.column(0).to_numpy()
        cut = int(np.searchsorted(owner, owner[-1], "left")) if len(owner) else 0
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if held is not None and len(held):
        yield held


def _vectors_of(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(f).to_numpy() for f in FEATURES], axis=1).astype(float)


def _sums(model: Mixture):
    k = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((2, k, 3))
        matched = 0.0
        for t in _whole_owners(batches):
            x = _vectors_of(t)
            g = transitive(model.posterior(x), t.column(0).to_numpy(), t.column(1).to_numpy())
            n, matched = n + len(t), matched + g.sum()
            seen, filled = ~np.isnan(x), np.nan_to_num(x)
            for j, w in ((0, 1 - g), (1, g)):
                total[j] += np.stack([(w[:, None] * seen).sum(0), (w[:, None] * filled).sum(0), (w[:, None] * filled**2).sum(0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([float(matched)]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "matched", "sums"])

    return run


POSTERIORS = "a_c long, b_c long, a_thing long, x_path double, x_function double, confidence double"


def _posteriors(model: Mixture):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_owners(batches):
            g = transitive(model.posterior(_vectors_of(t)), t.column(0).to_numpy(), t.column(1).to_numpy())
            out = t.select(["a_c", "b_c", "a_thing", "x_path", "x_function"]).append_column("confidence", pa.array(g))
            yield from out.combine_chunks().to_batches()

    return run


def fit(table: DataFrame, rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximisation over (a_c, b_thing, features), partitioned by a_c and sorted by both."""
    model, k = Mixture(), len(FEATURES)
    for _ in range(rounds):
        rows = table.select("a_c", "b_thing", *FEATURES).mapInArrow(_sums(model), "n double, matched double, sums array<double>")
        rows = rows.select("n", "matched", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("matched").alias("m")).collect()
        if not rows or not rows[0]["n"]:
            break
        sums = np.zeros(2 * k * 3)
        for r in rows:
            sums[r["i"]] = r["s"]
        weight, first, second = np.moveaxis(sums.reshape(2, k, 3), 2, 0)
        new = Mixture()
        new.share = float(np.clip(rows[0]["m"] / rows[0]["n"], 1e-4, 1 - 1e-4))
        new.mean = (first + 0.5) / (weight + 1.0)
        new.var = np.maximum(second / np.maximum(weight, 1e-9) - (first / np.maximum(weight, 1e-9)) ** 2, 0) + REGULAR
        moved = np.abs(new.mean - model.mean).max()
        model = new
        if moved < CLOSE:
            break
    return model


def posteriors(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """(a_c, b_c, x_path, x_function, confidence) of all candidate pairs of classes, under both transitivity constraints; written."""
    pairs = materialise(candidates(left, right), f"{path}/pairs")
    stored = materialise(vectors(pairs), f"{path}/vectors")
    table = stored.repartition("a_c").sortWithinPartitions("a_c", "b_thing").select("a_c", "b_thing", "b_c", "a_thing", *FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    model = fit(table)
    found = table.mapInArrow(_posteriors(model), POSTERIORS)
    # the constraint from the right: the best thing of the left per right class; both windows need one exchange
    found = found.repartition("b_c").withColumn("best", F.max("confidence").over(W.partitionBy("b_c", "a_thing")))
    found = found.withColumn("top", F.max(F.struct("best", "a_thing")).over(W.partitionBy("b_c")))
    own = F.col("top.a_thing") == F.col("a_thing")
    found = found.withColumn("confidence", F.when(own, F.col("confidence")).otherwise(F.least("confidence", 1 - F.col("top.best"))))
    found = materialise(found.select("a_c", "b_c", "x_path", "x_function", "confidence"), f"{path}/posteriors")
    table.unpersist()
    return found


#: The exact check that follows the mixture: same path from its end, and the same function where both name one.
SAME_PLACE = "x_path = 1 and (x_function is null or x_function >= 0.7)"


def matches(left: DataFrame, right: DataFrame, path: str, check: str = SAME_PLACE) -> DataFrame:
    """(left_id, right_id, confidence) of matched rows; both frames as made by ``parts``."""
    left, right = materialise(left, f"{path}/left"), materialise(right, f"{path}/right")
    lc, rc = classes(left, f"{path}/left-classes"), classes(right, f"{path}/right-classes")
    sure = posteriors(lc, rc, path).where("confidence >= 0.5").where(check)
    of_left = left.join(lc, list(ATTRIBUTES)).select(F.col("id").alias("left_id"), F.col("c").alias("a_c"))
    of_right = right.join(rc, list(ATTRIBUTES)).select(F.col("id").alias("right_id"), F.col("c").alias("b_c"))
    rows = sure.select("a_c", "b_c", "confidence").join(of_left, "a_c").join(of_right, "b_c")
    return rows.groupBy("left_id", "right_id").agg(F.max("confidence").alias("confidence"))
