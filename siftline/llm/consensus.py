"""Consensus of several annotators by a competence-and-spamming mixture.

A label is either truthful (with the annotator's competence) or drawn from the annotator's personal
guess distribution.  Expectation-maximisation over all items gives the posterior of every item's true
label, and each annotator's competence and guesses.

The labels are stored once, one row per item with its annotators and labels.  A round reads them and
sums expected counts per annotator within each task (vectorised over the batch), so a round moves
one row per annotator and task, and an annotator with most of the labels is only a larger number.  The rounds are
accelerated by squared extrapolation: two rounds tell how the parameters move, a step along that goes further, and
the next round sets right whatever it overshot.

The parameters, a few numbers per annotator, go to the driver where there are at most MOST_ANNOTATORS of them.  Beyond that
number they stay a table that is joined to the labels in every round, with the same results.

Defined results: of the labels of an annotator on an item the one with the latest time counts (a null
time is the earliest), of equal times the one with the greatest entry_id; entries without a verdict,
item or annotator count for nothing; of equally likely labels the first of tp, fp, fn is taken; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.keys import key_of, squeezed
from siftline.operators.skew import hot_keys, salted_join
from siftline.runtime import materialise, shuffle_partitions

#: The labels and their long spellings.
LABELS = ("tp", "fp", "fn")
LONG = {"tp": "truepositive", "fp": "falsepositive", "fn": "falsenegative"}
MOST_ANNOTATORS = 200_000
ROUNDS, CLOSE = 40, 1e-4
#: Weight of the priors: pseudo-labels of each kind.
PRIOR_TRUTHFUL, PRIOR_SPAM, PRIOR_GUESS, PRIOR_CLASS = 2.0, 1.0, 0.5, 1.0


def label_of(c: Column) -> Column:
    """Number of the label, null when the entry holds no verdict."""
    s = squeezed(c)
    out = F.lit(None).cast("int")
    for i, name in enumerate(LABELS):
        out = F.when(s.isin(name, LONG[name]), i).otherwise(out)
    return out


def latest_labels(entries: DataFrame) -> DataFrame:
    """(item, annotator, label): each annotator's latest verdict on each item."""
    rows = entries.select(
        key_of(F.col("finding_key")).alias("item"), key_of(F.col("labeler")).alias("annotator"),
        label_of(F.col("kind")).alias("label"), F.col("labeled_at").alias("at"), F.col("entry_id").alias("id"),
    ).where("item is not null and annotator is not null and label is not null")
    return rows.groupBy("item", "annotator").agg(F.max(F.struct("at", "id", "label")).alias("r")).select("item", "annotator", "r.label")


class Annotators:
    """Parameters: competence and guess distribution per annotator, and the share of every label."""

    def __init__(self, names: list[str]):
        k = len(LABELS)
        self.names = names
        self.competence = np.full(len(names), 0.7)
        self.guess = np.full((len(names), k), 1.0 / k)
        self.share = np.full(k, 1.0 / k)

    def likelihood(self) -> np.ndarray:
        """[annotator, label given, true label]"""
        k = len(LABELS)
        return self.competence[:, None, None] * np.eye(k)[None] + (1 - self.competence)[:, None, None] * self.guess[:, :, None]

    def _vector(self) -> np.ndarray:
        """Unbounded numbers: log-odds of competence, logarithms of the distributions."""
        c = np.clip(self.competence, 1e-9, 1 - 1e-9)
        return np.concatenate([np.log(c / (1 - c)), np.log(self.guess).ravel(), np.log(self.share)])

    def beyond(self, start: Annotators, one: Annotators) -> Annotators:
        """Where the way from ``start`` over ``one`` to these parameters leads, by squared extrapolation."""
        a, b, c = start._vector(), one._vector(), self._vector()
        r, v = b - a, (c - b) - (b - a)
        length = min(-1.0, -np.linalg.norm(r) / max(np.linalg.norm(v), 1e-12))
        x = a - 2 * length * r + length**2 * v
        m, k = len(self.names), len(LABELS)
        out = Annotators(self.names)
        out.competence = 1 / (1 + np.exp(-np.clip(x[:m], -30, 30)))
        shares = lambda y: np.exp(y - y.max(axis=-1, keepdims=True)) / np.exp(y - y.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True)
        out.guess, out.share = shares(np.clip(x[m:-k], -60, 0).reshape(m, k)), shares(np.clip(x[-k:], -60, 0))
        return out


def _posteriors(params: Annotators, starts: np.ndarray, who: np.ndarray, label: np.ndarray) -> np.ndarray:
    """[item, label] of items whose labels begin at ``starts``."""
    log = np.log(params.share) + np.add.reduceat(np.log(params.likelihood() + 1e-300)[who, label], starts, axis=0)
    log -= log.max(axis=1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(axis=1, keepdims=True)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item of each label, where each item begins, annotator, label) of rows that have labels, from the last two columns."""
    who, label = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    sizes = who.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), starts, who.flatten().to_numpy().astype(np.int64), label.flatten().to_numpy().astype(np.int64)


def _expected(params: Annotators):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, m = len(LABELS), len(params.names)
        truthful, spam, share = np.zeros(m), np.zeros((m, k)), np.zeros(k)
        for batch in batches:
            if not len(batch):
                continue
            item, starts, who, label = _flat(batch)
            post = _posteriors(params, starts, who, label)
            share += post.sum(axis=0)
            told = params.competence[who] / (params.competence[who] + (1 - params.competence[who]) * params.guess[who, label] + 1e-300)
            honest = post[item, label] * told
            truthful += np.bincount(who, honest, m)
            spam += np.bincount(who * k + label, 1 - honest, m * k).reshape(m, k)
        seen = np.flatnonzero(truthful + spam.sum(axis=1))
        columns = [np.append(seen, -1), np.append(truthful[seen], 0.0), *(np.append(spam[seen, i], share[i]) for i in range(k))]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:])], names=["who", "truthful", *(f"s{i}" for i in range(k))])

    return sums


ANSWERS = "item string, kind string, confidence double, labels int, agreement double, pair_agreement double"


def _answers(params: Annotators):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            item, starts, who, label = _flat(batch)
            n, k = len(batch), len(LABELS)
            post = _posteriors(params, starts, who, label)
            best = post.argmax(axis=1)
            sizes = np.bincount(item, minlength=n)
            agree = np.bincount(item, weights=(label == best[item]).astype(float), minlength=n)
            votes = np.bincount(item * k + label, minlength=n * k).reshape(n, k)
            pairs = np.where(sizes > 1, (votes * (votes - 1)).sum(axis=1) / np.maximum(sizes * (sizes - 1), 1), np.nan)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(LABELS)[best]), pa.array(post.max(axis=1)), pa.array(sizes, pa.int32()), pa.array(agree / sizes), pa.array(pairs)],
                names=["item", "kind", "confidence", "labels", "agreement", "pair_agreement"],
            )

    return answer


def _updated(truthful, spam, k: int):
    """(competence, guesses) from expected counts, numbers or columns."""
    total = sum(spam[1:], spam[0])
    return (truthful + PRIOR_TRUTHFUL) / (truthful + total + PRIOR_TRUTHFUL + PRIOR_SPAM), [(c + PRIOR_GUESS) / (total + k * PRIOR_GUESS) for c in spam]


class JoinedRounds:
    """The same rounds with the parameters as a table (annotator, competence, g0, g1, g2), for any number of annotators."""

    def __init__(self, labels: DataFrame, path: str):
        self.labels, self.path, self.round = labels, path, 0
        counts = labels.groupBy("annotator").agg(F.count(F.lit(1)).alias("labels"))
        self.hot = hot_keys(counts, "annotator", "labels")
        k = len(LABELS)
        self.share = [1.0 / k] * k
        self.params = materialise(counts.select("annotator", "labels", F.lit(0.7).alias("competence"), *[F.lit(1.0 / k).alias(f"g{i}") for i in range(k)]), f"{path}/params-0")

    def _told(self) -> DataFrame:
        """Labels with the chance that each was truthful if it is right, and the log-likelihood of every true label."""
        p = salted_join(self.labels, self.params.drop("labels"), "annotator", self.hot, F.xxhash64("item"), "inner")
        guess = F.get(F.array(*[F.col(f"g{i}") for i in range(len(LABELS))]), F.col("label"))
        luck = (1 - F.col("competence")) * guess
        p = p.withColumn("told", F.col("competence") / (F.col("competence") + luck + 1e-300))
        return p.withColumns({f"l{i}": F.log(F.when(F.col("label") == i, F.col("competence")).otherwise(0.0) + luck + 1e-300) for i in range(len(LABELS))})

    def _posteriors(self, told: DataFrame) -> DataFrame:
        k = range(len(LABELS))
        sums = told.groupBy("item").agg(*[(F.sum(f"l{i}") + float(np.log(self.share[i]))).alias(f"l{i}") for i in k], *[F.count_if(F.col("label") == i).alias(f"v{i}") for i in k])
        top = F.greatest(*[F.col(f"l{i}") for i in k])
        sums = sums.withColumns({f"e{i}": F.exp(F.col(f"l{i}") - top) for i in k})
        return sums.select("item", *[(F.col(f"e{i}") / sum((F.col(f"e{j}") for j in k), F.lit(0.0))).alias(f"p{i}") for i in k], *[f"v{i}" for i in k])

    def step(self) -> float:
        """One round; returns how far the competences moved at most."""
        k = range(len(LABELS))
        told = self._told()
        post = materialise(self._posteriors(told), f"{self.path}/posteriors-{self.round}")
        total = post.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in k]).first()
        self.share = [((total[f"p{i}"] or 0.0) + PRIOR_CLASS) / (total["n"] + len(LABELS) * PRIOR_CLASS) for i in k]
        honest = F.get(F.array(*[F.col(f"p{i}") for i in k]), F.col("label")) * F.col("told")
        counts = told.select("item", "annotator", "label", "told").join(post, "item").withColumn("honest", honest).groupBy("annotator").agg(
            F.count(F.lit(1)).alias("labels"), F.sum("honest").alias("truthful"), *[F.sum(F.when(F.col("label") == i, 1 - F.col("honest")).otherwise(0.0)).alias(f"s{i}") for i in k]
        )
        competence, guesses = _updated(F.col("truthful"), [F.col(f"s{i}") for i in k], len(LABELS))
        self.round += 1
        new = materialise(counts.select("annotator", "labels", competence.alias("competence"), *[g.alias(f"g{i}") for i, g in zip(k, guesses)]), f"{self.path}/params-{self.round}")
        moved = new.select("annotator", F.col("competence").alias("now")).join(self.params, "annotator").agg(F.max(F.abs(F.col("now") - F.col("competence")))).first()[0]
        self.params = new
        return float(moved or 0.0)

    def items(self) -> DataFrame:
        k = range(len(LABELS))
        post = self._posteriors(self._told())
        p, v = F.array(*[F.col(f"p{i}") for i in k]), F.array(*[F.col(f"v{i}") for i in k])
        best = (F.array_position(p, F.array_max(p)) - 1).cast("int")
        n = sum((F.col(f"v{i}") for i in k[1:]), F.col("v0"))
        pairs = sum((F.col(f"v{i}") * (F.col(f"v{i}") - 1) for i in k[1:]), F.col("v0") * (F.col("v0") - 1))
        return post.select(
            "item", F.get(F.array(*[F.lit(x) for x in LABELS]), best).alias("kind"), F.array_max(p).alias("confidence"), n.cast("int").alias("labels"),
            (F.get(v, best) / n).alias("agreement"), F.when(n > 1, pairs / (n * (n - 1))).otherwise(F.lit(float("nan"))).alias("pair_agreement"),
        )

    def annotators(self) -> DataFrame:
        return self.params.select("annotator", "labels", F.col("competence").alias("reliability"), *[F.col(f"g{i}").alias(f"guess_{x}") for i, x in enumerate(LABELS)])


class Consensus:
    """Fitted mixture: ``items()`` and ``annotators()``."""

    def __init__(self, entries: DataFrame, path: str, rounds: int = ROUNDS):
        spark = entries.sparkSession
        self.spark, self.joined = spark, None
        labels = materialise(latest_labels(entries), f"{path}/labels")
        known = labels.groupBy("annotator").agg(F.count(F.lit(1)).alias("n")).orderBy("annotator").limit(MOST_ANNOTATORS + 1).collect()
        if len(known) > MOST_ANNOTATORS:
            self.joined = JoinedRounds(labels, path)
            for _ in range(rounds):
                if self.joined.step() < CLOSE:
                    break
            return
        self.counts = {r["annotator"]: r["n"] for r in known}
        self.params = Annotators(list(self.counts))
        numbers = spark.createDataFrame([(n, i) for i, n in enumerate(self.params.names)], "annotator string, who int")
        # one partition per core at least, as every round reads them
        self.table = materialise(
            labels.join(F.broadcast(numbers), "annotator").repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), "item").groupBy("item")
            .agg(F.sort_array(F.collect_list(F.struct("who", "label"))).alias("v"))  # at most one label per annotator
            .select("item", F.col("v.who").alias("who"), F.col("v.label").alias("label")),
            f"{path}/items",
        )
        self._fit(rounds if known else 0)

    def _fit(self, rounds: int) -> None:
        """Rounds until the competences rest; every third one starts from an extrapolation of the two before."""
        while rounds > 0:
            start = self.params
            one = self._round(start)
            rounds -= 1
            self.params = one
            if rounds <= 0 or self._moved(start, one) < CLOSE:
                return
            two = self._round(one)
            rounds -= 1
            self.params = two
            if rounds <= 0 or self._moved(one, two) < CLOSE:
                return
            self.params = self._round(two.beyond(start, one))
            rounds -= 1

    @staticmethod
    def _moved(a: Annotators, b: Annotators) -> float:
        return float(np.abs(a.competence - b.competence).max(initial=0.0))

    def _round(self, p: Annotators) -> Annotators:
        k = len(LABELS)
        sums = self.table.select("who", "label").mapInArrow(_expected(p), "who int, truthful double, " + ", ".join(f"s{i} double" for i in range(k)))
        rows = sums.groupBy("who").agg(*[F.sum(c).alias(c) for c in ("truthful", *(f"s{i}" for i in range(k)))]).collect()
        new = Annotators(p.names)
        for r in rows:
            counts = [r[f"s{i}"] for i in range(k)]
            if r["who"] == -1:
                new.share = (np.array(counts) + PRIOR_CLASS) / (sum(counts) + k * PRIOR_CLASS)
            else:
                new.competence[r["who"]], new.guess[r["who"]] = _updated(r["truthful"], counts, k)
        return new

    def items(self) -> DataFrame:
        """(item, kind, confidence, labels, agreement, pair_agreement)"""
        return self.joined.items() if self.joined else self.table.mapInArrow(_answers(self.params), ANSWERS)

    def annotators(self) -> DataFrame:
        """(annotator, labels, reliability, guess per label): one row per annotator."""
        if self.joined:
            return self.joined.annotators()
        p = self.params
        rows = [(n, self.counts[n], float(c), *map(float, g)) for n, c, g in zip(p.names, p.competence, p.guess)]
        return self.spark.createDataFrame(rows, "annotator string, labels long, reliability double, " + ", ".join(f"guess_{x} double" for x in LABELS))
