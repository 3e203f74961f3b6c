import datetime as dt
import random

from siftline.llm import consensus
from siftline.runtime import work_dir

COLUMNS = "entry_id long, finding_key string, kind string, labeler string, labeled_at timestamp, label string, item string"
DAY = dt.datetime(2026, 1, 1)


def test_recovers_truth_and_reliability(spark):
    r = random.Random(5)
    truth = {f"k{i}": r.choices(consensus.LABELS, [5, 4, 1])[0] for i in range(600)}
    care = {f"good{i}": 0.9 for i in range(4)} | {f"spam{i}": 0.02 for i in range(5)}
    rows = []
    for k, t in truth.items():
        for who in r.sample(sorted(care), 5):
            kind = t if r.random() < care[who] else ("tp" if r.random() < 0.9 else "fp")
            rows.append((len(rows), k, kind, who, DAY, "x", None))
    fitted = consensus.Consensus(spark.createDataFrame(rows, COLUMNS), work_dir(spark, "t"))
    items = {x["item"]: x for x in fitted.items().collect()}
    right = sum(items[k]["kind"] == t for k, t in truth.items()) / len(truth)
    votes = {}
    for x in rows:
        votes.setdefault(x[1], []).append(x[2])
    majority = sum(max(consensus.LABELS, key=v.count) == truth[k] for k, v in votes.items()) / len(truth)
    assert right > 0.9 and right > majority + 0.05
    found = {x["annotator"]: x["reliability"] for x in fitted.annotators().collect()}
    assert all(found[f"good{i}"] > 0.8 for i in range(4)) and all(found[f"spam{i}"] < 0.2 for i in range(5))


def test_parameters_that_stay_a_table_give_the_same(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, f"k{r.randrange(60)}", r.choice(consensus.LABELS), f"w{r.randrange(7)}", DAY, "x", None) for i in range(300)]
    df = spark.createDataFrame(rows, COLUMNS)
    monkeypatch.setattr(consensus, "MOST_ANNOTATORS", 2)
    monkeypatch.setattr(consensus.Annotators, "beyond", lambda self, a, b: self)
    far = consensus.Consensus(df, work_dir(spark, "t"), 3)
    monkeypatch.setattr(consensus, "MOST_ANNOTATORS", 100)
    near = consensus.Consensus(df, work_dir(spark, "t"), 3)  # without extrapolation
    for f in ("items", "annotators"):
        a, b = (sorted(getattr(c, f)().collect(), key=lambda x: x[0]) for c in (near, far))
        assert [x[:2] for x in a] == [x[:2] for x in b] and len(a) > 6
        assert all(abs(u - v) < 1e-9 or u != u and v != v for x, y in zip(a, b) for u, v in zip(x[2:], y[2:]))


def test_latest_verdict_and_spelling(spark):
    rows = [
        (1, "K1", "tp", "a", DAY, "", ""), (2, " k1\t", "False Positive", "A ", DAY + dt.timedelta(1), "", ""),
        (3, "k1", "?", "a", DAY + dt.timedelta(2), "", ""), (4, "k1", "fn", "b", None, "", ""), (5, "k1", "tp", "b", DAY, "", ""),
        (6, "k1", "fp", "c", DAY, "", ""), (7, "k1", "tp", "c", DAY, "", ""), (7, "k1", "tp", "c", DAY, "", ""),
        (8, None, "tp", "a", DAY, "", ""), (9, "k2", "tp", " ", DAY, "", ""), (10, "k2", None, "a", DAY, "", ""),
    ]
    got = {(x["item"], x["annotator"]): x["label"] for x in consensus.latest_labels(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {("k1", "a"): 1, ("k1", "b"): 0, ("k1", "c"): 0}


def test_empty_table(spark):
    fitted = consensus.Consensus(spark.createDataFrame([], COLUMNS), work_dir(spark, "t"))
    assert fitted.items().collect() == [] and fitted.annotators().collect() == []
