"""General training-data operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import datetime as dt
import random

import pytest

from siftline.functions.keys import BLANKS
from siftline.operators import changes, frequency, orphans, skew, snapshots
from siftline.runtime import work_dir

DAY = dt.datetime(2026, 1, 1)
FEED = "id long, fingerprint string, timestamp timestamp, action string, old_state string, new_state string, state string, live string, ts string"


def feed(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = r.choice(["a", " A", "b", "c\t", "", None, "hot", "hot", "hot"])
        action = r.choice(["open", "Open", "confirm", "resolve ", "re-open", "comment", "purge", "baseline", "odd", None])
        new = r.choice([None, "open", "Fixed", "false-positive", " confirmed"])
        rows.append((i if r.random() < 0.9 else i - 1, key, r.choice([None, *(DAY + dt.timedelta(k) for k in range(15))]), action, None, new, "x", "y", "z"))
    rows += r.sample(rows, n // 5)
    return rows


def brute_state(rows):
    norm = lambda s: (s or "").lower().strip(BLANKS) or None
    tight = lambda s: "".join(c for c in (s or "").lower() if c not in BLANKS + "-_") or None
    once = {}
    for i, k, t, a, o, s, *_ in rows:
        k, a, o, s = norm(k), tight(a), tight(o), tight(s)
        s = "false_positive" if s == "falsepositive" else s
        if k:
            g = (k, t, a, o, s)
            once[g] = min(i, once.get(g, i))
    state = {}
    for (k, t, a, _, s), i in sorted(once.items(), key=lambda x: (x[0][1] is not None, x[0][1] or DAY, x[1])):
        if a == "open":
            state.setdefault(k, s or "open")
        elif a == "purge":
            state.pop(k, None)
        elif a in changes.UPDATES and k in state and s:
            state[k] = s
    return state


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_in_any_order_and_delivery(spark, seed):
    rows = feed(seed, 150)
    # equal order of different changes is a tie that ids do not break; keep ids distinct per time
    seen, kept = set(), []
    for r in rows:
        if (r[0], r[2]) not in seen or r in kept:
            seen.add((r[0], r[2]))
            kept.append(r)
    want = brute_state(kept)
    shuffled = kept[:]
    random.Random(seed).shuffle(shuffled)
    for parts in (1, 3):
        t = changes.ChangeTable(spark, work_dir(spark, "t"))
        for p in range(parts):
            t.apply(spark.createDataFrame(shuffled[p::parts], FEED))
        assert {r["fingerprint"]: r["state"] for r in t.state().collect()} == want


def test_changes_empty_and_untouched_buckets(spark):
    t = changes.ChangeTable(spark, work_dir(spark, "t"))
    t.apply(spark.createDataFrame([], FEED))
    assert t.state().collect() == []
    t.apply(spark.createDataFrame([(1, k, DAY, "open", None, "open", "", "", "") for k in "abcdefgh"], FEED))
    before = t.table.manifest()["at"]
    t.apply(spark.createDataFrame([(2, "a", DAY + dt.timedelta(1), "resolve", None, "fixed", "", "", "")], FEED))
    after = t.table.manifest()["at"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r["fingerprint"]: r["state"] for r in t.state().collect()} == {k: "fixed" if k == "a" else "open" for k in "abcdefgh"}


def test_a_table_that_outgrew_its_buckets_is_spread(spark):
    path = work_dir(spark, "t")
    t = changes.ChangeTable(spark, path)
    t.apply(spark.createDataFrame([(i, f"k{i}", DAY, "open", None, "open", "", "", "") for i in range(100)], FEED))
    t = changes.ChangeTable(spark, path)  # another process goes on
    t.table.ROWS = 10
    t.apply(spark.createDataFrame([(200, "k1", DAY + dt.timedelta(1), "purge", None, None, "", "", "")], FEED))
    assert t.table.manifest()["buckets"] == 10
    assert {r[0] for r in t.state().collect()} == {f"k{i}" for i in range(100) if i != 1}


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(300)], "k string, v long")
    small = spark.createDataFrame([("h", 1), ("k3", 2)], "k string, w long")
    hot = skew.hot_keys(big.groupBy("k").count(), "k", "count", floor=50)
    assert [r[0] for r in hot.collect()] == ["h"]
    got = skew.salted_join(big, small, "k", hot, big["v"]).select("k", "v", "w").collect()
    assert sorted(got, key=str) == sorted(big.join(small, "k", "left").select("k", "v", "w").collect(), key=str)


SNAP = "snapshot_no int, fingerprint string, rule_id string, file string, line int, severity string, message string, layer string, cwe string, state string, last_seen timestamp, ordinal long, bucket string"


def snap_row(no, key, seen=DAY, **x):
    d = {"rule_id": "r", "file": "f", "line": 1, "severity": "low", "message": "m", "layer": "l", "cwe": None, "state": "open"} | x
    return (no, key, *(d[c] for c in snapshots.COMPARED), seen, 9, "z")


def test_snapshots(spark):
    later = DAY + dt.timedelta(1)
    rows = [
        snap_row(1, "a"), snap_row(1, "b"), snap_row(1, "c"), snap_row(1, "d"), snap_row(1, None), snap_row(1, " "),
        snap_row(3, "A ", severity=" LOW", cwe="", state="Open"), snap_row(3, "b", line=2), snap_row(3, "b", later, line=1), snap_row(3, "c", later, line=7), snap_row(3, "c", None, line=1),
        snap_row(3, "e"), snap_row(3, "e"),
        snap_row(4, "e", message=None, state="false-positive"), snap_row(4, "a"),
    ]
    got = {(r["snapshot_no"], r["fingerprint"], r["change"], r["columns"]) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, SNAP), work_dir(spark, "t")).collect()}
    assert got == {
        (3, "c", "changed", "line"), (3, "d", "removed", ""), (3, "e", "added", ""),
        (4, "b", "removed", ""), (4, "c", "removed", ""), (4, "e", "changed", "message,state"),
    }
    assert snapshots.snapshot_changes(spark.createDataFrame([], SNAP), work_dir(spark, "t")).collect() == []


def test_ordinals_persist(spark):
    path = work_dir(spark, "t")
    o = snapshots.KeyOrdinals(spark, path, 3)
    one = {r["fingerprint"]: (r["bucket"], r["ordinal"]) for r in o.extend(spark.createDataFrame([("a",), ("b",)], "fingerprint string")).collect()}
    o = snapshots.KeyOrdinals(spark, path)  # another process goes on
    two = {r["fingerprint"]: (r["bucket"], r["ordinal"]) for r in o.extend(spark.createDataFrame([("c",), ("a",), ("d",), ("e",)], "fingerprint string")).collect()}
    assert {k: two[k] for k in one} == one and len(set(two.values())) == 5


def test_orphans(spark):
    issues = spark.createDataFrame([("A", DAY), (" a", DAY + dt.timedelta(9)), ("b", DAY), (None, DAY), ("n", None)], "fingerprint string, first_seen timestamp")
    hist = spark.createDataFrame(
        [(1, "x", DAY, "purge"), (2, "x", DAY + dt.timedelta(2), "PURGE "), (3, "x", DAY + dt.timedelta(3), "comment"), (4, "x", DAY, "open"), (5, "a", DAY - dt.timedelta(1), "open"),
         (5, "a", DAY - dt.timedelta(1), "open"), (6, "a", DAY, "open"), (7, "zz", None, "open"), (8, " ", DAY, "open"), (9, None, DAY, None), (10, "n", DAY, "open"), (11, "b", None, "open"), (2**60 + 1, "yy", DAY, "open"), (None, "yy", DAY, "open")],
        "id long, fingerprint string, timestamp timestamp, action string",
    )
    refs = orphans.references(hist, "h", "fingerprint", "id", "timestamp")
    for ranges in (1, 3):
        got = {tuple(r) for r in orphans.orphan_rows(refs, orphans.parents(issues, hist), work_dir(spark, "t"), ranges).collect()}
        assert got == {("h", "2026-01", 3, "deleted"), ("h", "2025-12", 5, "early"), ("h", None, 7, "missing"), ("h", "2026-01", 2**60 + 1, "missing"), ("h", "2026-01", None, "missing")}
    none = spark.createDataFrame([], hist.schema)
    got = orphans.orphan_rows(refs, orphans.parents(spark.createDataFrame([], issues.schema), none), work_dir(spark, "t")).collect()
    assert {r["reason"] for r in got} == {"missing"} and len(got) == 11
    assert orphans.orphan_rows(orphans.references(none, "h", "fingerprint", "id", "timestamp"), orphans.parents(issues, hist), work_dir(spark, "t")).collect() == []


def test_frequencies(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(0, 900, 7)])) for _ in range(400)]
    f = frequency.frequencies(spark.createDataFrame(rows, "key string, v int"), "key", "v")
    got = {x["k"]: (x["p50"], x["p90"]) for x in frequency.weighted_percentiles(f, {"p50": 0.5, "p90": 0.9}, width=50).collect()}
    modes = {x["k"]: x["m"] for x in frequency.mode_of(f, "m").collect()}
    import math

    for k in {a for a, _ in rows}:
        values = sorted(v for a, v in rows if a == k and v is not None)
        assert got[k] == tuple(values[max(1, math.ceil(p * len(values))) - 1] for p in (0.5, 0.9))
        assert modes[k] == min(set(values), key=lambda v: (-values.count(v), v))
    empty = spark.createDataFrame([], "rule_id string, file string")
    assert frequency.heavy_values(empty, ["rule_id", "file"], 0.03).collect() == []
    heavy = spark.createDataFrame([("r", "f" + str(i)) for i in range(40)] + [(None, None)] * 9, "rule_id string, file string")
    assert [tuple(x) for x in frequency.heavy_values(heavy, ["rule_id", "file"], 0.03).collect()] == [("rule_id", "r", 40)]
