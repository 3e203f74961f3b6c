import random

from siftline.llm import findings, history_dedup
from siftline.runtime import work_dir

COLUMNS = "item_id long, batch_no int, rule_id string, file string, line int, message string, ord string"


def same(a, b):
    (ka, la, na), (kb, lb, nb) = a, b
    if ka != kb or (la is None) != (lb is None) or (la is not None and abs(la - lb) > 25):
        return False
    most = min(3, min(len(na), len(nb)) // 4)
    return findings.edits(na, nb, most) <= most


def parts(r):
    return (findings.kind_of(r[2]), findings.base_name(r[3])), r[4], findings.function_of(r[5])


def made(seed, n):
    r = random.Random(seed)
    names = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(25)]
    rows = []
    for i in range(n):
        name = "trim_" + r.choice(names)
        if r.random() < 0.3:
            k = r.randrange(2, len(name))
            name = name[:k] + r.choice("abcxyz") + name[k + 1 :]
        message = r.choice(["In {}: bad thing.", "{}(): bad thing", "Bad thing (function {})"]).format(name)
        rule = r.choice(["python-path-escape", "PYTHON-PATH-ESCAPE", "yaml:python.path_escape", "python-log-forging"])
        file = r.choice(["a/b/hot.py", "/builds/w1/A/b/hot.py", "x\\y\\other.py"])
        rows.append((i, i * 3 // n, rule, file, r.choice([None, *range(1, 120)]), message, "x"))
    return rows


def brute(history, rows):
    known, out = [parts(h) for h in history], set()
    for r in sorted(rows):
        if any(same(parts(r), k) for k in known):
            out.add(r[0])
        known.append(parts(r))
    return out


def test_agrees_with_brute_force_however_batches_are_delivered(spark):
    history, rows = made(1, 60), made(2, 200)
    h, b = spark.createDataFrame(history, COLUMNS), spark.createDataFrame(rows, COLUMNS)
    want = brute(history, rows)
    assert 20 < len(want) < 190
    for some in (b, b.selectExpr("item_id", "batch_no div 2 batch_no", "rule_id", "file", "line", "message")):
        got = [r[0] for r in history_dedup.repeated_items(h, some, work_dir(spark, "t")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def mistyped(r, name, times):
    for _ in range(times):
        k = r.randrange(len(name))
        name = r.choice([name[:k] + name[k + 1 :], name[:k] + r.choice("abcxyz") + name[k:], name[:k] + r.choice("abcxyz") + name[k + 1 :]])
    return name


def test_every_accepted_pair_of_names_shares_a_fingerprint():
    r, pairs = random.Random(5), [("routejehiopi", "routjehivopi"), ("abababababab", "abaabbababba"), ("abcd", "abxd")]
    while len(pairs) < 4000:
        a = "".join(r.choice("bdfgk") + r.choice("aeiou") for _ in range(9))[: r.randrange(4, 19)]
        b = mistyped(r, a, r.randrange(1, 4))
        most = min(3, min(len(a), len(b)) // 4)
        if findings.edits(a, b, most) <= most:
            pairs.append((a, b))
    for hidden in ("", "~badthingin"):
        kept = [set() for _ in range(2 * len(pairs))]
        for i, h in zip(*history_dedup.winnowed([x for a, b in pairs for x in (a, hidden + b)])):
            kept[i].add(int(h))
        assert [p for i, p in enumerate(pairs) if not kept[2 * i] & kept[2 * i + 1]] == []


def test_agrees_with_brute_force_on_names_with_two_and_three_typing_errors(spark):
    r, rows = random.Random(7), []
    for i in range(240):
        name = "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(9))[: r.randrange(4, 19)]
        for name in (name, mistyped(r, name, r.randrange(1, 4))):
            rows.append((len(rows), i // 120, "python-path-escape", f"a/f{i % 60}.py", r.randrange(1, 60), f"In {name}: bad thing.", "x"))
    want = brute([], rows)
    assert len(want) > 50
    got = history_dedup.repeated_items(spark.createDataFrame([], COLUMNS), spark.createDataFrame(rows, COLUMNS), work_dir(spark, "t"))
    assert {r[0] for r in got.collect()} == want


def test_names_that_are_not_recognised_are_found_in_the_wording(spark):
    history = [(1, 0, "go-path-escape", "a/x.go", 10, "In load_kumavezi: bad thing.", "")]
    rows = [
        (1, 1, "path-escape", "b/x.go", 12, "bad thing (functon load_kumavzi", ""),
        (2, 1, "path-escape", "b/x.go", 12, "bad thing in pack_zuzuzuzu (functon", ""),
        (3, 1, None, None, None, None, ""),
        (4, 2, None, None, None, None, ""),
        (5, 2, "path-escape", "b/x.go", 40, "In load_kumavezi: bad thing.", ""),
    ]
    got = history_dedup.repeated_items(spark.createDataFrame(history, COLUMNS), spark.createDataFrame(rows, COLUMNS), work_dir(spark, "t"))
    assert {r[0] for r in got.collect()} == {1, 4}


def test_another_process_goes_on_with_the_index_and_buckets_split(spark, monkeypatch):
    history, rows = made(3, 80), made(4, 120)
    path, b = work_dir(spark, "t"), spark.createDataFrame(rows, COLUMNS)
    history_dedup.HistoryIndex(spark, path, 2).accept(spark.createDataFrame(history, COLUMNS))
    monkeypatch.setattr(history_dedup, "BUCKET_ROWS", 160)  # the store has to be spread over more buckets
    found, buckets = set(), []
    for n in range(3):
        index = history_dedup.HistoryIndex(spark, path, 2)
        found |= {r[0] for r in index.screen(b.where(f"batch_no = {n}"), "item_id").collect()}
        buckets.append(index.parts[-1]["buckets"])
    assert found == brute(history, rows) and buckets[-1] > index.parts[0]["buckets"]


def test_beyond_what_may_be_sent_rows_are_exchanged(spark, monkeypatch):
    monkeypatch.setattr(history_dedup, "MOST_SENT", 5)
    history, rows = made(5, 60), made(6, 80)
    got = history_dedup.repeated_items(spark.createDataFrame(history, COLUMNS), spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 first").drop("batch_no").withColumnRenamed("first", "batch_no"), work_dir(spark, "t"))
    assert {r[0] for r in got.collect()} == brute(history, rows)


def test_a_run_of_equal_fingerprints_may_be_cut_anywhere():
    import numpy as np

    f, own = np.array([1, 2, 2, 2, 3, 3, 4, 5, 5, 6]), np.array([1, 1, 1, 0, 1, 0, 0, 1, 1, 1])
    for cut in range(1, 10):
        for second in range(cut, 10):
            b, got = history_dedup._Bucket(0), set()
            for lo, hi in ((0, cut), (cut, second), (second, 10)):
                if hi > lo:
                    got |= {int(c) for batch in b.ask(f[lo:hi], np.arange(lo, hi), own[lo:hi]) if batch.column(0)[0].as_py() == history_dedup.POSITIVE for c in batch.column(2).to_pylist()}
            got |= {int(c) for batch in b.close() if batch.column(0)[0].as_py() == history_dedup.POSITIVE for c in batch.column(2).to_pylist()}
            assert got == {1, 2, 3, 5, 7, 8}, (cut, second, got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    some = spark.createDataFrame([(1, 1, "r-a", "f", 1, "In ab_cdefgh: x", ""), (2, 1, "r-a", "f", 1, "In ab_cdefgh: x", "")], COLUMNS)
    assert history_dedup.repeated_items(none, none, work_dir(spark, "t")).collect() == []
    assert history_dedup.repeated_items(some, none, work_dir(spark, "t")).collect() == []
    assert [r[0] for r in history_dedup.repeated_items(none, some, work_dir(spark, "t")).collect()] == [2]


def test_wordings_without_a_function_agree_as_a_whole(spark):
    cut, whole = "The value is never checked before", "The value is never checked before the record of the customer is written"
    history = [(1, 0, "path-escape", "a/x.go", 10, whole, ""), (2, 0, "path-escape", "a/y.go", 10, whole, "")]
    rows = [
        (1, 1, "path-escape", "x.go", 12, cut, ""), (2, 1, "path-escape", "y.go", 12, cut + "...", ""), (3, 2, "path-escape", "x.go", 12, whole.replace("never", "nver"), ""),
        (4, 2, "path-escape", "z.go", 12, cut, ""), (5, 2, "path-escape", "z.go", 12, cut + " its use there", ""),
    ]
    got = history_dedup.repeated_items(spark.createDataFrame(history, COLUMNS), spark.createDataFrame(rows, COLUMNS), work_dir(spark, "t"))
    assert {r[0] for r in got.collect()} == {2, 3}
