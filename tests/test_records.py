import random

from pyspark.sql import functions as F

from siftline.operators import analytics
from siftline.queries import python, records

def test_python_queries_read_the_source_documents(spark, tmp_path):
    docs = [(1, "def show(request):\n    return eval(request)\n", "source"), (2, "def f(:", "source"), (3, "def f(:", "page"), (4, None, "source")]
    spark.createDataFrame(docs, "doc_id long, text string, doc_kind string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a/b.py", 7, "msg")], "file string, line int, message string").write.parquet(f"{tmp_path}/issues.parquet")
    assert [(r["file"], r["detail"]) for r in python.QUERIES["python_errors"](spark, str(tmp_path)).collect()] == [("documents/2", "SyntaxError")]
    assert {r["file"] for r in python.facts(spark, str(tmp_path)).collect()} == {"documents/1", "documents/2", "a/b/0.py"}


def test_graph_queries_over_whole_tables_agree_with_brute_force(spark, tmp_path):
    r = random.Random(4)
    skewed = lambda n: min(r.randrange(n), r.randrange(n), r.randrange(n))
    nations = [(i, i % 3) for i in range(6)]
    customers = [(i, skewed(6)) for i in range(40)] + [(40, None)]
    orders = [(i, skewed(40), r.choice("FO")) for i in range(150)]
    lines = [(skewed(150), skewed(60)) for _ in range(400)]
    parts = [(i,) for i in range(60)]
    for name, rows, columns in (
        ("nation", nations, "n_nationkey long, n_regionkey long"), ("customer", customers, "c_custkey long, c_nationkey long"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string"), ("lineitem", lines, "l_orderkey long, l_partkey long"), ("part", parts, "p_partkey long"),
    ):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = {(f"n{n}", f"c{c}") for c, n in customers if n is not None} | {(f"c{c}", f"o{o}") for o, c, _ in orders} | {(f"o{o}", f"p{p}") for o, p in lines}

    def brute(starts, pairs, depth):
        after = {}
        for a, b in pairs:
            after.setdefault(a, set()).add(b)
        out = {}
        for s in starts:
            now = {s}
            for d in range(depth + 1):
                for x in now:
                    out.setdefault((s, x), d)
                now = {y for x in now for y in after.get(x, ()) if (s, y) not in out}
        return out

    got = lambda name: {tuple(x) for x in records.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("trade_reach") == {(*k, d) for k, d in brute([f"n{n}" for n, _ in nations], edges, 3).items()}
    counts = {}
    for (s, _), d in brute([f"p{p}" for p, in parts], {(b, a) for a, b in edges}, 3).items():
        counts[s] = counts.get(s, 0) + (d > 0)
    assert got("trade_blast_radius") == {(s, n, "high" if n > 10 else "medium" if n > 3 else "low") for s, n in counts.items() if n}
    finished = {f"o{o}" for o, _, s in orders if s == "F"}
    clean = brute([f"n{n}" for n, k in nations if k == 0], {(a, b) for a, b in edges if b not in finished}, 8)
    assert got("trade_taint") == {(s, x, d) for (s, x), d in clean.items() if x[0] == "p" and int(x[1:]) % 4 == 0}


def test_nearest_takes_the_smallest_ids_of_equal_vectors(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i else [1.0, 1.0]) for i in ids], "id long, v array<double>").coalesce(1)
    got = analytics.nearest(rows, "id", "v", F.col("id") == 0, 5).orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [1, 2, 3, 4, 5]
