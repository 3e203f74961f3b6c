import random

from pyspark.sql import functions as F

from siftline.operators import graphs, pyflow, pysource


def _most_rows(df):
    """The most rows that any operator of the executed plan of a collected frame gave."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        children = p.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return most


def test_calls_of_a_name_that_many_files_define(spark):
    n = 2000
    ids = spark.range(n).select(F.format_string("%05d.py", "id").alias("file"), F.lit("wipe_all").alias("name"), F.lit(5).alias("line"))
    calls = ids.select("file", F.lit("chain").alias("caller"), F.col("name").alias("callee"), F.lit(2).alias("line"))
    df = graphs.bind_calls(calls, ids)
    rows = df.collect()
    assert len(rows) == n and all(r["file"] == r["callee_file"] and r["callee_line"] == 5 for r in rows)
    assert 0 < _most_rows(df) <= 3 * n


def test_calls_bind_as_by_trying_all(spark):
    files, names = [None, "a", "b", "c"], ["f", "g", "h"]
    calls = [(f, who, c, line) for f in files for who in ("x", None) for c in (*names, "gone", None) for line in (1, None)] * 2
    functions = [("f", "b", 9), ("f", "b", 3), ("f", "c", 1), ("g", "a", 7), ("g", "c", None), ("g", "c", 2), ("h", "b", 4), (None, "a", 1)]
    got = graphs.bind_calls(spark.createDataFrame(calls, "file string, caller string, callee string, line int"), spark.createDataFrame(functions, "name string, file string, line int"))
    low = lambda x: (x is not None, x)
    want = set()
    for f, who, c, line in set(calls):
        of = [(y, z) for x, y, z in functions if x == c and c is not None]
        if of:
            want.add((f, who, c, line, *min(of, key=lambda r: (r[0] != f, low(r[0]), low(r[1])))))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_facts_of_some_kinds_are_those_of_all(spark):
    sources = [("a.py", "@pre(lambda x: x > 0)\ndef f(x):\n    def g(y=[i for i in x if i]):\n        return y or x\n    if x:\n        q = g(x, 1)\n    return q.r\n\nclass C:\n    import os\n"), ("b.py", "def ("), ("c.py", None)]
    df = spark.createDataFrame(sources, "file string, content string")
    all_of = [tuple(r) for r in pysource.python_facts(df).collect()]
    assert {(r[3], r[7]) for r in all_of if r[1] == "function"} == {("f", "4"), ("g", "3")}
    for kinds in (("call", "function"), ("error",), ("flow", "argument", "parameter", "made"), ("contract",)):
        assert sorted(map(tuple, pysource.python_facts(df, kinds).collect())) == sorted(r for r in all_of if r[1] in kinds)


def _most_shuffled(spark, run):
    """What ``run`` returns, and the most rows that a stage of it wrote for an exchange."""
    sc = spark.sparkContext
    sc.setJobGroup("taint", "")
    try:
        result = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = [s for j in sc.statusTracker().getJobIdsForGroup("taint") for s in sc.statusTracker().getJobInfo(j).stageIds]
    store = sc._jsc.sc().statusStore()
    return result, max(store.lastStageAttempt(s).shuffleWriteRecords() for s in set(stages))


def test_taint_through_a_name_that_many_files_define(spark):
    n = 500
    source = "def run(request):\n    wipe_all(request)\n\ndef chain(a):\n    wipe_all(a)\n\ndef wipe_all(db):\n    drop(db)\n"
    sources = [(f"{i:03}.py", source if i == 0 else source.replace("request", "r") if i > 1 else source.replace("drop", "eval").replace("request", "r")) for i in range(n)]
    parsed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            parsed.add(len(b))
            yield b

    files = spark.createDataFrame(sources, "file string, content string").repartition(4)
    found = lambda: [tuple(r) for r in pyflow.taint_of(pysource.python_facts(files.mapInPandas(counted, files.schema))).collect()]
    got, shuffled = _most_shuffled(spark, found)
    assert got == [("000.py:run:request", "sink:001.py:eval", 2)]
    assert parsed.value == n  # once
    assert shuffled <= 10 * n


def test_taint_as_by_all_pairs_of_calls_and_functions(spark):
    r = random.Random(22)
    names, values = ["f", "g", "h", "eval"], ["request", "a", "b", "n"]
    rows = []
    for file in ("x.py", "y.py", "z.py"):
        for scope in ("f", "g", "C.h"):
            rows += [(file, "parameter", scope, v, p, "") for p, v in enumerate(r.sample(values, 2))]
            rows += [(file, "argument", scope, r.choice(["", "m."]) + r.choice(names), r.randrange(2), r.choice(values)) for _ in range(2)]
            rows += [(file, "flow", scope, r.choice(values), 0, r.choice(values))]
        rows.append((file, "made", "g", "a", 0, "int"))
    node = lambda *x: ":".join(x)
    clean = {node(f, s, v) for f, k, s, v, _, d in rows if k == "made" and d in pyflow.CLEANERS}
    edges = {(node(f, s, d), node(f, s, v)) for f, k, s, v, _, d in rows if k == "flow"}
    for f, k, s, v, p, d in rows:
        if k == "argument":
            callee = v.split(".")[-1]
            edges |= {(node(f, s, d), node("sink", f, callee))} if callee in pyflow.SINKS else set()
            edges |= {(node(f, s, d), node(f2, s2, v2)) for f2, k2, s2, v2, p2, _ in rows if k2 == "parameter" and s2.split(".")[-1] == callee and p2 == p}
    df = spark.createDataFrame(rows, "file string, kind string, scope string, name string, position int, detail string")
    hops = set()
    for depth in (2, 8):
        want = set()
        for start in {node(f, s, v) for f, k, s, v, _, _ in rows if k == "parameter" and v in pyflow.SOURCES}:
            seen, at = {start: 0}, {start}
            for d in range(1, depth + 1):
                at = {y for x, y in edges if x in at and y not in clean} - set(seen)
                seen |= dict.fromkeys(at, d)
            want |= {(start, y, d) for y, d in seen.items() if y.startswith("sink:")}
        assert sorted(map(tuple, pyflow.taint_of(df, depth).collect())) == sorted(want) and want
        hops |= {d for _, _, d in want}
    assert max(hops) > 2
