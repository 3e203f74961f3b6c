"""Third-party inputs, lines, metrics, graphs and analytics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftline.operators import analytics, graphs, metrics, pyflow, pysource, sequences
from siftline.report import sarif
from siftline.sources import files, inputs


def one(spark, name, text):
    return spark.createDataFrame([(name, text)], "file string, content string")


def test_lines_break_at_all_separators(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h\n\ni\n"
    got = [r["text"] for r in files.lines_of(one(spark, "f", text)).orderBy("line_no").collect()]
    assert got == text.splitlines()
    assert files.lines_of(one(spark, "f", "")).count() == files.lines_of(one(spark, "f", None)).count() == 0


def test_globs(spark):
    df = spark.createDataFrame([("a/tests/x.py",), ("tests/x.py",), ("a/x.py",), ("node_modules/a.js",)], "p string")
    got = df.select("p", files.matches_any(F.col("p"), ["tests/**", "**/tests/*.py"]).alias("m"), files.in_skipped_folder(F.col("p")).alias("s")).collect()
    assert [(r["m"], r["s"]) for r in got] == [(True, False), (True, False), (False, False), (False, True)]


def test_what_is_scanned(spark):
    paths = ["a/x.py", "a/x.bin", "build/x.py", "Dockerfile.prod", "b/siftline-report.json", ".siftline/x.json", "gen/x.generated.go", "docs/y.go", "a/docs/y.go"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    globs = files.ignore_globs("# no\n\ndocs/\n*.generated.go\n")
    assert globs == ["**/docs/**", "**/*.generated.go"]
    assert [r["p"] for r in df.where(files.scannable(F.col("p"), globs)).collect()] == ["a/x.py", "Dockerfile.prod"]
    assert files.workspaces(["packages/a", "packages/b", "apps/x", "other"], ["packages/*", "apps/x"], ["**/b/**"]) == ["apps/x", "packages/a"] and files.workspaces(["a"], [], []) == ["."]


def test_diff(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n keep\n-old\n+new\n+more\n keep\n@@ -10 +11,2 @@\n+end\n"
    d = inputs.diff_lines(spark.createDataFrame([("d", text)], "diff string, content string"))
    assert [(r["line"], r["kind"], r["text"]) for r in d.orderBy("line", "kind").collect()] == [
        (1, "context", "keep"), (2, "added", "new"), (2, "removed", "old"), (3, "added", "more"), (4, "context", "keep"), (11, "added", "end"),
    ]
    h = inputs.hunks(spark.createDataFrame([("d", text)], "diff string, content string")).orderBy("first_line").collect()
    assert [(r["file"], r["first_line"], r["last_line"], r["added"], r["removed"]) for r in h] == [("x.py", 1, 4, 2, 1), ("x.py", 11, 12, 1, 0)]
    f = spark.createDataFrame([("x.py", "outer", 1, 20), ("x.py", "inner", 2, 4)], "file string, name string, line int, end_line int")
    got = inputs.enclosing_function(d.where("kind = 'added'").select("file", "line"), f)
    assert {(r["line"], r["function"]) for r in got.collect()} == {(2, "inner"), (3, "inner"), (11, "outer")}


@pytest.mark.parametrize("name, text, want", [
    ("requirements.txt", "Flask==2.0.1  # web\nrequests>=2\n-r other.txt\n\nplain\n", {("flask", "2.0.1"), ("requests", "2"), ("plain", None)}),
    ("package.json", '{"dependencies": {"left": "^1.2.3"}, "devDependencies": {"right": "~4.0.0"}}', {("left", "1.2.3"), ("right", "4.0.0")}),
    ("pom.xml", "<dependency> <groupId>g</groupId> <artifactId>a</artifactId> <version>1.0</version></dependency>", {("g:a", "1.0")}),
    ("build.gradle", "implementation 'g:a:2.1'\ntestImplementation(\"h:b:3\")", {("g:a", "2.1"), ("h:b", "3")}),
    ("go.mod", "module m\nrequire (\n\tgithub.com/x/y v1.2.3\n)\n", {("github.com/x/y", "1.2.3")}),
    ("Cargo.toml", 'serde = "1.0"\ntokio = { version = "1.5", features = [] }\n', {("serde", "1.0"), ("tokio", "1.5")}),
    ("Gemfile", "gem 'rails', '~> 6.1'\ngem \"rake\"\n", {("rails", "6.1"), ("rake", None)}),
    ("composer.json", '{"require": {"php": ">=7", "a/b": "^3.1"}}', {("a/b", "3.1")}),
    ("pyproject.toml", '[project]\nname = "p"\ndependencies = [\n  "Flask>=2.0",\n  "plain",\n]\n[tool.x]\n', {("flask", "2.0"), ("plain", None)}),
    ("Pipfile.lock", '{"default": {"Flask": {"version": "==2.0"}}, "develop": {"pytest": {"version": "==8.1"}}}', {("flask", "2.0"), ("pytest", "8.1")}),
    ("package-lock.json", '{"packages": {"": {"version": "1"}, "node_modules/a": {"version": "1.2"}, "node_modules/a/node_modules/@s/b": {"version": "3"}}}', {("a", "1.2"), ("@s/b", "3")}),
    ("yarn.lock", 'a@^1.0, a@^1.1:\n  version "1.2.3"\n\n"@s/b@^2":\n  version "2.1"\n', {("a", "1.2.3"), ("@s/b", "2.1")}),
    ("go.sum", "github.com/x/y v1.2.3 h1:abc=\ngithub.com/x/y v1.2.3/go.mod h1:def=\n", {("github.com/x/y", "1.2.3")}),
    ("Gemfile.lock", "GEM\n  specs:\n    rails (6.1.4)\n      rack (>= 2)\n", {("rails", "6.1.4")}),
    ("composer.lock", '{"packages": [{"name": "a/b", "version": "v1.2"}], "packages-dev": [{"name": "c/d", "version": "2"}]}', {("a/b", "1.2"), ("c/d", "2")}),
    ("poetry.lock", '[[package]]\nname = "x"\nversion = "0.3"\n', {("x", "0.3")}),
])
def test_manifests(spark, name, text, want):
    got = inputs.dependencies(one(spark, f"app/{name}", text)).collect()
    assert {(r["name"], r["version"]) for r in got} == want


def test_coverage_reports(spark):
    py = '{"files": {"a.py": {"summary": {"covered_lines": 8, "num_statements": 10}}}}'
    go = "mode: set\na.go:1.1,2.2 3 1\na.go:3.1,4.2 2 0\n"
    xml = '<!DOCTYPE report PUBLIC "x" "y"><report name="r"><package name="p"><sourcefile name="N.java"><counter type="BRANCH" missed="7" covered="9"/></sourcefile><sourcefile name="A.java"><line nr="1"/><counter type="BRANCH" missed="8" covered="8"/><counter type="LINE" missed="1" covered="4"/></sourcefile></package></report>'
    js = '{"a.js": {"s": {"0": 1, "1": 0}}}'
    got = [tuple(f(one(spark, "r", t)).collect()[0]) for f, t in ((inputs.coverage_python, py), (inputs.coverage_go, go), (inputs.coverage_jacoco, xml), (inputs.coverage_istanbul, js))]
    assert got == [("a.py", 8, 10), ("a.go", 3, 5), ("A.java", 4, 5), ("a.js", 1, 2)]


def test_rule_files_and_language(spark):
    rules = inputs.rules_of("- {id: a, pattern: 'x(', severity: ERROR}\n- {id: b, pattern-regex: '/foo/i'}\n- {id: c, pattern-either: [{pattern: p1}, {pattern-regex: p2}]}\n- {id: d, message: none}\n")
    assert [(r.rule_id, r.pattern, r.severity, r.ignore_case) for r in rules] == [("a", "x(", "high", False), ("b", "foo", "medium", True), ("c", "(?:p1)|(?:p2)", "medium", False)]
    lines = spark.createDataFrame([("f", 1, "  run( 'abc' , x1)"), ("f", 2, "run(abc, x)")], "file string, line_no int, text string")
    got = inputs.dsl_matches(lines, "r", r"run\( $STRING , $IDENT\)").collect()
    assert [(r["line_no"], r["column"], r["match"]) for r in got] == [(1, 3, "run( 'abc' , x1)")]
    assert inputs.dsl_regex("$META = f(...)") == r"(\w+) = f(.*?)"
    more = spark.createDataFrame([("f", 1, "returnx"), ("f", 2, "return x")], "file string, line_no int, text string")
    assert [r["line_no"] for r in inputs.dsl_matches(more, "r", "return x").collect()] == [2]


def test_metrics(spark):
    m = metrics.code_metrics(one(spark, "a.js", "function f(a) {\n  if (a && b) { while (x) { y(); } }\n}\n")).collect()[0]
    assert (m["cyclomatic"], m["nesting"], m["grade"]) == (3, 4, "B")
    low = metrics.code_metrics(one(spark, "b.js", "x = 1;")).collect()[0]
    assert (low["cyclomatic"], low["nesting"], low["toxicity"], low["grade"]) == (1, 0, 0.1, "A")
    e = spark.createDataFrame([("aaaa",), ("abab",), ("abcd",)], "t string").select(metrics.entropy(F.col("t")).alias("e")).collect()
    assert [round(r["e"], 6) for r in e] == [0.0, 1.0, 2.0]
    lines = spark.createDataFrame([("a", 1, "x = 'A9fk3LmQ0zX7bT2vR8sW'"), ("a", 2, "x = 'aaaaaaaaaaaaaaaaaaaaaaaa'"), ("b", 1, "f'{x}'"), ("c", 1, "'%s' % x")], "file string, line_no int, text string")
    assert [r["line_no"] for r in metrics.high_entropy_tokens(lines).collect()] == [1]
    assert [tuple(r) for r in metrics.mixed_styles(lines, {"format": (r"\bf'", r"' % "), "log": ("print", "logger")}).collect()] == [("format", 1, 1)]
    now = dt.datetime(2026, 6, 1)
    h = spark.createDataFrame([("a", "safe", now - dt.timedelta(100)), ("b", "safe", now), ("c", "to_review", None)], "id string, status string, reviewed_at timestamp")
    assert [r["status"] for r in metrics.decayed_hotspots(h, F.lit(now)).orderBy("id").collect()] == ["to_review", "safe", "to_review"]
    obs = spark.createDataFrame([("f", "x", 2.0)] * 3 + [("f", "y", float(v)) for v in (1, 2, 3)] + [("f", "z", 1.0)], "function string, variable string, value double")
    assert {(r["variable"], r["kind"]) for r in metrics.invariants(obs).collect()} == {("x", "constant"), ("y", "positive")}


def test_python_facts_taint_and_dead_code(spark):
    src = [
        ("a.py", "from b import helper\n\ndef view(request):\n    q = request.args\n    helper(q)\n\ndef clean(request):\n    n = int(request)\n    helper2(n)\n"),
        ("b.py", "def helper(text):\n    eval(text)\n\ndef helper2(text):\n    exec(text)\n\ndef never():\n    pass\n"), ("c.py", "def ("), ("d.py", None),
    ]
    f = pysource.python_facts(spark.createDataFrame(src, "file string, content string"))
    assert [(r["file"], r["detail"]) for r in f.where("kind = 'error'").collect()] == [("c.py", "SyntaxError")]
    got = {(r["source"], r["sink"]) for r in pyflow.taint_of(f).collect()}
    assert got == {("a.py:view:request", "sink:b.py:eval")}
    fns = f.where("kind = 'function'").select("name", "file", "line")
    calls = f.where("kind = 'call'").select(F.col("name").alias("callee"))
    assert {r["name"] for r in graphs.unreferenced(fns, calls).collect()} == {"view", "clean", "never"}


def test_reach_with_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    got = {(r["node"], r["hops"]) for r in graphs.reach(spark.createDataFrame([(1,)], "node long"), e, 3).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_nearest_agrees_with_brute_force(spark):
    import numpy as np

    m = np.random.default_rng(1).normal(size=(230, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(5)
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    for r in analytics.nearest(df, "id", "v", F.col("id") % 100 == 0, 3).collect():
        order = [i for i in np.argsort(-(n @ n[r["query"]])) if i != r["query"]]
        assert order[r["rank"] - 1] == r["neighbour"]


def test_the_cell_index_finds_nearly_what_brute_force_finds(spark):
    import numpy as np

    r = np.random.default_rng(2)
    m = np.concatenate([r.normal(size=8) * 2 + r.normal(size=(90, 8)) for _ in range(8)] + [np.tile(r.normal(size=8), (60, 1))])
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(m)] + [(9999, None, "x")], "vec_id long, e array<double>, v string").repartition(3)
    exact = {(x["query"], x["neighbour"]) for x in analytics.nearest(df.drop("v"), "vec_id", "e", F.col("vec_id") % 50 == 0, 5).collect()}
    index = analytics.CellIndex(df, "vec_id", "e", 16)
    got = [(x["query"], x["neighbour"]) for x in index.search(df.where("vec_id % 50 = 0"), 5, 6).collect()]
    assert len(got) == len(set(got)) and len(exact & set(got)) / len(exact) >= 0.9
    none = df.where("false")
    assert analytics.CellIndex(none, "vec_id", "e", 4).search(df, 3, 2).count() == 0


def test_sequences(spark):
    ev = spark.createDataFrame([("k", 1, "open"), ("k", 2, "close"), ("k", 3, "read"), ("k", 4, "open"), ("k", 5, "read")], "k string, t int, a string")
    assert [r["t"] for r in sequences.used_after_close(ev, "k", ["t"], F.col("a") == "open", F.col("a") == "close").collect()] == [3]
    lines = spark.createDataFrame([("f", i, "# x" if i in (1, 2, 3, 4, 5, 8, 9) else "y") for i in range(1, 11)], "file string, line_no int, text string")
    assert [tuple(r) for r in sequences.runs(lines, F.col("text").startswith("#")).collect()] == [("f", 1, 5)]


def test_report_parts_hold_all_results(spark):
    import json

    rows = [("e", f"p{i % 7}", f"r{i}", "low", "m", "f", i) for i in range(50)]
    df = spark.createDataFrame(rows, "engine string, fingerprint string, rule_id string, severity string, message string, file string, start_line int")
    docs = sarif(df, results_per_part=20).collect()
    runs = [json.loads(r["report"])["runs"][0] for r in docs]
    assert len(docs) > 1 and sum(len(r["results"]) for r in runs) == 50
    assert {x["id"] for r in runs for x in r["tool"]["driver"]["rules"]} == {f"r{i}" for i in range(50)}
    more = df.withColumns({"source_line": F.when(F.col("start_line") == 3, 1), "failed": F.when(F.col("start_line") == 4, "timed out")})
    run = [json.loads(r["report"])["runs"][0] for r in sarif(more).collect()][0]
    flow = [x["codeFlows"] for x in run["results"] if "codeFlows" in x]
    assert len(flow) == 1 and [p["location"]["physicalLocation"]["region"]["startLine"] for p in flow[0][0]["threadFlows"][0]["locations"]] == [1, 3]
    assert len(run["results"]) == 49 and run["invocations"][0] == {"executionSuccessful": False, "toolExecutionNotifications": [{"level": "error", "message": {"text": "timed out"}}]}


def test_other_sinks(spark, tmp_path):
    import json

    from siftline import report

    deps = spark.createDataFrame([("pip", "a", "1", "MIT"), ("pip", "a", "1", "MIT"), ("pip", "b", None, None)], "ecosystem string, name string, version string, licence string")
    bom = json.loads(report.sbom(deps).collect()[0]["bom"])
    assert bom["bomFormat"] == "CycloneDX" and [(c["name"], c["version"]) for c in bom["components"]] == [("a", "1"), ("b", "latest")] and bom["components"][0]["licenses"] == [{"license": {"name": "MIT"}}]
    doc = json.loads(report.spdx(deps).collect()[0]["spdx"])
    assert doc["spdxVersion"] == "SPDX-2.3" and [p["licenseDeclared"] for p in sorted(doc["packages"], key=lambda p: p["name"])] == ["MIT", "NOASSERTION"]
    rows = [("e", f"p{i}", f"r{i}", s, "<m>", "f", i) for i, s in enumerate(["low", "critical", "info"])]
    df = spark.createDataFrame(rows, "engine string, fingerprint string, rule_id string, severity string, message string, file string, start_line int")
    page = report.html(df, most=2)
    assert page.count("<tr class") == 2 and page.index("r1") < page.index("r0") and "&lt;m&gt;" in page and "info: 1" in page
    assert len(report.save_all(df, str(tmp_path / "out"))) == 3 and (tmp_path / "out/report.html").exists()
