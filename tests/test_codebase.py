"""Relations of code parts, flows, fixes, blocks and whole scans, against brute force and hand-written expectations."""

import random

from pyspark.sql import functions as F

from siftline.operators import analytics, blocks, codebase, dataflow, detectors, fixes, metrics, scan, sequences, triage
from siftline.plans import pipeline

LINE = "file string, line_no int, text string"


def test_blocks_agree_with_whole_file_windows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    r = random.Random(2)
    rows = [(f, n, r.choice(["#", "H", "x", ""])) for f in "ab" for n in sorted(r.sample(range(1, 90), 60))]
    lines = spark.createDataFrame(rows, LINE)
    text = F.col("text")
    by = {f: {n: t for g, n, t in rows if g == f} for f in "ab"}
    carried = {(x["file"], x["line_no"]): x["h"] for x in sequences.carried(lines, F.when(text == "H", F.col("line_no")), "h").collect()}
    assert carried == {(f, n): max((m for m, t in by[f].items() if t == "H" and m <= n), default=None) for f in by for n in by[f]}
    sums = {(x["file"], x["line_no"]): x["s"] for x in blocks.running_sum(lines, (text == "x").cast("int"), "s").collect()}
    assert sums == {(f, n): sum(t == "x" for m, t in by[f].items() if m <= n) for f in by for n in by[f]}
    runs = {tuple(x) for x in sequences.runs(lines, text.isin("#", "x"), 2).collect()}
    want = set()
    for f, ls in by.items():
        for n in ls:
            if ls[n] in "#x" and ls[n] and ls.get(n - 1, "") not in ("#", "x"):
                k = 0
                while ls.get(n + k, "") in ("#", "x"):
                    k += 1
                want |= {(f, n, k)} if k >= 2 else set()
    assert runs == want and len(want) > 3
    ahead = {(x["file"], x["line_no"]): x["followed"] for x in sequences.followed_within(lines, text == "H", text == "#", 6).collect()}
    assert ahead == {(f, n): any(by[f].get(n + i) == "#" for i in range(1, 7)) for f in by for n in by[f] if by[f][n] == "H"}
    ends = {(x["file"], x["line_no"]): x["end_line"] for x in sequences.extents(lines, F.when(text == "H", F.lit("h")), 5).collect()}
    assert ends == {(f, n): min([n + 5, *(m - 1 for m, t in by[f].items() if t == "H" and m > n)]) for f in by for n in by[f] if by[f][n] == "H"}


JS = """function show(req) {
  const name = req.query.name;
  const n = parseInt(req.query.n);
  let text = "a" + name;
  box.innerHTML = text;
  run(n);
  eval(escape(name));
  db.query("select " + name);
}
function other() {
  document.write(text);
  eval(req.body.code);
  // eval(req.body.code)
}
"""
JAVA = """public void go(@RequestParam(required = false) String id, HttpServletRequest request) {
    String q = request.getParameter("q");
    Order o = repo.findById(id);
    stmt.executeQuery("select " + q);
    int k = Integer.parseInt(q);
    stmt.executeQuery("select " + k);
    user.setRole(id);
}
"""


def test_flows(spark):
    files = spark.createDataFrame([("a.js", JS), ("b.java", JAVA), ("c.js", None), ("d.txt", "x = Object.assign(user, req.body)"), ("e.py", "v = request.form['x']\nuser.is_admin = v\nUser.objects.get(id=v)")], "file string, content string")
    rows = dataflow.flows(files).collect()
    got = {(r["file"], r["line"], r["sink"], r["variable"]) for r in rows}
    assert {x for x in got if x[0] == "a.js"} == {("a.js", 5, "innerHTML", "text"), ("a.js", 8, "query", "name"), ("a.js", 12, "eval", "")}
    assert {x for x in got if x[0] == "b.java"} == {("b.java", 4, "executeQuery", "q"), ("b.java", 3, "lookup", "id"), ("b.java", 7, "role", "id")}
    assert {x for x in got if x[0] == "d.txt"} == {("d.txt", 1, "copy", "")} and {x[2] for x in got if x[0] == "e.py"} == {"is_admin", "lookup"}
    assert {r["rule_id"] for r in rows if r["file"] == "a.js"} == {"DF.JS-FLOW-INNERHTML", "DF.JS-FLOW-QUERY", "DF.JS-FLOW-EVAL"}


def test_relations(spark):
    lines = spark.createDataFrame([
        ("a.js", 1, "call('/rows/delete/1')"), ("a.js", 20, "saveData(x)"), ("a.js", 25, "saveData(y)"), ("a.js", 40, "url = `remove/me`"), ("a.js", 71, "saveData(z)"),
        ("b.py", 1, "mode = 'fast-lane'"), ("b.cfg", 1, "speed: fast-lane"), ("b.cfg", 2, "other = $HOME"),
        ("c.java", 1, "auditRepo.save(a)"), ("c.java", 2, "auditRepo.insert(a)"), ("c.java", 3, "orderRepo.save(o)"), ("c.java", 4, "orderRepo.save(o)"), ("c.java", 5, "orderRepo.findById(1)"), ("c.java", 6, "onceRepo.save(o)"),
        ("src/pages/x.jsx", 1, "export default X"), ("src/pages/y.jsx", 1, "const u = useAuth()"), ("src/lib/z.jsx", 1, "x"), ("pages/q.jsx", 1, None),
        ("k1.js", 2, "axios.get(u)"), ("k2.js", 1, "axios.get(u)"), ("k3.js", 1, "axios.post(u); axios.create({})"), ("k4.js", 1, "apiClient.x(); axios.put(u)"),
    ], LINE)
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(codebase.deletions_by_update(lines)) == {("a.js", 1, 20)}
    assert rows(codebase.literals_in_settings(lines, codebase.settings_of(lines.where("file like '%cfg'")))) == {("b.py", 1, "fast-lane", "speed")}
    assert rows(codebase.written_never_read(lines)) == {("audit", 2, "c.java", 1)}
    assert rows(codebase.pages_without_guard(lines)) == {("src/pages/x.jsx",), ("pages/q.jsx",)}
    assert rows(codebase.inconsistent_use(lines, r"\baxios\.(?:get|post|put)\s*\(", r"\baxios\.create\s*\(", r"\bapiClient\b")) == {("k1.js", 2), ("k2.js", 1)}
    fns = spark.createDataFrame([("src/a.py", "load"), ("src/a.py", "save"), ("src/b.py", "run")], "file string, name string")
    tests = spark.createDataFrame([("tests/test_a.py", "def test(): load()"), ("x/tst_b.py", "run")], "file string, content string")
    assert rows(codebase.untested_functions(fns, tests)) == {("src/a.py", "load", True), ("src/a.py", "save", False), ("src/b.py", "run", False)}
    found = spark.createDataFrame([("A", ["yaml.load", "never"]), ("B", ["never"]), ("C", None), ("D", [])], "id string, functions array<string>")
    used = spark.createDataFrame([("f", 1, "yaml.load(x); yaml.load(y)"), ("f", 2, "z = yaml.load (q)")], LINE)
    assert rows(codebase.reachable_advisories(found, used)) == {("A", True, 2), ("B", False, 0), ("C", True, 0), ("D", True, 0)}
    deps = spark.createDataFrame([("boto", "2", "pip", "MIT"), ("python", "3.8", "runtime", None), ("x", "1", "pip", "AGPL-3.0"), ("y", "1", "pip", None)], "name string, version string, ecosystem string, licence string")
    assert {(r["name"], r["problem"]) for r in codebase.dependency_health(deps).collect()} == {("boto", "deprecated: boto3"), ("boto", "mistyped: boto3"), ("python", "ended"), ("x", "licence")}
    u = spark.createDataFrame([("https://h.org/api/v1/rows/{id}?q=1",), ("api/x",), ("https://h.org",), ("/a/b?c",)], "u string")
    assert [r[0] for r in u.select(codebase.endpoint(F.col("u"))).collect()] == ["/api/v1/rows/", "/api/x", "/", "/a/b"]
    pairs = spark.createDataFrame([("f", "load", "a, b"), ("f", "load_v2", "a, b"), ("f", "load_old", "a"), ("g", "x_new", "")], "file string, name string, parameters string")
    assert rows(codebase.refactor_pairs(pairs)) == {("f", "load", "load_v2")}
    contracts = spark.createDataFrame([("f", "c.py", 1, "pre", "lambda x: x > 0"), ("g", "c.py", 5, "pre", "lambda x: x is not None"), ("f", "c.py", 9, "post", "x > 0")], "function string, file string, line int, kind string, condition string")
    calls = spark.createDataFrame([("f", "d.py", 1, "0"), ("f", "d.py", 2, "-3"), ("f", "d.py", 3, "1.5"), ("f", "d.py", 4, None), ("g", "d.py", 5, "None"), ("g", "d.py", 6, "1")], "callee string, file string, line int, first string")
    assert {(r["function"], r["caller_line"]) for r in codebase.contract_breaches(contracts, calls).collect()} == {("f", 1), ("f", 2), ("g", 5)}
    names = spark.createDataFrame([("sortRows",), ("encodeAll",), ("xyz",)], "n string")
    assert [r[0] for r in names.select(codebase.relations_of(F.col("n"))).collect()] == [["idempotent", "same-elements"], ["round-trip"], []]
    nodes = spark.createDataFrame([("load path", "x", "f", 1), ("y", "the path", "path/f", 2), ("z", "q", "f", 3)], "name string, summary string, file string, line int")
    assert [(r["line"], r["score"]) for r in codebase.search(nodes, "Path").collect()] == [(1, 3), (2, 3)]


def test_every_fix_does_what_it_says(spark):
    ext = {"python": "py", "javascript": "js", "typescript": "ts", "java": "java", "c": "c", "cpp": "cpp", "go": "go", "kotlin": "kt"}
    rows = [(f"a.{ext[f.languages[0]] if f.languages else 'txt'}", i, f.before) for i, f in enumerate(fixes.FIXES)] + [("a.rb", 999, "x == None")]
    got = {(r["line_no"], r["fix"]): r["fixed"] for r in fixes.fixed(spark.createDataFrame(rows, LINE)).collect()}
    assert all(got.get((i, f.rule_id)) == f.after for i, f in enumerate(fixes.FIXES)) and not any(k[0] == 999 for k in got)


def test_mutants_and_the_check_of_findings(spark):
    df = spark.createDataFrame([("a.py", "  y = x.get(1)"), ("a.js", "foo[1]"), ("a.go", "v = 3"), ("a.java", "o.run();")], "f string, t string")
    got = [tuple(r) for r in df.select(*[fixes.mutated(F.col("t"), F.col("f"), s) for s in ("line_removal", "guard_injection")]).collect()]
    assert got == [
        ("  pass  # removed", "  if x is None: return None\n  y = x.get(1)"), ("/* removed */", "if (foo === null || foo === undefined) return;\nfoo[1]"),
        ("// removed", "if v == nil { return }\nv = 3"), (";// removed", "if (o == null) return;\no.run();"),
    ]
    rules = [scan.Rule("eval", r"\beval\("), scan.Rule("any", r"p|r|;|/")]
    hits = spark.createDataFrame([("a.py", 1, "eval(x)", "eval", 0.7), ("a.py", 2, "p = 1", "any", 0.7), ("a.py", 3, "eval(x)", "eval", 0.3), ("a.py", 4, "eval(x)", "eval", 0.95)], LINE + ", rule_id string, confidence double")
    got = {r["line_no"]: (r["survives"], round(r["confidence"], 6)) for r in fixes.counterfactual(hits, rules).collect()}
    assert got == {1: (False, 0.85), 2: (True, 0.5), 3: (None, 0.3), 4: (False, 0.99)}


def test_stripping_and_blocks(spark):
    py = 'x = "a # b"  # gone\n"""doc\nmore"""\ny = \'z\'\n'
    js = "a('x // y'); // gone\n/* one\ntwo */ b();\nc(`t`)\n"
    df = spark.createDataFrame([("a.py", py), ("a.js", js), ("a.py", None), ("a.py", "")], "file string, content string")
    out = [r[0] for r in df.select(metrics.stripped(F.col("content"), F.col("file"))).collect()]
    assert out[0] == "x = ''  \n\n\ny = ''\n" or out[0].split("\n")[0].rstrip() == "x = ''"
    assert "gone" not in out[0] + out[1] and "doc" not in out[0] and "two" not in out[1] and out[0].count("\n") == py.count("\n") and out[1].count("\n") == js.count("\n") and "b();" in out[1] and "x // y" not in out[1]
    assert out[2] is None and out[3] == ""
    t = spark.createDataFrame([("f() { a('}'); { b } } c", 5), ("x { never", 3), ("none", 1), (None, 1)], "t string, at int")
    assert [r[0] for r in t.select(metrics.balanced_block(F.col("t"), F.col("at"))).collect()] == ["{ a('}'); { b } }", "", "", ""]


def test_duplicate_windows_agree_with_brute_force(spark):
    r = random.Random(6)
    shared = " ".join(r.choice(["a", "b1", "if", "return", "(", ")", "7"]) for _ in range(30))
    docs = [(f"f{i}", "\n".join(" ".join(r.choice(["x", "if", "for", "(", "9", "=", "z"]) for _ in range(6)) for _ in range(5)) + ("\n" + shared if i % 2 else "")) for i in range(6)] + [("n", None), ("s", "a b")]
    got = [tuple(x)[1:] for x in analytics.duplicate_windows(spark.createDataFrame(docs, "file string, content string"), 12, 5).collect()]
    import re

    places = {}
    for f, t in docs:
        toks = [("ID" if re.fullmatch(r"[A-Za-z_]\w*", k) and k not in analytics.KEYWORDS else k, n) for n, line in enumerate((t or "").splitlines(), 1) for k in re.findall(r"\w+|[^\s\w]", line)]
        for i in range(len(toks) - 11):
            places.setdefault(tuple(k for k, _ in toks[i : i + 12]), []).append((f, toks[i][1]))
    rows = [(len(p), len({f for f, _ in p}), *min(p)) for p in places.values() if len({f for f, _ in p}) > 1]
    assert sorted(x[0] for x in got) == sorted(x[0] for x in sorted(rows, key=lambda x: (-x[0], x[2], x[3]))[:5]) and len(got) == 5


def test_risk_and_trigrams(spark):
    import math

    body = "if x:\n    eval(password)\nfor y in z:\n    md5(y)\n"
    df = spark.createDataFrame([(body, "a, b"), ("", "")], "b string, a string")
    want = 1 / (1 + math.exp(-(0.1 * 2 + 0.05 * 1 + 0.08 * 1 + 0.3 * 2 + 0.45 * 1 + 0.02 * 2 + 0.005 * 4)))
    got = [r[0] for r in df.select(analytics.risk(F.col("b"), F.col("a"))).collect()]
    assert abs(got[0] - want) < 1e-9 and got[1] == 0.5
    p = spark.createDataFrame([("aaaa", "aaa"), ("abcabc", "abc"), ("x", "abc")], "a string, b string")
    cos = [round(r[0], 6) for r in p.select(analytics.frequency_cosine(analytics.trigram_counts(F.col("a")), analytics.trigram_counts(F.col("b")))).collect()]
    assert cos == [1.0, round(2 / math.sqrt(6), 6), 0.0]


def test_root_causes_by_three_heuristics(spark):
    cols = "file string, start_line int, fingerprint string, rule_id string, message string, cwe string, source string"
    rows = [
        ("f", 10, "k1", "missing-check", "m", None, None), ("f", 20, "c1", "sql-injection", "m", "CWE-89", None), ("f", 40, "c2", "eval-use", "m", "CWE-95", None), ("f", 41, "c3", "eval-use", "m", "CWE-95", None),
        ("f", 60, "c4", "other", "m", "CWE-95", None), ("g", 1, "t1", "taint-flow", "m", None, "req"), ("g", 5, "t2", "taint-flow", "m", None, "req"), ("g", 9, "t3", "taint-flow", "m", None, "file"),
    ]
    got = {tuple(r) for r in triage.root_causes(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("f", 10, "k1", "missing_validation", 2), ("f", 41, "c3", "shared_cwe", 1), ("g", 1, "t1", "shared_source", 1)}


def test_whole_scan(spark):
    lines = spark.createDataFrame([("a.py", 1, "x = eval(y)"), ("a.py", 2, "z = eval(y)  # siftline: ignore"), ("a.py", 4, "password = 'hunter22'"), ("a.py", 6, None)], LINE)
    out = pipeline.full_scan(lines, [*detectors.SECRETS, *detectors.MINI_SAST]).collect()
    assert {(r["start_line"], r["rule_id"], r["decision"]) for r in out} == {(1, "L0.yaml.py-eval-injection", "warn"), (4, "L0.yaml.password-literal", out[0]["decision"] if out[0]["start_line"] == 4 else out[1]["decision"])}
    known = spark.createDataFrame([(out[0]["fingerprint"],)], "fingerprint string")
    assert pipeline.full_scan(lines, [*detectors.SECRETS, *detectors.MINI_SAST], pipeline.State(baseline=known)).count() == 1
    again = pipeline.diff_scan(lines.unionAll(lines), detectors.MINI_SAST, settings=pipeline.Settings(rechecked=("L0.yaml.py-",))).collect()
    assert len(again) == 1 and again[0]["confidence"] > 0.7
    review = pipeline.merge_review(lines.where("line_no > 1"), lines, [*detectors.SECRETS, *detectors.MINI_SAST]).collect()[0]
    assert (review["new"], review["fixed"], review["recommendation"]) == (1, 0, "request_changes")
    none = spark.createDataFrame([], LINE)
    assert pipeline.full_scan(none, detectors.MINI_SAST).count() == 0


def test_foreign_arguments_repairs_and_vetoes(spark):
    header = spark.createDataFrame([("int put(const char *name, double x, int n);",), ("extern void none(void);",), ("int call(struct s *p);",), ("x = 1;",), (None,)], "text string")
    declared = codebase.prototypes(header)
    assert {tuple(r) for r in declared.collect()} == {("put", 0, "char*"), ("put", 1, "double"), ("put", 2, "int"), ("call", 0, "structs*")}
    facts = spark.createDataFrame([("a.py", "constant", "lib.put", 1, p, v) for p, v in ((0, "'a'"), (0, "3"), (1, "2"), (1, "'b'"), (2, "1.5"), (2, "-4"), (0, "None"))] + [("a.py", "constant", "call", 2, 0, "7")], "file string, kind string, name string, line int, position int, detail string")
    got = {(r["function"], r["position"], r["given"]) for r in codebase.foreign_arguments(declared, facts).collect()}
    assert got == {("put", 0, "3"), ("put", 1, "'b'"), ("put", 2, "1.5"), ("call", 0, "7")}
    changes = [("c1", "fix SQL injection", "run('select 1')"), ("c2", "unescaped input", "run(\"select 22\")"), ("c3", "new feature", "run('x')"), ("c4", "fixes bug", "ab"), ("c5", None, "run('x')"), ("c6", "fix bug", None)]
    mined = codebase.mined_from_repairs(spark.createDataFrame(changes, "change string, message string, removed string")).collect()
    assert [tuple(r) for r in mined] == [("injection", "run($STRING)", 2)]
    files = spark.createDataFrame([("a.js", "refundAll(x)\n" + "y" * 600 + "\ncheckOwner(x)\nrefundOne(x)"), ("b.js", None), ("c.js", "")], "file string, content string")
    assert [(r["file"], r["line"], r["rule_id"]) for r in scan.vetoed_matches(files, detectors.BUSINESS, detectors.BUSINESS_VETOES).collect()] == [("a.js", 1, "refund-without-check")]
    tf = spark.createDataFrame([("a.tf", 'x\nresource "aws_kms_key" "k" {\n}\n'), ("b.tf", 'resource "aws_kms_key" "k" {\n enable_key_rotation = true\n}')], "file string, content string")
    assert [(r["file"], r["line"], r["rule_id"]) for r in scan.vetoed_matches(tf, detectors.INFRASTRUCTURE_BLOCKS, "(?!)").collect()] == [("a.tf", 2, "TF-AWS-KMS-ROTATION")]
