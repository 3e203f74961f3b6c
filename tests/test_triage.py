"""Decisions, filters and learning over small findings."""

import itertools

import pytest
from pyspark.sql import functions as F

from siftline import schema
from siftline.functions import bayes, fuzzy
from siftline.operators import manyrules
from siftline.rules import packs
from siftline.operators import detectors, scan, triage

COLS = "rule_id string, file string, start_line int, severity string, confidence double, blast_radius string, exploitability double, message string, layer string, engine string, cwe string"


def row(rule="r", file="f.py", line=10, severity="medium", confidence=0.7, blast="module", expl=0.5, message="m", layer="L0_fast", engine="", cwe=None):
    return (rule, file, line, severity, confidence, blast, expl, message, layer, engine, cwe)


def made(spark, rows):
    return schema.as_findings(spark.createDataFrame(rows, COLS))


# severity, confidence, blast, exploitability, reliability -> interval and decision
GOLDEN = [
    ("critical", 0.90, "system", 0.95, 0.8, 0.789474, 1.0, "block"), ("critical", 0.85, "system", 0.90, 0.5, 0.736842, 1.0, "block"),
    ("critical", 0.70, "module", 0.50, 0.5, 0.25, 1.0, "uncertain"), ("high", 0.85, "system", 0.90, 0.7, 0.629112, 0.87549, "block"),
    ("high", 0.70, "module", 0.50, 0.5, 0.394737, 0.633333, "warn"), ("medium", 0.70, "module", 0.50, 0.5, 0.5, 0.5, "warn"),
    ("low", 0.70, "module", 0.50, 0.5, 0.144737, 0.431818, "pass"), ("medium", 0.30, "function", 0.0, 0.2, 0.25, 0.289474, "pass"),
    ("low", 0.80, "function", 0.0, 0.5, 0.144737, 0.431818, "pass"), ("info", 0.50, "function", 0.0, 0.5, 0.0, 0.0, "pass"),
    ("critical", 1.0, "system", 1.0, 0.5, 0.0, 0.5, "pass"),
]


def test_fuzzy_golden_values(spark):
    rows = [(i, s, c, b, e, r) for i, (s, c, b, e, r, *_) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i int, severity string, confidence double, blast_radius string, exploitability double, rel double")
    for r in fuzzy.add_decision(df, F.col("rel")).collect():
        *_, low, high, decision = GOLDEN[r["i"]]
        assert (r["fis_lower"], r["fis_upper"]) == (pytest.approx(low, abs=1e-6), pytest.approx(high, abs=1e-6)) and r["decision"] == decision
    closed = fuzzy.add_decision(df.where("i = 10"), F.col("rel"), closed_shoulders=True).collect()[0]
    assert closed["decision"] == "block"


def test_fuzzy_grid_is_an_interval(spark):
    grid = list(itertools.product(["critical", "high", "medium", "low", "info"], [0.0, 0.3, 0.5, 0.9, 1.0], ["function", "module", "system"], [0.0, 0.4, 1.0], [0.0, 0.5, 1.0]))
    df = spark.createDataFrame(grid, "severity string, confidence double, blast_radius string, exploitability double, rel double")
    out = bayes.add_posterior(fuzzy.add_decision(df, F.col("rel")), {"confidence": F.col("confidence"), "reliability": F.col("rel")}, F.col("fis_score"))
    for r in out.collect():
        assert 0 <= r["fis_lower"] <= r["fis_upper"] <= 1
        assert r["p_block"] + r["p_warn"] + r["p_pass"] == pytest.approx(1)


def test_overall_and_gate(spark):
    d = spark.createDataFrame([("warn",), ("uncertain",), ("pass",)], "decision string")
    assert triage.overall(d).collect()[0]["final_decision"] == "warn"
    assert triage.overall(d.where("false")).collect()[0]["final_decision"] == "pass"
    f = made(spark, [row(severity="high")] * 6)
    assert not triage.quality_gate(f, 1000, 0, 5).collect()[0]["passed"] and triage.quality_gate(f, 1000, 0, 6).collect()[0]["passed"]


def test_dedup_is_idempotent_and_normalises(spark):
    f = made(spark, [row("L0.bl.x", "./a.py"), row("x", "a.py"), row("L0.odd.x", "a.py"), row("x", "a.py", message="other")])
    once = triage.deduplicated(f)
    assert once.count() == 3 and triage.deduplicated(once).count() == 3
    assert triage.deduplicated(f, with_message=False).count() == 2


def test_suppression(spark):
    lines = spark.createDataFrame([("a.py", 5, "x  # tool: ignore"), ("a.py", 8, "y # noqa: tool=L0.s"), ("a.py", 20, "# tool: ignore [L9] -- why")], "file string, line_no int, text string")
    c = triage.suppressions(lines, "tool")
    f = made(spark, [row("L0.s.x", "a.py", n) for n in (4, 5, 6, 7, 8, 9, 10, 20, 21)])
    kept, gone = triage.split_suppressed(f, c)
    assert sorted(r["start_line"] for r in gone.collect()) == [5, 6, 8, 9] and kept.count() + gone.count() == 9
    assert {r["reason"] for r in c.collect()} == {None, "why"}


def test_corroboration(spark):
    f = made(spark, [row("a.x", line=10, engine="e1"), row("b.x", line=11, engine="e2"), row("c.x", line=50, engine="e1"), row("d.x", line=50, engine="e1")])
    got = {r["rule_id"]: round(r["confidence"], 6) for r in triage.corroborated(f).collect()}
    assert got == {"a.x": 0.8, "b.x": 0.8, "c.x": 0.7, "d.x": 0.7}


def test_learning_and_calibration(spark):
    fb = spark.createDataFrame([("r", "x/a/b.py", i < 3) for i in range(5)] + [("s", "b.py", True)] * 4, "rule_id string, file string, is_fp boolean")
    learnt = {r["rule_id"]: (r["pattern"], r["suppressed"]) for r in triage.learn_false_positives(fb).collect()}
    assert learnt == {"r": ("a/b.py", True), "s": ("b.py", False)}
    f = made(spark, [row("r", "y/a/b.py"), row("s", "b.py"), row("t", "b.py")])
    assert {r["rule_id"]: r["confidence"] for r in triage.apply_false_positives(f, triage.learn_false_positives(fb)).collect()} == {"s": 0.0, "t": 0.7}
    points = spark.createDataFrame([(0.85, i < 5) for i in range(10)] + [(1.0, True)], "confidence double, correct boolean")
    out = triage.calibrated(made(spark, [row(confidence=0.85), row("q", confidence=0.95)]), triage.calibration_bins(points))
    assert sorted(r["confidence"] for r in out.collect()) == [0.5, 0.95]


def test_strictness_profiles_and_rules(spark):
    f = made(spark, [row(s, severity=s) for s in schema.SEVERITIES])
    assert [triage.at_strictness(f, k).count() for k in range(0, 11)] == [1, 1, 2, 2, 3, 4, 3, 4, 4, 5, 5]
    assert {r["rule_id"] for r in triage.with_profile(f, "medium", ("high", "low"), ("high",)).collect()} == {"medium", "high", "critical"}
    s = triage.rule_stats(spark.createDataFrame([("r", "tp")] * 7 + [("r", "fp")] * 3 + [("s", "fp")] * 5 + [("u", "fn")], "rule_id string, kind string"))
    got = {r["rule_id"]: (r["multiplier"], r["suppressed"]) for r in s.collect()}
    assert got == {"r": (0.8, False), "s": (0.121, True), "u": (1.0, False)}


def test_scans(spark):
    rows = [("a.py", 1, "password = 'hunter22'"), ("a.py", 2, "key = sk-" + "a" * 24), ("a.py", 3, "mail me at x@y.org or x@y.org, 192.168.0.1"), ("a.py", 4, None), ("a.py", 5, "")]
    lines = spark.createDataFrame(rows, "file string, line_no int, text string")
    assert {(r["line_no"], r["rule_id"]) for r in scan.line_hits(lines, detectors.SECRETS).collect()} == {(1, "password-literal"), (2, "api-key")}
    pii = {(r["rule_id"], r["value"]) for r in scan.all_matches(lines, detectors.PII).collect()}
    assert pii == {("email", "x@y.org"), ("ip_address", "192.168.0.1")}
    masked = spark.createDataFrame([("x@y.org", "email"), ("4111111111111111", "credit_card_visa"), ("123-45-6789", "ssn"), ("abcdefgh", "o"), ("abc", "o")], "v string, k string")
    assert [r[0] for r in masked.select(detectors.mask(F.col("v"), F.col("k"))).collect()] == ["*@y.org", "*" * 12 + "1111", "XXX-XX-6789", "ab****gh", "***"]
    assert scan.required_literals(r"\b(?:ab|cd)\s+needed_part\d?x") == (False, {"needed_part"})
    assert scan.required_literals("(?i)Password") == scan.required_literals("Password", True) == (True, {"password"}) and scan.required_literals("(?i:Foo)bar") == (True, {"foo"})
    assert scan.required_literals("eval|exec(?:ute)?") == (False, {"val", "xec"}) and scan.required_literals("a*b?") == (False, frozenset())
    assert scan.lint([scan.Rule("a", "x*"), scan.Rule("b", "(abc"), scan.Rule("c", "abc"), scan.Rule("d", ""), scan.Rule("e", "a+"), scan.Rule("f", "ab+cd")]) == [
        ("a", "matches every line"), ("b", "does not compile"), ("c", "matches any single identifier"), ("d", "no pattern"), ("e", "very short")]


def test_inline_flags_find_every_spelling(spark):
    lines = spark.createDataFrame([("a.py", 1, "PASSWORD here"), ("a.py", 2, "pa\u017f\u017fword"), ("a.py", 3, None)], "file string, line_no int, text string")
    for rules in ([scan.Rule("a", "(?i)password"), scan.Rule("b", "(?i:pass)word"), scan.Rule("c", "password", ignore_case=True)],):
        assert {(r["line_no"], r["rule_id"]) for r in scan.line_hits(lines, rules).collect()} >= {(1, "a"), (1, "c")}
        found = {(r["line_no"], r["rule_id"]) for r in manyrules.many_hits(lines, rules).collect()}
        import re

        want = {(n, r.rule_id) for n, t in ((1, "PASSWORD here"), (2, "pa\u017f\u017fword")) for r in rules if re.search(r.regex(), t)}
        assert found == want


def test_every_rule_finds_its_own_line_and_not_its_counterpart():
    tables = [v for v in vars(detectors).values() if isinstance(v, list) and v and isinstance(v[0], scan.Rule)]
    assert sum(map(len, tables)) > 300
    for rules in tables:
        assert [x for x in scan.tested(rules) if x[2] != x[3]] == [] and len({r.rule_id for r in rules}) == len(rules)
    assert scan.tested([scan.Rule("r", "abc")], [("r", "xabc", True), ("r", "ab", True), ("none", "abc", False)]) == [("r", "xabc", True, True), ("r", "ab", True, False), ("none", "abc", False, False)]


def test_many_rules_agree_with_trying_each(spark):
    import random
    import re

    r = random.Random(3)
    rules = packs.load(packs.names())
    assert len(rules) > 2000 and len({x.rule_id for x in rules}) == len(rules) and scan.lint(rules) == []
    texts = [r.choice(["x = {}(a)", "{}('a' + b)", "y.{}(1)", "# {}", "{} (q)"]).format(r.choice(["eval", "os.system", "db.query", "strcpy", "md5", "print", "File.open"])) for _ in range(60)] + ["", "TODO: API_KEY='abcdefgh'"]
    rows = [(f"a{i}.{r.choice(['py', 'js', 'ts', 'c', 'rb', 'txt', ''])}", i, t) for i, t in enumerate(texts)]
    got = {(x["line_no"], x["rule_id"]) for x in scan.line_hits(spark.createDataFrame(rows, "file string, line_no int, text string"), rules).collect()}
    want = set()
    for f, i, t in rows:
        ext = f.rpartition(".")[2]
        for x in rules:
            if (not x.languages or ext in x.languages or scan.LANGUAGES.get(ext) in x.languages) and re.search(x.regex(), t):
                want.add((i, x.rule_id))
    assert got == want and len(want) > 8


def test_paths_and_packs(spark):
    rules = [scan.Rule("a", "abcd", languages=("python",), skips=("tests/",)), scan.Rule("b", "abcd", paths=("src/",))]
    lines = spark.createDataFrame([("src/a.py", 1, "abcd"), ("tests/a.py", 1, "abcd"), ("src/a.js", 1, "abcd"), (None, 1, "abcd")], "file string, line_no int, text string")
    want = {("src/a.py", "a"), ("src/a.py", "b"), ("src/a.js", "b")}
    for f in (scan.line_hits, manyrules.many_hits):
        assert {(r["file"], r["rule_id"]) for r in f(lines, rules).collect()} == want
    assert packs.selected(spark.createDataFrame([("a.py",), ("b.ts",), ("c",)], "file string")) == ["secrets", "marks", "javascript", "python"]


def test_tables_of_fixed_values():
    assert [detectors.C_CALLS[x] for x in ("gets", "strcpy", "sprintf", "system", "popen", "scanf", "tmpnam", "strncpy", "memcpy", "printf", "rand")] == [5, 5, 5, 5, 5, 4, 4, 3, 3, 2, 1] and len(detectors.C_CALLS) == 43
    assert len(detectors.SEEDS) == 29 and "dangerouslySetInnerHTML" in detectors.SEEDS["CWE-79"][2] and "executemany" in detectors.SEEDS["CWE-89"][2] and detectors.SEEDS["CWE-78"][1] == 0.9


def test_profiles(spark):
    custom = {"tests": {"extends": "relaxed", "disabled_rules": ["x"], "paths": ["t/**"]}}
    assert triage.profile_of("tests", custom) == {"min_severity": "high", "disabled_rules": ("x",), "enabled_rules": (), "paths": ("t/**",), "block_on": ("block",)}
    df = spark.createDataFrame([("auth/a/b.py",), ("tests/x.py",), ("test_y.py",), ("a/test_y.py",), ("c.py",)], "f string")
    assert [r[0] for r in df.select(triage.profile_name(F.col("f"))).collect()] == ["production", "tests", "tests", "default", "default"]
    v = spark.createDataFrame([("block",), ("warn",), ("uncertain",)], "d string")
    assert [tuple(r) for r in v.select(triage.verdict_at(F.col("d"), 5), triage.verdict_at(F.col("d"), 9)).collect()] == [("block", "block"), ("warn", "block"), ("pass", "pass")]


def test_calibration_needs_five_points_and_gate_counts_lines(spark):
    points = spark.createDataFrame([(0.85, True)] * 4, "confidence double, correct boolean")
    assert triage.calibrated(made(spark, [row(confidence=0.85)]), triage.calibration_bins(points)).collect()[0]["confidence"] == 0.85
    f = made(spark, [row(severity="low")] * 21)
    lines = lambda n: spark.range(n).select(F.lit("f").alias("file"))
    assert not triage.gate(f, lines(2000)).collect()[0]["passed"] and triage.gate(f, lines(2100)).collect()[0]["passed"]
