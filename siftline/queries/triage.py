"""Post-processing of findings over pattern hits and tree findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import bayes, fuzzy
from siftline.functions.keys import key_of, sql_key, sql_state
from siftline.operators import detectors as d
from siftline.operators import triage as t
from siftline.queries.base import FEEDBACK_SQL, FINDINGS_SQL, LINES_SQL, feedback, findings, lines, table
from siftline.schema import DECISION_PRIORITY, SEVERITIES, SEVERITY_SCORE, lookup

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


KEY = ["rule_id", "file", "start_line", "message"]
_ORDER = "layer, rule_id, file nulls first, start_line nulls first, message nulls first, fingerprint"


def _dedup_sql(categories, with_message: bool) -> str:
    rule = f"regexp_replace(rule_id, '^L0\\.({'|'.join(categories)})\\.(.+)$', '\\2')"
    keys = f"{rule}, regexp_replace(file, '^[./]+', ''), start_line" + (", substr(coalesce(message, ''), 1, 40)" if with_message else "")
    return f"with {FINDINGS_SQL}, d as (select * from findings qualify row_number() over (partition by {keys} order by {_ORDER}) = 1) "


@query(_dedup_sql(t.CATEGORIES_FIRST, True) + "select rule_id, file, start_line, message, severity, engine from d")
def dedup_first_wins(spark, sf):
    """First finding per rule, file, line and beginning of the message."""
    return t.deduplicated(findings(spark, sf)).select(*KEY, "severity", "engine")


@query(_dedup_sql(t.CATEGORIES_SECOND, False) + "select rule_id, file, start_line, message, severity, engine from d")
def dedup_normalised_rule(spark, sf):
    """First finding per normalised rule, file and line."""
    return t.deduplicated(findings(spark, sf), with_message=False).select(*KEY, "severity", "engine")


@query(f"with {FINDINGS_SQL} select fingerprint, count(*) n from findings group by 1")
def fingerprint_sha256(spark, sf):
    """Fingerprints of findings and how often each occurs."""
    return findings(spark, sf).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


_SUP = f"""
{LINES_SQL}, c as (
  select file, line_no as line, nullif(regexp_extract(text, '(?i)remark:\\s*(\\S+)', 1), '') rule_id from lines where regexp_matches(text, '(?i)remark:\\s*(\\S+)')
)"""


_BAND = "from findings f {} (select file, line as sl from ast_findings where category = 'config' union all select file, line + 1 from ast_findings where category = 'config') s on f.file = s.file and f.start_line = s.sl"


def _marks(spark, sf):
    return table(spark, sf, "ast_findings").where("category = 'config'").select("file", "line", F.lit(None).cast("string").alias("rule_id"))


@query(f"with {FINDINGS_SQL} select fingerprint, count(*) n {_BAND.format('anti join')} group by 1")
def suppression_band_anti(spark, sf):
    """Findings that no mark on their own or the preceding line covers."""
    return t.split_suppressed(findings(spark, sf), _marks(spark, sf))[0].groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {FINDINGS_SQL} select fingerprint, count(*) n {_BAND.format('semi join')} group by 1")
def suppression_band_semi(spark, sf):
    """Findings that a mark on their own or the preceding line covers."""
    return t.split_suppressed(findings(spark, sf), _marks(spark, sf))[1].groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


_ENGINE = "case " + " ".join(f"when contains(rule_id, '{k}') then '{v}'" for k, v in t.ENGINES.items()) + " else 'orchestrator' end"


@query(f"with {FINDINGS_SQL} select {_ENGINE} engine, count(*) n from findings group by 1")
def engine_tags(spark, sf):
    """Detector names derived from rule names."""
    return t.with_engine(findings(spark, sf).withColumn("engine", F.lit(""))).groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


_CORR = f"""with {FINDINGS_SQL}, f as (select distinct * from findings),
a as (select fingerprint, file, start_line + x.d as pos, layer || '|' || engine who from f, (values (-1), (0), (1)) x(d) where file <> '' and start_line > 0 and start_line + x.d > 0),
g as (select file, pos, count(distinct who) engines from a group by all having count(distinct who) >= 2),
b as (select fingerprint, arg_max(engines, pos) engines from a join g using (file, pos) group by 1)
"""


@query(_CORR + "select fingerprint, round(least(1.0, confidence + case when engines is null then 0.0 else least(0.2, 0.05 * engines) end), 6) confidence, round(cast(case when engines is null then 0.0 else least(0.2, 0.05 * engines) end as double), 6) boost from f left join b using (fingerprint)")
def corroborate_band(spark, sf):
    """Confidence raised where engines agree within one line."""
    return t.corroborated(findings(spark, sf).distinct()).select("fingerprint", F.round("confidence", 6).alias("confidence"), F.round("boost", 6).alias("boost"))


_PATTERN = "case when len(string_split(file, '/')) >= 2 then string_split(file, '/')[-2] || '/' || string_split(file, '/')[-1] else file end"


@query(f"with {FEEDBACK_SQL} select rule_id, {_PATTERN} pattern, count(*) occurrences, count(*) filter (where kind = 'fp') fps, round(count(*) filter (where kind = 'fp') / count(*), 6) rate, count(*) >= 5 and count(*) filter (where kind = 'fp') / count(*) > 0.5 suppressed from feedback group by 1, 2")
def fp_learning_rate(spark, sf):
    """False-positive rate per rule and file pattern."""
    learnt = t.learn_false_positives(feedback(spark, sf).withColumn("is_fp", F.col("kind") == "fp"))
    return learnt.select("rule_id", "pattern", "occurrences", "fps", F.round("rate", 6).alias("rate"), "suppressed")


_LEARNT = f"{FEEDBACK_SQL}, learnt as (select rule_id r, {_PATTERN} p, count(*) filter (where kind = 'fp') / count(*) rate, count(*) >= 5 and count(*) filter (where kind = 'fp') / count(*) > 0.5 suppressed from feedback where rule_id is not null and file is not null group by 1, 2)"


@query(f"with {_LEARNT} select i.rule_id, count(*) n, round(sum(0.7 * (1 - coalesce(rate, 0))), 4) total_confidence from issues i left join learnt on i.rule_id = r and {_PATTERN} = p where not coalesce(suppressed, false) group by 1")
def fp_filter(spark, sf):
    """Issues after false-positive learning: suppressed patterns dropped, confidence scaled."""
    learnt = t.learn_false_positives(feedback(spark, sf).withColumn("is_fp", F.col("kind") == "fp"))
    left = t.apply_false_positives(table(spark, sf, "issues").select("rule_id", "file", F.lit(0.7).alias("confidence")), learnt)
    return left.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("total_confidence"))


_POINTS = f"{FEEDBACK_SQL}, sv as (select {sql_key('fingerprint')} k, min(case lower(trim(severity)) {' '.join(f"when '{x}' then cast({v} as double)" for x, v in SEVERITY_SCORE.items())} else 0.5 end) c from issues where {sql_key('fingerprint')} is not null group by 1), points as (select c confidence, f.kind = 'tp' correct from feedback_entries e join feedback f using (entry_id) join sv on sv.k = {sql_key('e.finding_key')})"


def _points(spark, sf):
    """What the severity of an issue promised, against the verdicts on it."""
    score = F.min(F.coalesce(lookup(F.lower(F.btrim("severity", F.lit(" "))), SEVERITY_SCORE), F.lit(0.5)))
    issues = table(spark, sf, "issues").groupBy(key_of(F.col("fingerprint")).alias("k")).agg(score.alias("confidence")).where("k is not null")
    keys = table(spark, sf, "feedback_entries").select("entry_id", key_of(F.col("finding_key")).alias("k"))
    return keys.join(feedback(spark, sf).select("entry_id", "kind"), "entry_id").join(issues, "k").select("confidence", (F.col("kind") == "tp").alias("correct"))


@query(f"with {_POINTS} select cast(least(9, floor(confidence * 10)) as integer) bin, count(*) total, count(*) filter (where correct) correct, round(count(*) filter (where correct) / count(*), 6) accuracy from points group by 1")
def calibration_bins(spark, sf):
    """Accuracy per confidence bin."""
    return t.calibration_bins(_points(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"with {_POINTS}, bins as (select least(9, floor(confidence * 10)) bin, count(*) total, count(*) filter (where correct) / count(*) accuracy from points group by 1), {FINDINGS_SQL} select fingerprint, round(min(coalesce(accuracy, confidence)), 6) confidence from findings left join bins on bin = least(9, floor(confidence * 10)) and total >= 5 group by 1")
def calibrated_confidence(spark, sf):
    """Findings with the measured accuracy of their confidence bin."""
    out = t.calibrated(findings(spark, sf), t.calibration_bins(_points(spark, sf)))
    return out.groupBy("fingerprint").agg(F.round(F.min("confidence"), 6).alias("confidence"))


_STATS = f"""{FEEDBACK_SQL}, s as (
  select rule_id, count(*) filter (where kind = 'tp') tp, count(*) filter (where kind = 'fp') fp, count(*) filter (where kind = 'fn') fn from feedback group by 1
), stats as (
  select *, case when tp + fp > 0 then tp / (tp + fp) else 0.5 end as precision_, case when tp + fn > 0 then tp / (tp + fn) else 0.5 end as recall_ from s
), mult as (
  select *, case when tp + fp = 0 then 1.0 else round(0.1 + 1.4 / (1 + exp(-6 * (precision_ - 0.7))), 3) end multiplier, tp + fp >= 5 and precision_ < 0.2 suppressed from stats
)"""


@query(f"with {_STATS} select rule_id, tp, fp, fn, round(precision_, 6) as precision, round(recall_, 6) as recall, multiplier, suppressed from mult")
def tuner_multiplier(spark, sf):
    """Precision, recall and confidence multiplier per rule."""
    s = t.rule_stats(feedback(spark, sf))
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"with {_STATS} select rule_id as key, case when precision_ < 0.6 then round(least(0.1, (0.6 - precision_) * 0.5), 6) else 0.0 end as widen, case when recall_ < 0.6 then round(least(0.1, (0.6 - recall_) * 0.5), 6) else 0.0 end as shift from mult where tp + fp + fn >= 5")
def tuning_adjustments(spark, sf):
    """Widening and shift per rule from low precision and recall."""
    a = t.tuning_adjustments(t.rule_stats(feedback(spark, sf)))
    return a.withColumns({c: F.round(c, 6) for c in ("widen", "shift")})


@query(f"with {_STATS}, j as (select i.rule_id, case when coalesce(suppressed, false) then 0.0 else least(1.0, greatest(0.0, 0.7 * coalesce(multiplier, 1.0))) end c from issues i left join mult m on i.rule_id = m.rule_id) select rule_id, count(*) n, round(min(c), 6) confidence from j where c > 0 group by 1")
def tuned_confidence(spark, sf):
    """Issues with their rule's multiplier; suppressed rules are gone."""
    out = t.tuned(table(spark, sf, "issues").select("rule_id", F.lit(0.7).alias("confidence")), t.rule_stats(feedback(spark, sf)))
    return out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("confidence"), 6).alias("confidence"))


@query(f"with {FEEDBACK_SQL}, k as (select {sql_key('fingerprint')} k, any_value(layer) layer from (select fingerprint, min(layer) layer from issues group by 1) group by 1), j as (select e.entry_id, f.kind, {sql_key('e.finding_key')} k from feedback_entries e join feedback f using (entry_id)), s as (select layer, count(*) filter (where kind = 'tp') tp, count(*) filter (where kind = 'fp') fp, count(*) filter (where kind = 'fn') fn from (select distinct j.entry_id, j.kind, k.layer from j join (select {sql_key('fingerprint')} k, min(layer) layer from issues group by 1) k on j.k = k.k) group by 1), r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end q from s) select layer, tp, fp, fn, round(p, 6) as precision, round(q, 6) as recall, round(case when p + q = 0 then 0.5 else (p + q) / 2 end, 6) reliability from r")
def layer_reliability(spark, sf):
    """Precision, recall and reliability per layer, from verdicts joined with their issues."""
    layers = table(spark, sf, "issues").select(key_of(F.col("fingerprint")).alias("k"), "layer").where("k is not null").groupBy("k").agg(F.min("layer").alias("layer"))
    keys = table(spark, sf, "feedback_entries").select("entry_id", key_of(F.col("finding_key")).alias("k"))
    v = feedback(spark, sf).select("entry_id", "kind").join(keys, "entry_id").distinct().join(layers, "k").select("entry_id", "kind", "layer").distinct()
    s = v.groupBy("layer").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    return t.layer_reliability(s).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "reliability")})


@query(f"with {FINDINGS_SQL} " + " union all ".join(f"select {k} level, severity, count(*) n from findings where severity in ({', '.join(repr(s) for s in v)}) group by all" for k, v in t.STRICTNESS.items()))
def strictness_levels(spark, sf):
    """Findings reported at each of the nine strictness levels, from one aggregation."""
    counts = findings(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.array(*[F.lit(s) for s in v]).alias("on")) for k, v in t.STRICTNESS.items()])
    return counts.withColumn("l", F.explode(levels)).where(F.array_contains(F.col("l.on"), F.col("severity"))).select("l.level", "severity", "n")


@query(f"with {FINDINGS_SQL} select fingerprint, count(*) n from findings where severity in ('medium', 'high', 'critical') and rule_id not in ('L0.yaml.python-import-idle', 'L0.ast.AST-PY-LITERAL-NUMBER') group by 1")
def profile_filter(spark, sf):
    """A profile's findings: least severity, disabled rules, one of them enabled again."""
    off = ("L0.yaml.python-import-idle", "L0.ast.AST-PY-LITERAL-NUMBER", "L0.yaml.go-log-forging")
    return t.with_profile(findings(spark, sf), "medium", off, ("L0.yaml.go-log-forging",)).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {FINDINGS_SQL} select rule_id, case when rule_id = 'L0.yaml.java-log-forging' then 'high' else severity end severity, count(*) n from findings where rule_id <> 'L0.yaml.java-wait-forever' and not (rule_id = 'L0.yaml.python-path-escape' and (file is null or not regexp_matches(file, '^core/'))) group by all")
def rule_config_override(spark, sf):
    """Per-rule configuration: inactive, limited to a folder, severity overridden."""
    config = spark.createDataFrame(
        [("L0.yaml.java-wait-forever", False, None, None, None), ("L0.yaml.java-log-forging", True, "warning", None, None), ("L0.yaml.python-path-escape", True, None, "^core/", None)],
        "rule_id string, active boolean, severity_override string, include string, exclude string",
    )
    return t.with_rule_config(findings(spark, sf), config).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def _member(x: str, name: str, term: str) -> tuple[str, str]:
    if name in fuzzy.TRIANGLES:
        a, b, dd, foot = fuzzy.TRIANGLES[name][term]
        lo, up = (b + foot / 2,) * 2, (b - foot / 2,) * 2
    else:
        a, b, c, dd, foot = fuzzy.TRAPEZOIDS[name][term]
        lo, up = (b + foot / 2, c - foot / 2), (b - foot / 2, c + foot / 2)

    def shape(p, q):
        rise = f"({x} - {a}) / cast({p - a!r} as double)" if p > a else "1.0"
        fall = f"({dd} - {x}) / cast({dd - q!r} as double)" if dd > q else "1.0"
        return f"case when {x} < {a} or {x} > {dd} then 0.0 when {x} between {p!r} and {q!r} then 1.0 when {x} < {p!r} then {rise} else {fall} end"

    low = f"greatest(0.0, least(1.0, {shape(*lo)}))"
    return low, f"greatest({low}, least(1.0, {shape(*up)}))"


def fis_sql(source: str) -> str:
    """CTEs from ``source`` (fingerprint, sev, conf, blast, expl, rel) to ``fis`` with lower, upper, score and decision."""
    columns = {"severity": "sev", "confidence": "conf", "blast": "blast", "exploitability": "expl", "reliability": "rel"}
    short = {"severity": "s", "confidence": "c", "blast": "b", "exploitability": "e", "reliability": "r"}
    members = []
    for n, ts in {**fuzzy.TRAPEZOIDS, **fuzzy.TRIANGLES}.items():
        for k in ts:
            lo, up = _member(columns[n], n, k)
            members += [f"{lo} {short[n]}_{k}_l", f"{up} {short[n]}_{k}_u"]
    out = []
    for side in "lu":
        for dec in fuzzy.CENTROIDS:
            rules = [", ".join(f"{short[i]}_{p}_{side}" for i, p in zip(fuzzy.INPUTS, r[:5]) if p) for r in fuzzy.RULES if r[5] == dec]
            out.append("greatest(" + ", ".join(f"least({r})" if "," in r else r for r in rules) + f") {dec}_{side}")
    return f"""
m as (select *, {', '.join(members)} from {source}), w as (select *, {', '.join(out)} from m),
y as (select *, 0.5 * warn_l + block_l nl, 0.5 * warn_u + block_u nu, pass_l + warn_l + block_l dl, pass_u + warn_u + block_u du from w),
z as (select *, case when du = 0 then 0.5 else nl / du end one, case when du = 0 or dl = 0 then 0.5 else nu / dl end two from y),
i as (select *, greatest(0.0, least(1.0, least(one, two))) lo from z), k as (select *, greatest(lo, least(1.0, greatest(one, two))) hi from i),
fis as (select *, (lo + hi) / 2 score, case when hi - lo > 0.5 and (lo + hi) / 2 > 0.35 and (lo + hi) / 2 < 0.65 then 'uncertain' when (lo + hi) / 2 < 0.30 then 'pass' when (lo + hi) / 2 < 0.70 then 'warn' else 'block' end decision from k)"""


_SCORE = "case severity " + " ".join(f"when '{k}' then cast({v} as double)" for k, v in SEVERITY_SCORE.items()) + " end"
_INPUT = f"{FINDINGS_SQL}, inp as (select distinct fingerprint, {_SCORE} sev, confidence conf, case blast_radius when 'system' then 1.0 when 'module' then 0.5 else 0.0 end blast, exploitability expl, case when engine = 'ast' then 0.7 else 0.5 end rel from findings)"


def _decided(spark, sf):
    f = findings(spark, sf).dropDuplicates(["fingerprint", "severity", "confidence", "blast_radius", "exploitability", "engine"])
    return fuzzy.add_decision(f, F.when(F.col("engine") == "ast", 0.7).otherwise(0.5))


@query(f"with {_INPUT}, {fis_sql('inp')} select fingerprint, round(lo, 6) fis_lower, round(hi, 6) fis_upper, decision from fis")
def fis_decision(spark, sf):
    """Interval type-2 fuzzy decision of every finding."""
    return _decided(spark, sf).select("fingerprint", F.round("fis_lower", 6).alias("fis_lower"), F.round("fis_upper", 6).alias("fis_upper"), "decision")


_PRIO = "case decision " + " ".join(f"when '{k}' then {v}" for k, v in DECISION_PRIORITY.items()) + " end"


@query(f"with {_INPUT}, {fis_sql('inp')} select coalesce(arg_max(decision, {_PRIO}), 'pass') final_decision, count(*) findings from fis")
def final_decision(spark, sf):
    """The decision of highest priority."""
    return t.overall(_decided(spark, sf))


def _bbn(spark, sf):
    return bayes.add_posterior(
        _decided(spark, sf),
        {"confidence": F.col("confidence"), "exploitability": F.col("exploitability"), "reliability": F.when(F.col("engine") == "ast", 0.7).otherwise(0.5), "corroboration": F.lit(0.5), "fp_history": F.lit(0.1)},
        F.col("fis_score"),
    )


def _bbn_sql() -> str:
    blend = "(0.6 * score + 0.4 * expl)"
    level = lambda i: f"case when {blend} >= 0.7 then {bayes.SEVERITY_GIVEN[0][1][i]} when {blend} >= 0.45 then {bayes.SEVERITY_GIVEN[1][1][i]} when {blend} >= 0.25 then {bayes.SEVERITY_GIVEN[2][1][i]} else {bayes.SEVERITY_GIVEN[3][1][i]} end"
    part = lambda dd: " + ".join(f"{s} * (tr * {bayes.DECISION_GIVEN[s, 'yes'][dd]} + (1 - tr) * {bayes.DECISION_GIVEN[s, 'no'][dd]})" for s in ("high", "medium", "low"))
    return f"""
t1 as (select *, cast({level(0)} as double) high, cast({level(1)} as double) medium, cast({level(2)} as double) low, greatest(0.0, least(1.0, 0.5 * rel + 0.3 * 0.5 - 0.4 * 0.1 + 0.2)) tr from fis),
t2 as (select *, ({part(0)}) * (0.5 + conf) * (0.5 + expl) * (0.5 + rel) * 1.0 * (1 - 0.9 * 0.1) pb, ({part(1)}) pw, ({part(2)}) * (1.5 - conf) * (1.5 - expl) * (1.5 - rel) * 1.0 * (1 + 0.9 * 0.1) pp from t1),
bbn as (select *, pb / (pb + pw + pp) p_block, pw / (pb + pw + pp) p_warn, pp / (pb + pw + pp) p_pass, case when pb >= pw and pb >= pp then 'block' when pw >= pp then 'warn' else 'pass' end bbn_decision from t2)"""


@query(f"with {_INPUT}, {fis_sql('inp')}, {_bbn_sql()} select fingerprint, round(p_block, 5) p_block, round(p_warn, 5) p_warn, round(p_pass, 5) p_pass, bbn_decision from bbn")
def bbn_posterior(spark, sf):
    """Bayesian posterior of every finding's decision."""
    return _bbn(spark, sf).select("fingerprint", *[F.round(c, 5).alias(c) for c in ("p_block", "p_warn", "p_pass")], "bbn_decision")


@query(f"with {_INPUT}, {fis_sql('inp')}, {_bbn_sql()} select fingerprint, case when decision = bbn_decision then decision else 'warn' end joint from bbn")
def explainable_vote(spark, sf):
    """Vote of the fuzzy and the Bayesian decision without a counterfactual check."""
    return _bbn(spark, sf).select("fingerprint", bayes.vote(F.col("decision"), F.col("bbn_decision"), F.lit(None).cast("boolean")).alias("joint"))


_SEVS = ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in reversed(SEVERITIES))


@query(f"with {FINDINGS_SQL}, c as (select count(*) total, {_SEVS} from findings) select *, round(total / 100.0, 6) density, critical <= 0 and high <= 5 and total / 100.0 <= 10.0 passed from c")
def quality_gate(spark, sf):
    """The balanced quality gate over 100,000 lines."""
    return t.quality_gate(findings(spark, sf), 100_000, 0, 5).withColumn("density", F.round("density", 6))


def _seed_sql() -> str:
    cwe = lambda i: " ".join(f"when upper(coalesce(cwe, '')) = '{c}' then {repr(s[i]) if i == 0 else s[i]}" for c, s in d.SEEDS.items())
    word = lambda i: " ".join("when " + " or ".join(f"contains(lower(rule_id || ' ' || message), '{w.lower().replace(chr(39), chr(39) * 2)}')" for w in s[2]) + f" then {repr(s[i]) if i == 0 else s[i]}" for s in d.SEEDS.values())
    return f"case {cwe(0)} {word(0)} end seed, least(1.0, confidence + coalesce(0.1 * case {cwe(1)} {word(1)} end, 0.0)) conf2"


@query(f"with {FINDINGS_SQL}, s as (select fingerprint, {_seed_sql()} from findings) select fingerprint, seed, round(max(conf2), 6) confidence from s group by all")
def seed_boost(spark, sf):
    """Confidence raised by known bug patterns."""
    return t.seed_boosted(findings(spark, sf), d.SEEDS).groupBy("fingerprint", "seed").agg(F.round(F.max("confidence"), 6).alias("confidence"))


_KNOWN = [("CWE-89", "python", "A-1"), ("CWE-89", "python", "A-2"), ("CWE-89", "java", "A-3"), ("CWE-79", "javascript", "A-4"), ("CWE-22", "go", "A-5"), ("CWE-502", "python", "A-6")]
_LANG = "case lower(regexp_extract(file, '\\.([A-Za-z]+)$', 1)) when 'py' then 'python' when 'java' then 'java' when 'js' then 'javascript' when 'ts' then 'javascript' when 'go' then 'go' when 'rb' then 'ruby' when 'php' then 'php' when 'kt' then 'java' when 'cs' then 'csharp' end"


@query(f"with {FINDINGS_SQL}, k(cwe, language, advisory) as (values {', '.join(map(str, _KNOWN))}), l as (select cwe, language, string_agg(advisory, ',' order by advisory) known from k group by all) select fingerprint, min(l.known) known from findings f left join l on f.cwe = l.cwe and {_LANG} = l.language group by 1")
def cve_enrich(spark, sf):
    """Known advisories by weakness and language."""
    known = spark.createDataFrame(_KNOWN, "cwe string, language string, advisory string")
    return t.enriched(findings(spark, sf), known).groupBy("fingerprint").agg(F.min(F.array_join("known", ",")).alias("known"))


_SAYS = "lower(concat_ws(' ', rule_id, message))"


@query(f"""with {FINDINGS_SQL}, f as (select distinct file, start_line, fingerprint, rule_id, message, cwe, regexp_matches({_SAYS}, '{'|'.join(t.CHECK_WORDS)}') chk, regexp_matches({_SAYS}, '{'|'.join(t.CONSEQUENCE_WORDS)}') fol, regexp_extract(message, '(\\w+)\\W*$', 1) src from findings where file is not null and start_line is not null),
c as (select file, start_line cl, min(fingerprint) cause from f where chk group by all), p as (select f.file, f.fingerprint, max(row(cl, cause)) c from f join c on f.file = c.file and f.start_line > cl and f.start_line <= cl + 30 where fol and not chk group by all),
v as (select file, c[1] cause_line, c[2] cause, 'missing_validation' kind, count(*) findings from p group by all), used as (select fingerprint u from p union select c[2] from p), r as (select * from f where fingerprint not in (select u from used)),
w as (select file, arg_min(start_line, row(start_line, fingerprint)) cause_line, arg_min(fingerprint, row(start_line, fingerprint)) cause, 'shared_cwe' kind, count(distinct fingerprint) - 1 findings from r where cwe is not null and cwe <> '' group by file, cwe having count(distinct fingerprint) >= 2),
x as (select file, arg_min(start_line, row(start_line, fingerprint)) cause_line, arg_min(fingerprint, row(start_line, fingerprint)) cause, 'shared_source' kind, count(distinct fingerprint) - 1 findings from r where contains(lower(rule_id), 'taint') and src <> '' group by file, src having count(distinct fingerprint) >= 2)
select * from v union all select * from w union all select * from x""")
def root_causes(spark, sf):
    """Causes and the number of findings that follow from them, by three heuristics."""
    return t.root_causes(findings(spark, sf))



@query(f"with {FINDINGS_SQL} select fingerprint, confidence from findings where confidence between 0.3 and 0.7 group by all")
def uncertain_findings(spark, sf):
    """Findings of middling confidence."""
    return findings(spark, sf).where(F.col("confidence").between(0.3, 0.7)).select("fingerprint", "confidence").distinct()


@query(f"select item_id, {sql_key('fingerprint')} fingerprint from issue_batches where {sql_key('fingerprint')} is not null and {sql_key('fingerprint')} not in (select {sql_key('fingerprint')} from issues where {sql_state('state')} = 'false_positive' and {sql_key('fingerprint')} is not null)")
def known_false_suppressed(spark, sf):
    """Delivered findings that no false positive of the issue store names."""
    items = table(spark, sf, "issue_batches").select("item_id", key_of(F.col("fingerprint")).alias("fingerprint")).where("fingerprint is not null")
    return t.without_known_false(items, table(spark, sf, "issues"))


@query(f"with k as (select {sql_key('fingerprint')} fingerprint, item_id, rule_id, line from issue_batches where {sql_key('fingerprint')} is not null) select fingerprint, item_id, rule_id, line from k qualify row_number() over (partition by fingerprint order by item_id) = 1")
def dedup_by_fingerprint(spark, sf):
    """The first delivery of every fingerprint."""
    items = table(spark, sf, "issue_batches").select(key_of(F.col("fingerprint")).alias("fingerprint"), "item_id", "rule_id", "line").where("fingerprint is not null")
    return t.once_per_fingerprint(items, ["item_id"])


_TWO = f"{FINDINGS_SQL}, two as (select layer, case when hash_ then 'L0.semgrep:' else 'L0.yaml:' end || r rule_id, file, start_line, message, fingerprint, severity from (select *, substr(rule_id, 9) r, unnest([true, false]) hash_ from findings where engine = 'yaml'))"


@query(f"with {_TWO}, d as (select * from two qualify row_number() over (partition by regexp_replace(rule_id, '^L0\\.(semgrep|yaml):', ''), file, start_line order by {_ORDER}) = 1) select rule_id, file, start_line, message, severity from d")
def merge_engines(spark, sf):
    """Two pattern engines' findings as one: the first per rule, file and line."""
    f = findings(spark, sf).where("engine = 'yaml'").withColumn("r", F.expr("substring(rule_id, 9)"))
    two = f.withColumn("p", F.explode(F.array(F.lit("L0.semgrep:"), F.lit("L0.yaml:")))).withColumn("rule_id", F.concat("p", "r")).drop("p", "r")
    return t.merged_engines(two).select("rule_id", "file", "start_line", "message", "severity")


@query(f"with {_INPUT}, {fis_sql('inp')}, l(level) as (select unnest(range(1, 10))), v as (select level, case when decision = 'block' or (level = 9 and decision = 'warn') then 'block' when decision = 'warn' then 'warn' else 'pass' end verdict from fis, l) select cast(level as int) level, verdict, count(*) n from v group by all")
def verdict_by_level(spark, sf):
    """What blocks and what warns at each strictness level."""
    counts = _decided(spark, sf).groupBy("decision").agg(F.count(F.lit(1)).alias("c"))
    ways = F.array(*[F.struct(F.lit(k).alias("level"), t.verdict_at(F.col("decision"), k).alias("verdict")) for k in range(1, 10)])
    return counts.select(F.explode(ways).alias("v"), "c").groupBy("v.level", "v.verdict").agg(F.sum("c").alias("n"))


_GLOBS = {"production": "^(?:auth/.*|crypto/.*|payment/.*|pii/.*|billing/.*)$", "tests": "^(?:tests/.*|test_.*\\.py|.*_test\\.py|gateway/.*)$", "legacy": "^.*/legacy/.*$"}
_CUSTOM = {
    "production": {"min_severity": "low", "paths": ["auth/**", "crypto/**", "payment/**", "pii/**", "billing/**"]}, "tests": {"extends": "relaxed", "paths": ["tests/**", "test_*.py", "*_test.py", "gateway/**"], "disabled_rules": ["L0.yaml.python-import-idle"]},
    "legacy": {"min_severity": "critical", "paths": ["*/legacy/*"]},
}


@query(f"with {FINDINGS_SQL}, p as (select *, case {' '.join(f'when regexp_matches(file, {chr(39)}{g}{chr(39)}) then {chr(39)}{n}{chr(39)}' for n, g in _GLOBS.items())} else 'default' end profile from findings), k as (select * from p where case profile when 'production' then severity <> 'info' when 'tests' then severity in ('high', 'critical') and rule_id <> 'L0.yaml.python-import-idle' when 'legacy' then severity = 'critical' else severity <> 'info' end) select profile, severity, count(*) n from k group by all")
def profiles_by_path(spark, sf):
    """Findings under the profile of their file, one of which inherits from another."""
    kept = t.with_profiles(findings(spark, sf), _CUSTOM)
    return kept.groupBy(t.profile_name(F.col("file"), _CUSTOM).alias("profile"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {FINDINGS_SQL}, {LINES_SQL}, l as (select count(*) loc from lines), c as (select count(*) total, {_SEVS} from findings) select c.*, loc, round(total / greatest(1.0, loc / 1000.0), 6) density, critical <= 0 and high <= 5 and total / greatest(1.0, loc / 1000.0) <= 10.0 passed from c, l")
def gate_over_lines(spark, sf):
    """The balanced gate over as many lines as there are."""
    return t.gate(findings(spark, sf), lines(spark, sf)).withColumn("density", F.round("density", 6))


QUERIES = Q
