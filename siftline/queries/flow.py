"""Whole flows over made lines and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import detectors as d
from siftline.operators import triage as t
from siftline.plans import pipeline
from siftline.queries import triage as tq
from siftline.queries.base import FEEDBACK_SQL, feedback, table
from siftline.queries.code import CODE_SQL, MARKER, _SUPPRESS, code, hits_sql
from siftline.schema import SEVERITY_SCORE

Q: dict = {}
SQL: dict = {}
RULES = [*d.SECRETS, *d.MINI_SAST, *d.POLICY]


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ABOUT = ", ".join(f"('{r.rule_id}', '{r.message}', '{r.cwe}')" for r in RULES)
_ORDER = "layer, rule_id, file nulls first, start_line nulls first, message nulls first, fingerprint"
_FOUND = f"""hits as ({hits_sql(RULES)}), about(rule_id, message, cwe) as (values {_ABOUT}),
raw as (select 'L0_fast' layer, 'L0.yaml.' || rule_id rule_id, message, file, line_no start_line, severity, confidence, cwe from hits join about using (rule_id)),
f0 as (select *, substr(sha256('LayerID.L0_FAST|' || rule_id || '|' || file || ':' || start_line || '|' || message), 1, 16) fingerprint from raw)"""


def _dedup(source: str, name: str, categories, with_message: bool) -> str:
    rule = f"regexp_replace(rule_id, '^L0\\.({'|'.join(categories)})\\.(.+)$', '\\2')"
    keys = f"{rule}, regexp_replace(file, '^[./]+', ''), start_line" + (", substr(coalesce(message, ''), 1, 40)" if with_message else "")
    return f"{name} as (select * from {source} qualify row_number() over (partition by {keys} order by {_ORDER}) = 1)"


def _seeds(source: str) -> str:
    cwe = " ".join(f"when upper(coalesce(cwe, '')) = '{c}' then {s[1]}" for c, s in d.SEEDS.items())
    word = " ".join("when " + " or ".join(f"contains(lower(rule_id || ' ' || message), {tq_text(w.lower())})" for w in s[2]) + f" then {s[1]}" for s in d.SEEDS.values())
    return f"select * replace (least(1.0, confidence + coalesce(0.1 * case {cwe} {word} end, 0.0)) as confidence) from {source}"


def tq_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ENGINE = "case " + " ".join(f"when contains(rule_id, '{k}') then '{v}'" for k, v in t.ENGINES.items()) + " else 'orchestrator' end"
_PATTERN = "case when len(string_split(file, '/')) >= 2 then string_split(file, '/')[-2] || '/' || string_split(file, '/')[-1] else file end"
_KEPT = "select * from f1 where not exists (select 1 from sup s where s.file = f1.file and f1.start_line in (s.line, s.line + 1) and (s.rule_id is null or starts_with(f1.rule_id, 'L0.yaml.' || s.rule_id)))"
_SCORE = "case severity " + " ".join(f"when '{k}' then cast({v} as double)" for k, v in SEVERITY_SCORE.items()) + " end"


def _flow(first: str, last_dedup: bool) -> str:
    tail = _dedup("f4", "f5", t.CATEGORIES_SECOND, False) if last_dedup else "f5 as (select * from f4)"
    return f"""with {CODE_SQL}, {_FOUND}, {first}, {_SUPPRESS}, kept as ({_KEPT}), f2 as ({_seeds('kept')}), eng as (select *, {_ENGINE} engine from f2),
a as (select distinct fingerprint, file, start_line + x.dd as pos, layer || '|' || engine who from eng, (values (-1), (0), (1)) x(dd) where start_line + x.dd > 0), g as (select file, pos, count(distinct who) engines from a group by all having count(distinct who) >= 2),
b as (select fingerprint, arg_max(engines, pos) engines from a join g using (file, pos) group by 1), f3 as (select eng.* replace (least(1.0, confidence + case when engines is null then 0.0 else least(0.2, 0.05 * engines) end) as confidence) from eng left join b using (fingerprint)),
{FEEDBACK_SQL}, learnt as (select 'L0.yaml.' || rule_id r, {_PATTERN} p, count(*) filter (where kind = 'fp') / count(*) rate, count(*) >= 5 and count(*) filter (where kind = 'fp') / count(*) > 0.5 suppressed from feedback where rule_id is not null and file is not null group by 1, 2),
f4 as (select f3.* replace (confidence * (1 - coalesce(rate, 0.0)) as confidence) from f3 left join learnt on f3.rule_id = r and {_PATTERN} = p where not coalesce(suppressed, false)),
{tail}, f6 as (select * from f5 where severity in ('critical', 'high', 'medium', 'low')),
inp as (select fingerprint, {_SCORE} sev, confidence conf, cast(0.5 as double) blast, cast(0.5 as double) expl, cast(0.5 as double) rel, severity from f6 where confidence > 0), {tq.fis_sql('inp')}
select decision, severity, count(*) n from fis group by all"""


def _state(spark, sf):
    verdicts = feedback(spark, sf).withColumn("rule_id", F.concat(F.lit("L0.yaml."), "rule_id"))
    return pipeline.State(feedback=verdicts, issues=table(spark, sf, "issues"), baseline=table(spark, sf, "issue_snapshots").select("fingerprint"))


@query(_flow(_dedup("f0", "f1", t.CATEGORIES_FIRST, True), True))
def pipeline_full(spark, sf):
    """Whole scan of made lines: decisions by severity, with verdicts, issue store and baseline of the tables."""
    return pipeline.summary(pipeline.full_scan(code(spark, sf), RULES, _state(spark, sf), pipeline.Settings(marker=MARKER)))


@query(_flow(f"f1 as (select * from f0 qualify row_number() over (partition by fingerprint order by {_ORDER}) = 1)", False))
def pipeline_diff(spark, sf):
    """Scan of changed lines, here all made lines, deduplicated by fingerprint."""
    return pipeline.summary(pipeline.diff_scan(code(spark, sf), RULES, _state(spark, sf), pipeline.Settings(marker=MARKER)))


@query(f"""with {CODE_SQL}, {_FOUND}, h as (select * from f0 where start_line % 5 <> 0), o as (select * from f0 where start_line % 7 <> 0), x as (select fingerprint, min(severity) severity from h where file in (select file from code where line_no % 2 = 0) and fingerprint not in (select fingerprint from o) group by 1)
select count(*) "new", count(*) filter (where severity = 'critical') critical, count(*) filter (where severity = 'high') high, (select count(distinct fingerprint) from o where fingerprint not in (select fingerprint from h)) fixed,
case when count(*) filter (where severity = 'critical') > 0 then 'block' when count(*) filter (where severity = 'high') > 0 then 'request_changes' else 'approve' end recommendation from x""")
def pipeline_review(spark, sf):
    """Review of a merge: lines without every seventh against lines without every fifth, in the files with an even line."""
    lines = code(spark, sf)
    return pipeline.merge_review(lines.where("line_no % 7 <> 0"), lines.where("line_no % 5 <> 0"), RULES, lines.where("line_no % 2 = 0").select("file"))


QUERIES = Q
