"""Scans: lines, rule tables and detectors over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import detectors as d
from siftline.operators import scan
from siftline.queries.base import LINES_SQL, lines, table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text(rule) -> str:
    return "'" + rule.regex().replace("'", "''") + "'"


def any_hit(rules) -> str:
    return " union all ".join(f"select file, line_no, '{r.rule_id}' rule_id, '{r.severity}' severity, cast({r.confidence} as double) confidence from lines where regexp_matches(text, {text(r)})" for r in rules)


@query(f"with {LINES_SQL} select file, count(*) lines, cast(sum(length(text)) as bigint) chars from lines group by file")
def lines_explode(spark, sf):
    """Line source: lines and characters per file."""
    return lines(spark, sf).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


def _rules_query(name, rules, doc):
    @query(f"with {LINES_SQL} select file, line_no, rule_id, severity, confidence from ({any_hit(rules)})")
    def run(spark, sf):
        return scan.line_hits(lines(spark, sf), rules).select("file", "line_no", "rule_id", "severity", "confidence")

    run.__name__, run.__doc__ = name, doc
    Q[name], SQL[name] = Q.pop("run"), SQL.pop("run")


_rules_query("scan_code", d.CODE, "Risky code constructs, one hit per line and rule.")


@query(" union all ".join(f"select doc_id, '{k}' rule_id from documents where text is not null and not contains(lower(text), '{v}')" for k, v in d.HEADERS.items()))
def missing_headers(spark, sf):
    """Absence test: protective headers a text never mentions."""
    return scan.absent(table(spark, sf, "documents").select("doc_id", "text"), "text", d.HEADERS).select("doc_id", "rule_id")


_MULTI = [scan.Rule("fenced-code", "(?s)```.*?```"), scan.Rule("two-dividers", r"(?s)\n---\n.*\n---\n"), scan.Rule("quoted-thread", r"(?s)\n> .*\n> ")]


@query(" union all ".join(f"select doc_id, '{r.rule_id}' rule_id, len(regexp_extract_all(text, {text(r)})) matches from documents where regexp_matches(text, {text(r)})" for r in _MULTI))
def document_regex(spark, sf):
    """Multi-line rules over whole texts, with the number of matches."""
    return scan.document_hits(table(spark, sf, "documents").select("doc_id", "text"), "text", _MULTI).select("doc_id", "rule_id", "matches")


@query(f"with {LINES_SQL} select file, count(*) n, max(length(text)) longest, count(*) filter (where length(text) > 120) long_lines, count(*) filter (where trim(text) = '') blank_lines from lines group by file")
def file_metrics(spark, sf):
    """Size metrics per file."""
    t = F.col("text")
    return lines(spark, sf).groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length(t)).alias("longest"), F.count_if(F.length(t) > 120).alias("long_lines"), F.count_if(F.btrim(t, F.lit(" ")) == "").alias("blank_lines")
    )


@query(f"with {LINES_SQL}, hits as ({any_hit(d.CODE)}) select rule_id, severity, count(*) n, count(distinct file) files from hits group by all")
def scan_code_summary(spark, sf):
    """Code rules summarised by rule."""
    return scan.line_hits(lines(spark, sf), d.CODE).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


QUERIES = Q
