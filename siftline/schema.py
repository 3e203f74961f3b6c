"""The findings relation, its dictionaries, and its construction from detector rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Severities with rank and score, blast radius codes, decision priorities, severity aliases.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_SCORE = {"critical": 0.95, "high": 0.75, "medium": 0.50, "low": 0.30, "info": 0.10}
SEVERITY_ALIAS = {"warning": "medium", "error": "high", "note": "low", "unknown": "medium"}
BLAST_CODE = {"function": 0.0, "module": 0.5, "system": 1.0}
DECISION_PRIORITY = {"block": 4, "warn": 3, "uncertain": 2, "pass": 1}

FINDINGS = T.StructType([
    T.StructField("layer", T.StringType()), T.StructField("rule_id", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("file", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("blast_radius", T.StringType()), T.StructField("exploitability", T.DoubleType()),
    T.StructField("category", T.StringType()), T.StructField("cwe", T.StringType()), T.StructField("engine", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
])


def lookup(key: Column, values: dict, default=None) -> Column:
    """A small fixed dictionary as a chain of conditions, which stays inside generated code."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def severity_of(c: Column) -> Column:
    """Canonical severity of any spelling; unknown words and null count as medium."""
    s = F.lower(F.btrim(c))
    return F.when(s.isin(*SEVERITIES), s).otherwise(F.coalesce(lookup(s, SEVERITY_ALIAS), F.lit("medium")))


def severity_rank(c: Column) -> Column:
    return lookup(c, {s: i for i, s in enumerate(SEVERITIES)}, -1)


def severity_score(c: Column) -> Column:
    return lookup(c, SEVERITY_SCORE, 0.5)


def fingerprint(layer: Column, rule: Column, file: Column, line: Column, message: Column) -> Column:
    """First 16 hex digits of the sha256 of the identifying parts; the layer is rendered by its member name."""
    member = F.concat(F.lit("LayerID."), F.upper(layer))
    text = F.concat_ws("|", member, F.coalesce(rule, F.lit("")), F.concat(F.coalesce(file, F.lit("")), F.lit(":"), F.coalesce(line.cast("string"), F.lit("0"))), F.coalesce(message, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 16)


def as_findings(rows: DataFrame) -> DataFrame:
    """Complete detector rows to the findings relation: missing columns get their defaults, the fingerprint is computed."""
    defaults = {
        "layer": F.lit("L0_fast"), "severity": F.lit("medium"), "confidence": F.lit(0.5), "blast_radius": F.lit("function"),
        "exploitability": F.lit(0.0), "category": F.lit("correctness"), "cwe": F.lit(None), "engine": F.lit(""), "message": F.lit(""),
    }
    for name, value in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    rows = rows.withColumn("fingerprint", fingerprint(F.col("layer"), F.col("rule_id"), F.col("file"), F.col("start_line"), F.col("message")))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in FINDINGS.fields])
