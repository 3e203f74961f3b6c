"""The driver's tables as the engine's relations, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import schema
from siftline.runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern hits and tree findings as one findings relation; repeated rows are kept."""
    hits = table(spark, sf_dir, "yaml_hits").select(
        F.lit("L0_fast").alias("layer"), F.concat(F.lit("L0.yaml."), "rule_id").alias("rule_id"), "message", "file",
        F.col("line").alias("start_line"), schema.severity_of(F.col("severity")).alias("severity"), F.lit(0.7).alias("confidence"),
        F.lit("module").alias("blast_radius"), F.lit(0.5).alias("exploitability"), F.upper(F.btrim("cwe")).alias("cwe"), F.lit("yaml").alias("engine"),
    )
    security = F.lower("category") == "security"
    trees = table(spark, sf_dir, "ast_findings").select(
        F.lit("L3_invariants").alias("layer"), F.concat(F.lit("L0.ast."), "rule_id").alias("rule_id"), F.col("description").alias("message"), "file",
        F.col("line").alias("start_line"), schema.severity_of(F.col("severity")).alias("severity"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.when(security, "system").otherwise("function").alias("blast_radius"), F.when(security, 0.9).otherwise(0.2).alias("exploitability"),
        F.coalesce("category", F.lit("correctness")).alias("category"), F.upper(F.btrim("cwe")).alias("cwe"), F.lit("ast").alias("engine"),
    )
    return schema.as_findings(hits).unionByName(schema.as_findings(trees))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, file, kind, confidence, labeled_at): verdicts with the canonical kind; unusable ones are left out."""
    from siftline.functions.keys import squeezed

    kind = squeezed(F.col("kind"))
    names = {"tp": "tp", "truepositive": "tp", "fp": "fp", "falsepositive": "fp", "fn": "fn", "falsenegative": "fn"}
    return table(spark, sf_dir, "feedback_entries").select("entry_id", "rule_id", "file", "line", "labeled_at", schema.lookup(kind, names).alias("kind")).where("kind is not null")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, text, doc_id) of all documents."""
    from siftline.sources.files import lines_of

    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id").alias("file"), F.col("text").alias("content"), "doc_id"
    )
    return lines_of(docs)


_SEV = "case when lower(trim(severity)) in ('info','low','medium','high','critical') then lower(trim(severity)) when lower(trim(severity)) = 'error' then 'high' when lower(trim(severity)) = 'note' then 'low' else 'medium' end"
FINDINGS_SQL = f"""
raw_findings as (
  select 'L0_fast' as layer, 'L0.yaml.' || rule_id rule_id, message, file, line start_line, {_SEV} severity, cast(0.7 as double) confidence,
    'module' blast_radius, cast(0.5 as double) exploitability, 'correctness' category, upper(trim(cwe)) cwe, 'yaml' engine from yaml_hits
  union all
  select 'L3_invariants', 'L0.ast.' || rule_id, description, file, line, {_SEV}, coalesce(confidence, 0.5),
    case when lower(category) = 'security' then 'system' else 'function' end, case when lower(category) = 'security' then 0.9 else 0.2 end,
    coalesce(category, 'correctness'), upper(trim(cwe)), 'ast' from ast_findings
), findings as (
  select *, substr(sha256('LayerID.' || upper(layer) || '|' || coalesce(rule_id, '') || '|' || coalesce(file, '') || ':' || coalesce(cast(start_line as varchar), '0') || '|' || coalesce(message, '')), 1, 16) fingerprint
  from raw_findings
)"""

_KIND = "lower(regexp_replace(kind, '[ \\t_-]', '', 'g'))"
FEEDBACK_SQL = f"""
feedback as (
  select entry_id, rule_id, file, line, labeled_at, case when {_KIND} in ('tp', 'truepositive') then 'tp' when {_KIND} in ('fp', 'falsepositive') then 'fp' when {_KIND} in ('fn', 'falsenegative') then 'fn' end kind
  from feedback_entries qualify kind is not null
)"""
FEEDBACK_SQL = FEEDBACK_SQL.replace(" qualify kind is not null", "")
FEEDBACK_SQL = FEEDBACK_SQL.replace("feedback as (", "feedback_all as (") + ", feedback as (select * from feedback_all where kind is not null)"

LINES_SQL = """
split_lines as (
  select coalesce(source, 'none') || '/' || doc_id file, doc_id, unnest(string_split(regexp_replace(text, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), chr(10))) as text,
    generate_subscripts(string_split(regexp_replace(text, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), chr(10)), 1) line_no,
    len(string_split(regexp_replace(text, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), chr(10))) line_count
  from documents
), lines as (select file, doc_id, line_no, text from split_lines where text <> '' or line_no < line_count)"""
