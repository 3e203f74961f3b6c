"""Queries p1, p2, p4 and p6: the general training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.keys import sql_key, sql_squeezed, sql_state
from siftline.operators import frequency, orphans, snapshots
from siftline.operators.changes import ChangeTable
from siftline.runtime import work_dir


DELIVERIES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every record at the end of the feed, which arrives in DELIVERIES deliveries by order of arrival."""
    feed = table(spark, sf_dir, "issue_history")
    changes = ChangeTable(spark, work_dir(spark, "changes"))
    ends = feed.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    part = F.coalesce(((F.col("id") - lo) * DELIVERIES / (hi - lo + 1)).cast("int"), F.lit(DELIVERIES - 1))  # a row without id comes last
    for i in range(DELIVERIES):
        changes.apply(feed.where(part == i))
    return changes.state()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed records from each snapshot to the next."""
    found = snapshots.snapshot_changes(table(spark, sf_dir, "issue_snapshots"), work_dir(spark, "snapshots"))
    return found.select("snapshot_no", "fingerprint", "change")


def p2_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes with the columns that differ."""
    return snapshots.snapshot_changes(table(spark, sf_dir, "issue_snapshots"), work_dir(spark, "snapshots"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of the change feed and of the verdicts."""
    history = table(spark, sf_dir, "issue_history")
    refs = orphans.references(history, "issue_history", "fingerprint", "id", "timestamp").unionByName(
        orphans.references(table(spark, sf_dir, "feedback_entries"), "feedback_entries", "finding_key", "entry_id", "labeled_at")
    )
    return orphans.orphan_rows(refs, orphans.parents(table(spark, sf_dir, "issues"), history), work_dir(spark, "orphans"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphans.orphan_report(p4_found(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and files that hold more than 3 % of all rows."""
    return frequency.heavy_values(table(spark, sf_dir, "issues"), ["rule_id", "file"], 0.03).select("field_name", "key_value")


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per rule and per file."""
    return frequency.profile(table(spark, sf_dir, "issues"), ["rule_id", "file"], work_dir(spark, "profile"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_columns, p4_found, p4_report, p6_found, p6_profile)}

_P1 = f"""
with n as (
  select {sql_key('fingerprint')} fp, "timestamp" ts, {sql_squeezed('action')} a, {sql_state('old_state')} o, {sql_state('new_state')} s, id from issue_history
), c as (select fp, ts, a, o, s, min(id) id from n where fp is not null group by fp, ts, a, o, s), k as (
  select *, max(case when a = 'purge' then row(ts, id) end) over (partition by fp) p from c
), live as (select * from k where p is null or row(ts, id) > p),
o as (select fp, min(row(ts, id)) o, arg_min(coalesce(s, 'open'), row(ts, id)) s from live where a = 'open' group by fp),
u as (
  select live.fp, arg_max(live.s, row(ts, id)) s from live join o using (fp)
  where a in ('confirm', 'resolve', 'reopen', 'baseline') and live.s is not null and row(ts, id) > o.o group by live.fp
)
select o.fp as fingerprint, coalesce(u.s, o.s) as state from o left join u using (fp)
"""

_P2_VALUES = {c: f"coalesce({sql_state(c) if c == 'state' else f'cast({c} as varchar)' if c == 'line' else sql_key(c)}, '')" for c in snapshots.COMPARED}
_P2 = f"""
with r as (
  select snapshot_no, {sql_key('fingerprint')} fp, last_seen, {', '.join(f'{v} {c}_' for c, v in _P2_VALUES.items())} from issue_snapshots
), b as (
  select * from r where fp is not null qualify row_number() over (partition by snapshot_no, fp order by last_seen desc nulls last) = 1
), s as (select snapshot_no, lead(snapshot_no) over (order by snapshot_no) nxt from (select distinct snapshot_no from b)),
old as (select b.*, s.nxt from b join s using (snapshot_no) where nxt is not null),
cur as (select b.* from b where snapshot_no in (select nxt from s)),
d as (
  select coalesce(cur.snapshot_no, old.nxt) snapshot_no, coalesce(cur.fp, old.fp) fingerprint,
    case when old.fp is null then 'added' when cur.fp is null then 'removed'
         when {' or '.join(f'cur.{c}_ <> old.{c}_' for c in _P2_VALUES)} then 'changed' end change,
    case when old.fp is null or cur.fp is null then '' else concat_ws(',', {', '.join(f"case when cur.{c}_ <> old.{c}_ then '{c}' end" for c in _P2_VALUES)}) end as columns
  from cur full join old on cur.fp = old.fp and cur.snapshot_no = old.nxt
)
"""

_P4 = f"""
with i as (select {sql_key('fingerprint')} k, min(first_seen) f from issues group by 1),
g as (select {sql_key('fingerprint')} k, max("timestamp") p from issue_history where {sql_squeezed('action')} = 'purge' group by 1),
r as (
  select 'issue_history' ref_table, id row_id, {sql_key('fingerprint')} k, "timestamp" t from issue_history
  union all select 'feedback_entries', entry_id, {sql_key('finding_key')}, labeled_at from feedback_entries
), x as (
  select distinct ref_table, strftime(t, '%Y-%m') period, row_id,
    case when i.k is not null then case when t < i.f then 'early' end
         when g.k is not null then case when t > g.p then 'deleted' end
         else 'missing' end reason
  from r left join i on r.k = i.k left join g on r.k = g.k where r.k is not null
)
"""


def _p6(field: str) -> str:
    return f"""
select '{field}' field_name, {field} key_value, count(*) n, count(distinct fingerprint) records,
  (select s from (select lower(trim(severity)) s, count(*) c from issues j where j.{field} is not distinct from i.{field} and severity is not null group by 1 order by c desc, s limit 1)) severity,
  quantile_disc(line, 0.5) line_p50, quantile_disc(line, 0.9) line_p90, min(first_seen) first_seen, max(last_seen) last_seen
from issues i group by {field}"""


SQL = {
    "p1_found": _P1,
    "p2_found": _P2 + "select snapshot_no, fingerprint, change from d where change is not null",
    "p2_columns": _P2 + "select snapshot_no, fingerprint, change, columns from d where change is not null",
    "p4_found": _P4 + "select ref_table, period, row_id, reason from x where reason is not null",
    "p4_report": _P4 + "select ref_table, period, reason, count(*) n from x where reason is not null group by all",
    "p6_found": """
select 'rule_id' field_name, rule_id key_value from issues where rule_id is not null group by rule_id having count(*) > 0.03 * (select count(*) from issues)
union all
select 'file', file from issues where file is not null group by file having count(*) > 0.03 * (select count(*) from issues)""",
    "p6_profile": f"{_p6('rule_id')} union all {_p6('file')}",
}
