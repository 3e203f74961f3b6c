"""History, sequences, analytics and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.keys import key_of, sql_key, sql_squeezed, sql_state, squeezed, state_of
from siftline.operators import analytics as a
from siftline.operators import graphs as g
from siftline.operators import history as h
from siftline.operators import sequences as s
from siftline.queries.base import FEEDBACK_SQL, FINDINGS_SQL, LINES_SQL, feedback, findings, lines, table
from siftline.report import sbom, sarif

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BASE = f"cur as (select {sql_key('fingerprint')} fingerprint, severity from issues where {sql_key('fingerprint')} is not null), base as (select distinct {sql_key('fingerprint')} fingerprint from issue_snapshots where {sql_key('fingerprint')} is not null)"


def _current(spark, sf):
    return table(spark, sf, "issues").select(key_of(F.col("fingerprint")).alias("fingerprint"), "severity").where("fingerprint is not null")


def _baseline(spark, sf):
    return table(spark, sf, "issue_snapshots").select(key_of(F.col("fingerprint")).alias("fingerprint")).where("fingerprint is not null")


@query(f"with {_BASE} select fingerprint, count(*) n from cur anti join base using (fingerprint) group by 1")
def baseline_new(spark, sf):
    """Issues that the baseline lacks."""
    return h.against_baseline(_current(spark, sf), _baseline(spark, sf))[0].groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_BASE} select fingerprint, count(*) n from cur semi join base using (fingerprint) group by 1")
def baseline_known(spark, sf):
    """Issues that the baseline has."""
    return h.against_baseline(_current(spark, sf), _baseline(spark, sf))[1].groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_BASE}, h as (select distinct {sql_key('fingerprint')} fingerprint from issue_history where {sql_key('fingerprint')} is not null) select fingerprint from h anti join cur using (fingerprint)")
def baseline_resolved(spark, sf):
    """Entries of the change feed, taken as a baseline, that are no issue any more."""
    feed = table(spark, sf, "issue_history").select(key_of(F.col("fingerprint")).alias("fingerprint")).where("fingerprint is not null")
    return h.against_baseline(_current(spark, sf), feed)[2]


def _ends(spark, sf):
    snaps = table(spark, sf, "issue_snapshots")
    ends = snaps.agg(F.min("snapshot_no").alias("lo"), F.max("snapshot_no").alias("hi"))
    j = snaps.join(F.broadcast(ends), F.col("snapshot_no").isin(F.col("lo"), F.col("hi")))
    return j.where("snapshot_no = lo"), j.where("snapshot_no = hi")


_K = "coalesce(file, '') || ':' || coalesce(cast(line as varchar), '') || ':' || coalesce(rule_id, '')"
_ENDS = "o as (select * from issue_snapshots where snapshot_no = (select min(snapshot_no) from issue_snapshots)), n as (select * from issue_snapshots where snapshot_no = (select max(snapshot_no) from issue_snapshots))"


@query(f"with {_ENDS}, a as (select distinct {_K} k from o), b as (select distinct {_K} k from n) select coalesce(a.k, b.k) k, case when a.k is null then 'added' when b.k is null then 'removed' else 'kept' end as change from a full join b on a.k = b.k")
def run_diff_added_removed(spark, sf):
    """Locations added, removed and kept between the first and the last snapshot."""
    return h.run_difference(*_ends(spark, sf))


_MERGE = f"c as (select {sql_key('fingerprint')} f, lower(trim(severity)) sv from n where {sql_key('fingerprint')} is not null), b as (select distinct {sql_key('fingerprint')} f from o where {sql_key('fingerprint')} is not null), x as (select f, min(sv) sv from c anti join b using (f) group by 1), y as (select count(*) \"new\", count(*) filter (where sv = 'critical') critical, count(*) filter (where sv = 'high') high from x)"


@query(f"with {_ENDS}, {_MERGE} select y.*, (select count(*) from b anti join c using (f)) fixed, case when critical > 0 then 'block' when high > 0 then 'request_changes' else 'approve' end recommendation from y")
def merge_review_decision(spark, sf):
    """New and fixed findings between two revisions, and the recommendation."""
    def clean(df):
        k = df.select(key_of(F.col("fingerprint")).alias("fingerprint"), F.lower(F.btrim("severity")).alias("severity")).where("fingerprint is not null")
        return k.groupBy("fingerprint").agg(F.min("severity").alias("severity"))

    old, new = _ends(spark, sf)
    return h.merge_review(clean(old), clean(new))


@query(f"with k as (select distinct {sql_key('fingerprint')} f from issues), i as (select {sql_key('fingerprint')} f, item_id, batch_no from issue_batches where {sql_key('fingerprint')} is not null), m as (select i.*, k.f is null and item_id = min(item_id) over (partition by i.f) isnew from i left join k on i.f = k.f) select batch_no, count(*) filter (where isnew) new_count, count(*) filter (where not isnew) recurring_count from m group by 1")
def issue_upsert_new_recurring(spark, sf):
    """New and recurring findings per delivered batch."""
    items = table(spark, sf, "issue_batches").select(key_of(F.col("fingerprint")).alias("fingerprint"), "item_id", "batch_no").where("fingerprint is not null")
    return h.upsert_counts(items, _current(spark, sf), "batch_no", "item_id")


@query("select date_trunc('week', \"timestamp\") as week, count(*) n, count(distinct fingerprint) records from issue_history where \"timestamp\" is not null group by 1")
def issue_weekly_trend(spark, sf):
    """Changes per week."""
    return h.weekly_trend(table(spark, sf, "issue_history"), "timestamp")


@query(f"with r as (select layer, snapshot_no, count(*) filter (where {sql_state('state')} = 'open') / count(*) rate from issue_snapshots where layer is not null group by all), l as (select *, lag(rate) over (partition by layer order by snapshot_no) before from r) select layer, snapshot_no, round(rate, 6) rate, round(before, 6) before from l where before - rate > 0.05")
def coverage_drop(spark, sf):
    """Layers whose rate fell by more than five points between snapshots."""
    rates = table(spark, sf, "issue_snapshots").where("layer is not null").groupBy("layer", "snapshot_no").agg((F.count_if(state_of(F.col("state")) == "open") / F.count(F.lit(1))).alias("rate"))
    return h.ratio_drops(rates, "layer", "snapshot_no", "rate").select("layer", "snapshot_no", F.round("rate", 6).alias("rate"), F.round("before", 6).alias("before"))


_LOG = """l0 as (select user_id, event_id, cast(event_id as varchar) || '|' || event_type payload, row_number() over (partition by user_id order by event_id) rn from events),
l1 as (select *, user_id || '/' || ((rn - 1) // 2) chain, sha256('|' || payload) own from l0),
l2 as (select *, case when rn % 2 = 0 then case when event_id % 97 = 0 then 'x' else lag(own) over (partition by chain order by event_id) end end prev_hash from l1),
l as (select *, case when event_id % 89 = 0 then 'y' else sha256(coalesce(prev_hash, '') || '|' || payload) end this_hash from l2)"""


@query(f"with {_LOG}, b as (select *, lag(this_hash) over (partition by chain order by event_id) before from l), c as (select chain, event_id, this_hash <> sha256(coalesce(prev_hash, '') || '|' || payload) bad_hash, before is not null and prev_hash is distinct from before bad_link from b) select * from c where bad_hash or bad_link")
def audit_chain_verify(spark, sf):
    """Breaks of hash-chained logs, on logs of two entries made from events, with planted tampering."""
    from pyspark.sql import Window as W

    log = table(spark, sf, "events").select("user_id", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("payload"))
    log = log.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    log = log.withColumns({"chain": F.concat_ws("/", "user_id", F.expr("cast((rn - 1) div 2 as string)")), "own": F.sha2(F.concat(F.lit("|"), "payload"), 256)})
    before = F.lag("own").over(W.partitionBy("chain").orderBy("event_id"))
    log = log.withColumn("prev_hash", F.when(F.col("rn") % 2 == 0, F.when(F.col("event_id") % 97 == 0, "x").otherwise(before)))
    good = F.sha2(F.concat_ws("|", F.coalesce("prev_hash", F.lit("")), F.col("payload")), 256)
    log = log.withColumn("this_hash", F.when(F.col("event_id") % 89 == 0, "y").otherwise(good))
    return h.chain_breaks(log, "chain", "event_id", F.col("payload")).select("chain", "event_id", "bad_hash", "bad_link")


_CHANGES = f"ch as (select i.file, h.user_name author, h.\"timestamp\" as tm, cast(h.\"timestamp\" as date) || '/' || coalesce(h.user_name, '') as commit from issue_history h join (select {sql_key('fingerprint')} f, min(file) file from issues group by 1) i on {sql_key('h.fingerprint')} = i.f where h.user_name is not null and i.file is not null)"


def _changes(spark, sf):
    files = table(spark, sf, "issues").groupBy(key_of(F.col("fingerprint")).alias("f")).agg(F.min("file").alias("file"))
    hist = table(spark, sf, "issue_history").select(key_of(F.col("fingerprint")).alias("f"), F.col("user_name").alias("author"), F.col("timestamp").alias("at"))
    return hist.where("author is not null").join(files, "f").where("file is not null").select("file", "author", "at", F.concat_ws("/", F.to_date("at").cast("string"), "author").alias("commit"))


@query(f"with {_CHANGES}, c as (select file, count(*) changes from ch where tm > (select cast(cast(max(\"timestamp\") as date) - interval 365 day as timestamp) from issue_history) group by 1 having count(*) >= 10), k as (select file, count(distinct rule_id) complexity from issues where file is not null group by 1) select file, changes, complexity from c join k using (file) where complexity >= 15")
def churn_hotspots(spark, sf):
    """Files with at least ten changes in the last year of the feed and at least fifteen kinds of issue."""
    last = table(spark, sf, "issue_history").agg(F.max("timestamp").alias("last"))
    kinds = table(spark, sf, "issues").where("file is not null").groupBy("file").agg(F.countDistinct("rule_id").alias("complexity"))
    return h.hotspots(_changes(spark, sf).crossJoin(F.broadcast(last)), kinds, F.to_date("last"), 365)  # one row


@query("with k as (select snapshot_no, file, count(*) n from issue_snapshots where file is not null group by all), e as (select min(snapshot_no) lo, max(snapshot_no) hi from issue_snapshots) select a.file, a.n before, b.n now from k a join k b using (file) join e on a.snapshot_no = lo and b.snapshot_no = hi where b.n > a.n * 1.5")
def growing_files(spark, sf):
    """Files whose number of records grew by more than half between the first and the last snapshot."""
    from siftline.operators import codebase as cb

    sizes = lambda df: df.where("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    old, new = _ends(spark, sf)
    return cb.grown(sizes(old), sizes(new), "file", "n")


@query("select fingerprint, max(last_seen) last_seen from issues where fingerprint is not null group by 1 order by last_seen desc nulls last, fingerprint limit 50")
def latest_issues(spark, sf):
    """The fifty issues seen last."""
    return h.latest_issues(table(spark, sf, "issues"))


@query("with n as (select distinct rule_id as name, message summary, file, line from issues), s as (select *, case when contains(lower(coalesce(name, '')), 'path') then 3 else 0 end + case when contains(lower(coalesce(summary, '')), 'path') then 2 else 0 end + case when contains(lower(coalesce(file, '')), 'path') then 1 else 0 end score from n) select name, file, line, score from s where score > 0 order by score desc, name nulls first, file nulls first, line nulls first limit 20")
def graph_search(spark, sf):
    """The twenty nodes that fit a word best."""
    from siftline.operators import codebase as cb

    nodes = table(spark, sf, "issues").select(F.col("rule_id").alias("name"), F.col("message").alias("summary"), "file", "line").distinct()
    return cb.search(nodes, "path").select("name", "file", "line", "score")


_NORM = "case when regexp_matches(tok, '^[A-Za-z_][A-Za-z0-9_]*$') and tok not in (" + ", ".join(f"'{k}'" for k in a.KEYWORDS) + ") then 'ID' else tok end"


@query(f"""with {LINES_SQL}, tk as (select file, line_no, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}_]')) tok, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}_]'), 1) i from lines where regexp_matches(file, '^source_snapshots/')),
n as (select file, line_no, {_NORM} tok, row_number() over (partition by file order by line_no, i) k, count(*) over (partition by file) m from tk), g as (select file, m, list(tok order by k) toks, list(line_no order by k) lns from n group by all),
w as (select file, lns[s] line, array_to_string(toks[s:s + 29], chr(1)) body from (select *, unnest(range(1, m - 28)) s from g where m >= 30)),
c as (select body, count(*) places, count(distinct file) files, min(row(file, line)) f, max(line) - min(line) apart from w group by 1), pf as (select body, max(hi - lo) apart from (select body, file, min(line) lo, max(line) hi from w group by all) group by 1)
select places, files, f[1] first_file, f[2] first_line from c join pf using (body) where files >= 2 or pf.apart >= 30 order by places desc, first_file, first_line limit 20""")
def duplicate_tokens(spark, sf):
    """The twenty most repeated windows of thirty tokens of source texts; the SQL compares the windows themselves."""
    docs = table(spark, sf, "documents").where("source = 'source_snapshots'").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("content"))
    return a.duplicate_windows(docs, 30).select("places", "files", "first_file", "first_line")


@query(f"with {_CHANGES}, f as (select file, arg_min(author, row(tm, author)) first_author, count(*) n from ch group by 1), o as (select file, author, count(*) own from ch group by all) select f.file, first_author, n, own, round(own / n, 6) as share from f join o on f.file = o.file and f.first_author = o.author where n > 8 and own / n < 0.4")
def knowledge_drift(spark, sf):
    """Files whose first author makes a minority of the changes."""
    return h.knowledge_drift(_changes(spark, sf)).withColumn("share", F.round("share", 6))


@query(f"with {_CHANGES} select commit, count(distinct file) files, count(distinct string_split(file, '/')[1]) folders from ch group by 1 having count(distinct file) >= 5 and count(distinct string_split(file, '/')[1]) >= 3")
def tangled_commits(spark, sf):
    """Days of an author over many files in several folders."""
    return h.tangled(_changes(spark, sf))


@query("select user_name, count(*) n, count(*) filter (where hour(\"timestamp\") >= 22 or hour(\"timestamp\") < 6) night, count(*) filter (where isodow(\"timestamp\") >= 6) weekend from issue_history group by 1")
def commit_risk_time(spark, sf):
    """Changes at night and at weekends per user."""
    t = F.col("timestamp")
    return table(spark, sf, "issue_history").groupBy("user_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.hour(t) >= 22) | (F.hour(t) < 6)).alias("night"), F.count_if(F.weekday(t) >= 5).alias("weekend")
    )


_ALLOWED = [("open", "confirmed"), ("open", "fixed"), ("open", "wontfix"), ("open", "false_positive"), ("confirmed", "fixed"), ("confirmed", "open"), ("fixed", "open"), ("wontfix", "open"), ("false_positive", "open"), ("open", "baselined")]
_STEPS = f"st as (select {sql_key('fingerprint')} k, \"timestamp\" ts, min(id) id, {sql_state('new_state')} b from issue_history where {sql_state('new_state')} is not null and {sql_key('fingerprint')} is not null group by 1, 2, 4), l as (select *, lag(b) over (partition by k order by ts, id) a from st)"


@query(f"with {_STEPS} select a, b, count(*) n, count(distinct k) records from l where a is not null and a <> b and (a, b) not in ({', '.join(map(str, _ALLOWED))}) group by all")
def state_transition_violations(spark, sf):
    """Consecutive states of a record that its machine does not allow."""
    ev = table(spark, sf, "issue_history").select(key_of(F.col("fingerprint")).alias("k"), F.col("timestamp").alias("ts"), "id", state_of(F.col("new_state")).alias("state")).where("k is not null and state is not null")
    ev = ev.groupBy("k", "ts", "state").agg(F.min("id").alias("id"))
    bad = s.forbidden_transitions(ev, "k", ["ts", "id"], "state", spark.createDataFrame(_ALLOWED, "a string, b string"))
    return bad.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("records"))


_ACT = f"ac as (select {sql_key('fingerprint')} k, coalesce(i.layer, 'none') layer, id, min({sql_squeezed('action')}) act from issue_history h left join (select {sql_key('fingerprint')} f, min(layer) layer from issues group by 1) i on {sql_key('h.fingerprint')} = i.f where {sql_key('fingerprint')} is not null group by all)"


@query(f"with {_ACT}, q as (select layer, k, string_agg(act, '>' order by id, act) sequence from ac group by all), c as (select layer, sequence, count(*) n from q group by all), r as (select *, sum(n) over (partition by layer) total, row_number() over (partition by layer order by n desc, sequence) rank from c) select layer, sequence, n, round(n / total, 6) confidence from r where rank <= 10 and n >= 2")
def spec_mining_sequences(spark, sf):
    """The most frequent action sequences per layer."""
    layers = table(spark, sf, "issues").groupBy(key_of(F.col("fingerprint")).alias("k")).agg(F.min("layer").alias("layer"))
    calls = table(spark, sf, "issue_history").select(key_of(F.col("fingerprint")).alias("k"), "id", squeezed(F.col("action")).alias("act")).where("k is not null")
    calls = calls.groupBy("k", "id").agg(F.min("act").alias("act")).join(layers, "k", "left").withColumn("layer", F.coalesce("layer", F.lit("none")))
    return s.mined_sequences(calls, "layer", "k", ["id"], "act").withColumn("confidence", F.round("confidence", 6))


_EV = f"ev as (select {sql_key('fingerprint')} k, \"timestamp\" ts, id, min({sql_squeezed('action')}) act from issue_history where {sql_key('fingerprint')} is not null group by 1, 2, 3), sx as (select *, last_value(case when act = 'purge' then 'closed' when act = 'open' then 'open' end ignore nulls) over (partition by k order by ts, id rows between unbounded preceding and 1 preceding) st from ev)"


@query(f"with {_EV} select k, id, act from sx where st = 'closed' and act <> 'open'")
def typestate_use_after_close(spark, sf):
    """Actions on a record after it was purged and not opened again."""
    ev = table(spark, sf, "issue_history").select(key_of(F.col("fingerprint")).alias("k"), F.col("timestamp").alias("ts"), "id", squeezed(F.col("action")).alias("act")).where("k is not null")
    ev = ev.groupBy("k", "ts", "id").agg(F.min("act").alias("act"))
    return s.used_after_close(ev, "k", ["ts", "id"], F.col("act") == "open", F.col("act") == "purge").select("k", "id", "act")


_COMMENT = "^\\s*(#|//|\\*|>|- )"


@query(f"with {LINES_SQL}, f as (select file, line_no, line_no - row_number() over (partition by file order by line_no) island from lines where regexp_matches(text, '{_COMMENT}')) select file, min(line_no) first_line, count(*) length from f group by file, island having count(*) >= 5")
def comment_runs_islands(spark, sf):
    """Runs of at least five comment or list lines."""
    return s.runs(lines(spark, sf), F.col("text").rlike(_COMMENT))


@query(f"with {LINES_SQL}, w as (select file, line_no, contains(text, 'SELECT ') f, coalesce(max(contains(text, 'return ')) over (partition by file order by line_no rows between 1 following and 6 following), false) followed from lines) select file, line_no, followed from w where f")
def lookahead_window(spark, sf):
    """Queries with whether a return follows within six lines."""
    return s.followed_within(lines(spark, sf), F.col("text").contains("SELECT "), F.col("text").contains("return "), 6).select("file", "line_no", "followed")


_HEAD = "^## (.+)$"


@query(f"with {LINES_SQL}, hd as (select file, line_no, nullif(regexp_extract(text, '{_HEAD}', 1), '') as name from lines), x as (select *, lead(line_no) over (partition by file order by line_no) nx from hd where name is not null) select file, line_no, name, least(coalesce(nx - 1, line_no + 200), line_no + 200) end_line from x")
def section_extents(spark, sf):
    """Sections from their header to the line before the next."""
    name = F.regexp_extract("text", _HEAD, 1)
    return s.extents(lines(spark, sf), F.when(name != "", name))


@query(f"with {LINES_SQL}, hd as (select file, line_no, last_value(nullif(regexp_extract(text, '{_HEAD}', 1), '') ignore nulls) over (partition by file order by line_no rows between unbounded preceding and current row) as name from lines) select file, name, count(*) n from hd where name is not null group by all")
def enclosing_section(spark, sf):
    """Lines per enclosing section, carried forward."""
    name = F.regexp_extract("text", _HEAD, 1)
    return s.carried(lines(spark, sf), F.when(name != "", name), "name").where("name is not null").groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"))


@query("with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end b from events), x as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from e) select user_id, min(ts) as \"start\", count(*) events from x group by user_id, k")
def debounce_sessions(spark, sf):
    """Bursts of events separated by at least six hours."""
    return s.sessions(table(spark, sf, "events"), "user_id", "ts", "6 hours")


_DOCLINES = f"{LINES_SQL}, t as (select file, line_no, trim(text, ' ') as text from lines where trim(text, ' ') <> ''), w as (select x.file, x.line_no, x.text, y.text l1, z.text l2 from t x left join t y on x.file = y.file and y.line_no = x.line_no + 1 left join t z on x.file = z.file and z.line_no = x.line_no + 2)"


@query(f"with {_DOCLINES} select substr(sha256(text || chr(10) || l1 || chr(10) || l2), 1, 16) hash, count(*) places, count(distinct file) files, arg_min(file, row(file, line_no)) first_file, arg_min(line_no, row(file, line_no)) first_line from w where l1 is not null and l2 is not null group by 1 having count(*) >= 2 order by places desc, hash limit 20")
def dup_line_windows(spark, sf):
    """The twenty most repeated windows of three lines."""
    return a.repeated_lines(lines(spark, sf))


@query("with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0), p as (select q.vec_id as query, e.vec_id neighbour, list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])) c from q join embeddings e on q.vec_id <> e.vec_id), r as (select *, row_number() over (partition by query order by c desc, neighbour) as rank from p) select query, neighbour, round(c, 5) cosine, rank from r where rank <= 5")
def embedding_cosine_topk(spark, sf):
    """The five nearest vectors of every hundredth vector, against all vectors."""
    return a.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5).withColumn("cosine", F.round("cosine", 5))


@query()
def embedding_indexed_topk(spark, sf):
    """The five nearest vectors of every hundredth vector by the cell index, with whether the exact search has them too."""
    rows = table(spark, sf, "embeddings")
    exact = a.nearest(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5).select("query", "neighbour", F.lit(True).alias("exact"))
    found = a.CellIndex(rows, "vec_id", "embedding", 32).search(rows.where("vec_id % 100 = 0"), 5, 12)
    return found.join(exact, ["query", "neighbour"], "left").select("query", "neighbour", F.round("cosine", 5).alias("cosine"), "rank", F.coalesce("exact", F.lit(False)).alias("exact"))


_TRI = "list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))"


@query(f"with n as (select distinct lower(rule_id) s from yaml_hits where rule_id is not null), t as (select s, {_TRI} g from n), p as (select x.s a, y.s b, len(list_intersect(x.g, y.g)) / sqrt(len(x.g) * len(y.g)) c from t x join t y on x.s < y.s) select a, b, round(c, 6) cosine from p where c >= 0.7")
def trigram_cosine(spark, sf):
    """Rule names with similar trigram sets."""
    names = table(spark, sf, "yaml_hits").select(F.lower("rule_id").alias("rule"))
    return a.trigram_similar(names, "rule", 0.7).withColumn("cosine", F.round("cosine", 6))


_POP = "pop as (select lower(rule_id) as name from issues where rule_id is not null group by 1 order by count(*) desc, lower(rule_id) limit 50)"


@query(f"with {_POP}, nm as (select distinct lower(rule_id) as name from issue_batches where length(rule_id) >= 4 and lower(rule_id) not in (select name from pop)), p as (select nm.name, pop.name popular, levenshtein(nm.name, pop.name) d from nm join pop on abs(length(nm.name) - length(pop.name)) <= 1), f as (select * from p where d = 1 or (d = 2 and length(name) = length(popular) and length(name) >= 6)) select name, arg_min(popular, row(d, popular)) popular, min(d) distance from f group by 1")
def typosquat_levenshtein(spark, sf):
    """Rule names one or two edits from one of the fifty most frequent."""
    low = F.lower("rule_id")
    popular = table(spark, sf, "issues").where("rule_id is not null").groupBy(low.alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(50)
    return a.lookalikes(table(spark, sf, "issue_batches").select(low.alias("rule")), "rule", popular)


_ADV = [("V-1", "python", "path-escape", "<1.3"), ("V-2", "java", "path-escape", "1.2-1.11"), ("V-3", "python", "query-text-concat", "<=2.0"), ("V-4", "javascript", "number-unnamed", "3.1.4"), ("V-5", "java", "maybe-missing", "<0.9"), ("V-6", "java", "loop-of-queries", "1.0-3.5"), ("V-7", "python", "catch-everything", "<2.4")]
_DEPS_SQL = "dp as (select distinct regexp_extract(rule_id, '^([a-z]+)-', 1) ecosystem, regexp_replace(rule_id, '^[a-z]+-', '') as name, cast(line % 4 as varchar) || '.' || cast(line % 13 as varchar) || case when line % 3 = 0 then '.' || cast(line % 5 as varchar) else '' end as version from issues where regexp_matches(rule_id, '^[a-z]+-[a-z-]+$') and line is not null)"


def _deps(spark, sf):
    """(ecosystem, name, version): rules as packages, with a version from their lines."""
    n = F.col("line")
    version = F.concat((n % 4).cast("string"), F.lit("."), (n % 13).cast("string"), F.when(n % 3 == 0, F.concat(F.lit("."), (n % 5).cast("string"))).otherwise(""))
    rows = table(spark, sf, "issues").where(F.col("rule_id").rlike("^[a-z]+-[a-z-]+$") & n.isNotNull())
    return rows.select(F.regexp_extract("rule_id", "^([a-z]+)-", 1).alias("ecosystem"), F.regexp_replace("rule_id", "^[a-z]+-", "").alias("name"), version.alias("version")).distinct()


def _numbers(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '\\d+'), lambda x: cast(x as integer))"




_IN_RANGE = f"""case when starts_with(spec, '<=') then {_numbers('version')} <= {_numbers('spec')} when starts_with(spec, '<') then {_numbers('version')} < {_numbers('spec')}
  when contains(spec, '-') then {_numbers('version')} >= {_numbers("string_split(spec, '-')[1]")} and {_numbers('version')} <= {_numbers("string_split(spec, '-')[2]")}
  else {_numbers('version')} = {_numbers('spec')} end"""


@query(f"with {_DEPS_SQL}, v(id, ecosystem, name, spec) as (values {', '.join(map(str, _ADV))}) select id, ecosystem, name, version from dp join v using (ecosystem, name) where {_IN_RANGE}")
def version_range_join(spark, sf):
    """Dependencies in the affected range of an advisory."""
    adv = spark.createDataFrame(_ADV, "id string, ecosystem string, package string, affected_versions string")
    return a.vulnerable(_deps(spark, sf), adv).select("id", "ecosystem", "name", "version")


_COUNT = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_RISK = " + ".join(f"{w} * {_COUNT(p)}" for w, p in (
    (a.RISK_WEIGHTS["calls"], r"\w+\s*\("), (a.RISK_WEIGHTS["branches"], r"\bif\b|\belif\b|\belse\b"), (a.RISK_WEIGHTS["loops"], r"\bfor\b|\bwhile\b"), (a.RISK_WEIGHTS["sensitive"], a.SENSITIVE_TOKENS),
    (a.RISK_WEIGHTS["unsafe"], a.UNSAFE_LIBRARIES), (a.RISK_WEIGHTS["length"], r"\n")))


@query(f"select doc_id, round(1 / (1 + exp(-({_RISK} + {a.RISK_WEIGHTS['handles']} * case when regexp_matches(text, '\\btry\\b|\\bcatch\\b|\\bexcept\\b') then 1 else 0 end))), 6) risk from documents where text is not null and doc_kind = 'source'")
def risk_logit(spark, sf):
    """Logistic risk score of every source text, taken as one body."""
    return table(spark, sf, "documents").where("text is not null and doc_kind = 'source'").select("doc_id", F.round(a.risk(F.col("text")), 6).alias("risk"))


@query(f"with {FINDINGS_SQL}, n as (select rule_id, count(*) n from findings group by 1), e as (select file, count(distinct rule_id) d from findings group by 1), x as (select distinct fingerprint, round(0.5 * (1 - abs(2 * confidence - 1)) + 0.3 / n.n + 0.2 * least(1.0, e.d / 50.0), 6) info from findings f join n using (rule_id) join e on e.file = f.file) select fingerprint, info from x order by info desc, fingerprint limit 20")
def active_learning_topk(spark, sf):
    """The twenty findings whose label would teach most."""
    f = findings(spark, sf)
    n = f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    e = f.groupBy("file").agg(F.countDistinct("rule_id").alias("d"))
    info = a.informativeness(F.col("confidence"), 1 / F.col("n"), F.least(F.lit(1.0), F.col("d") / 50.0))
    j = f.join(n, "rule_id").join(e, "file").select("fingerprint", F.round(info, 6).alias("info")).distinct()
    return j.orderBy(F.col("info").desc(), "fingerprint").limit(20)


_EDGES = "ed as (select distinct n_nationkey src, (n_nationkey * 3 + n_regionkey) % 25 dst from nation union select n_nationkey, (n_nationkey + 7) % 25 from nation where n_regionkey < 2)"


def _edges(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + F.col("n_regionkey")) % 25).alias("dst")).union(
        n.where("n_regionkey < 2").select("n_nationkey", (F.col("n_nationkey") + 7) % 25)
    )


_REACH = "with recursive {}, r(start, node, hops) as (select n_nationkey, n_nationkey, 0 from nation union select r.start, {}, hops + 1 from r join ed on {} = r.node where hops < 3), m as (select start, node, min(hops) hops from r group by all)"


@query(_REACH.format(_EDGES, "ed.dst", "ed.src") + " select start, node, hops from m")
def reach_bounded(spark, sf):
    """Nodes within three steps of every node."""
    return g.reach(table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), _edges(spark, sf), 3)


@query(_REACH.format(_EDGES, "ed.src", "ed.dst") + " select start, count(*) affected, case when count(*) > 10 then 'high' when count(*) > 3 then 'medium' else 'low' end risk from m where hops > 0 group by 1")
def impact_blast_radius(spark, sf):
    """Callers within three steps of every node, as a risk."""
    return g.blast_radius(table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), _edges(spark, sf))


@query("with recursive " + _EDGES + ", cl as (select * from ed where dst % 6 <> 5), r(start, node, hops) as (select n_nationkey, n_nationkey, 0 from nation where n_regionkey = 0 union select r.start, cl.dst, hops + 1 from r join cl on cl.src = r.node where hops < 8) select start source, node sink, min(hops) hops from r where hops > 0 and node % 4 = 0 group by all having min(hops) > 0 and source <> sink")
def taint_bounded(spark, sf):
    """Sinks within eight flow steps of a source that no sanitised node cuts off."""
    n = table(spark, sf, "nation")
    node = F.col("n_nationkey").alias("node")
    found = g.tainted(n.where("n_regionkey = 0").select(node), n.where("n_nationkey % 4 = 0").select(node), _edges(spark, sf), n.where("n_nationkey % 6 = 5").select(node))
    return found.where("source <> sink")


def _trade_edges(spark, sf):
    """Nations to customers to orders to parts, each node once per kind and key; rows without a key are no edge."""
    def edges(name, src, src_kind, dst, dst_kind):
        rows = table(spark, sf, name).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
        return rows.select(F.concat(F.lit(src_kind), src).alias("src"), F.concat(F.lit(dst_kind), dst).alias("dst"))

    return edges("customer", "c_nationkey", "n", "c_custkey", "c").unionByName(edges("orders", "o_custkey", "c", "o_orderkey", "o")).unionByName(
        edges("lineitem", "l_orderkey", "o", "l_partkey", "p")
    )


def _trade_nodes(spark, sf, name, key, kind):
    return table(spark, sf, name).where(F.col(key).isNotNull()).select(F.concat(F.lit(kind), key).alias("node"))


_TRADE = "nc as (select distinct c_nationkey n, c_custkey c from customer where c_nationkey is not null and c_custkey is not null), co as (select distinct o_custkey c, o_orderkey o from orders where o_custkey is not null and o_orderkey is not null), op as (select distinct l_orderkey o, l_partkey p from lineitem where l_orderkey is not null and l_partkey is not null)"


@query(f"with {_TRADE}, l1 as (select distinct n, c from nc join nation on n_nationkey = n), l2 as (select distinct n, o from l1 join co using (c)), l3 as (select distinct n, p from l2 join op using (o)) select 'n' || n_nationkey as \"start\", 'n' || n_nationkey node, 0 hops from nation union all select 'n' || n, 'c' || c, 1 from l1 union all select 'n' || n, 'o' || o, 2 from l2 union all select 'n' || n, 'p' || p, 3 from l3")
def trade_reach(spark, sf):
    """Customers, orders and parts within three steps of every nation, over the whole tables."""
    return g.reach(_trade_nodes(spark, sf, "nation", "n_nationkey", "n"), _trade_edges(spark, sf), 3)


@query(f"with {_TRADE}, x as (select p, o from op join (select distinct p_partkey p from part) using (p)), y as (select distinct p, c from x join co using (o)), z as (select distinct p, n from y join nc using (c)), k as (select p, count(*) k from (select p, o from x union all select p, c from y union all select p, n from z) group by 1) select 'p' || p as \"start\", k affected, case when k > 10 then 'high' when k > 3 then 'medium' else 'low' end risk from k")
def trade_blast_radius(spark, sf):
    """Orders, customers and nations within three steps against the edges of every part, as a risk."""
    return g.blast_radius(_trade_nodes(spark, sf, "part", "p_partkey", "p"), _trade_edges(spark, sf))


@query(f"with {_TRADE} select distinct 'n' || n source, 'p' || p sink, 3 hops from nc join nation on n_nationkey = n and n_regionkey = 0 join co using (c) join op using (o) join part on p_partkey = p and p % 4 = 0 where o not in (select o_orderkey from orders where o_orderstatus = 'F')")
def trade_taint(spark, sf):
    """Every fourth part that a nation of region 0 reaches through orders that are not finished."""
    n = table(spark, sf, "nation").where("n_regionkey = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    sinks = table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    finished = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return g.tainted(n, sinks, _trade_edges(spark, sf), finished)


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_partkey is not null and l_quantity >= 45)")
def dead_entities(spark, sf):
    """Parts that no large line refers to."""
    calls = table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("callee"))
    return g.unreferenced(table(spark, sf, "part").withColumn("name", F.col("p_partkey")), calls).select("p_partkey", "p_name")


@query(f"with {FINDINGS_SQL}, x as (select severity, category, rule_id, grouping(severity) gs, grouping(category) gc, grouping(rule_id) gr, count(*) n from findings group by grouping sets ((severity), (category), (rule_id), ())) select case when gs = 0 then 'severity' when gc = 0 then 'category' when gr = 0 then 'rule' else 'all' end as dim, coalesce(severity, category, rule_id, '') as value, n from x")
def dashboard_grouping_sets(spark, sf):
    """Counts by severity, category and rule in one pass."""
    f = findings(spark, sf)
    x = f.groupingSets([["severity"], ["category"], ["rule_id"], []], "severity", "category", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("severity").alias("gs"), F.grouping("category").alias("gc"), F.grouping("rule_id").alias("gr")
    )
    dim = F.when(F.col("gs") == 0, "severity").when(F.col("gc") == 0, "category").when(F.col("gr") == 0, "rule").otherwise("all")
    return x.select(dim.alias("dim"), F.coalesce("severity", "category", "rule_id", F.lit("")).alias("value"), "n")


@query("select file, count(*) n from issues where file is not null group by 1 order by n desc, file limit 10")
def dashboard_top_files(spark, sf):
    """The ten files with most issues."""
    return table(spark, sf, "issues").where("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "file").limit(10)


@query(f"with {FINDINGS_SQL}, f as (select rule_id, min(severity) severity, count(*) n, list_sort(list_distinct(list(file) filter (where file is not null)))[1:3] fs from findings group by 1) select rule_id, severity, n, array_to_string(fs, ',') files from f")
def summary_by_rule(spark, sf):
    """Count, severity and three files per rule; the list of distinct files is cut in a window, not collected."""
    from pyspark.sql import Window as W

    f = findings(spark, sf)
    counts = f.groupBy("rule_id").agg(F.min("severity").alias("severity"), F.count(F.lit(1)).alias("n"))
    files = f.where("file is not null").select("rule_id", "file").distinct().withColumn("k", F.row_number().over(W.partitionBy("rule_id").orderBy("file"))).where("k <= 3")
    lists = files.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))
    return counts.join(lists, "rule_id", "left").select("rule_id", "severity", "n", F.coalesce("files", F.lit("")).alias("files"))


@query(f"with {FEEDBACK_SQL} select rule_id, count(*) n, round(avg(case when kind = 'tp' then 1.0 else 0.0 end), 6) tp_share from feedback group by 1 having count(*) >= 5 order by tp_share, rule_id limit 20")
def worst_rules(spark, sf):
    """The twenty rules whose findings are confirmed least."""
    f = feedback(spark, sf).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("kind") == "tp", 1.0).otherwise(0.0)), 6).alias("tp_share"))
    return f.where("n >= 5").orderBy("tp_share", "rule_id").limit(20)


@query("select resolution_note note, state, count(*) n from issues where resolution_note is not null and trim(resolution_note) <> '' group by all")
def resolution_notes(spark, sf):
    """How issues were resolved."""
    return table(spark, sf, "issues").where("resolution_note is not null and trim(resolution_note) <> ''").groupBy(F.col("resolution_note").alias("note"), "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {FINDINGS_SQL} select engine, count(*) results, count(distinct rule_id) rules from findings group by 1")
def sarif_nested(spark, sf):
    """Report documents per engine, with the number of their results and rules."""
    doc = F.from_json("report", "runs array<struct<tool struct<driver struct<rules array<struct<id string>>>>, results array<struct<ruleId string>>>>")
    d = sarif(findings(spark, sf)).select("engine", doc["runs"][0].alias("r"))
    return d.select("engine", F.size("r.results").alias("n"), F.explode("r.tool.driver.rules.id").alias("rule"), F.col("r.results").alias("rs")).groupBy("engine", "rs").agg(
        F.max("n").alias("n"), F.collect_set("rule").alias("rules")
    ).groupBy("engine").agg(F.sum("n").alias("results"), F.size(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))


@query(f"with {_DEPS_SQL} select ecosystem, count(*) components from dp group by 1")
def sbom_json(spark, sf):
    """Component lists as JSON documents, with the number of their components."""
    from siftline.report import spdx

    n = lambda c, f: F.size(F.from_json(c, f"{f} array<struct<name string>>")[f])
    boms = sbom(_deps(spark, sf)).groupBy("ecosystem").agg(F.sum(n("bom", "components")).alias("components"))
    lists = spdx(_deps(spark, sf)).groupBy("ecosystem").agg(F.sum(n("spdx", "packages")).alias("packages"))
    return boms.join(lists, "ecosystem").where("components = packages").select("ecosystem", "components")


@query("select lower(trim(severity)) severity, count(*) n from issues where severity is not null group by 1")
def severity_spelling(spark, sf):
    """Issues by trimmed severity."""
    return table(spark, sf, "issues").where("severity is not null").groupBy(F.lower(F.btrim("severity", F.lit(" "))).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = Q
