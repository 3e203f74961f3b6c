"""Baselines, run differences, issue lifecycle, trends, audit chains and change statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def against_baseline(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, known, resolved): findings without and with a baseline entry, and entries without a finding."""
    b = baseline.select(key).distinct()
    return findings.join(b, key, "left_anti"), findings.join(b, key, "left_semi"), b.join(findings.select(key), key, "left_anti")


def run_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(k, change): location keys of two runs, added, removed or kept, in one full outer join."""
    key = F.concat_ws(":", F.coalesce("file", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("")), F.coalesce("rule_id", F.lit("")))
    a = old.select(key.alias("k")).distinct().withColumn("o", F.lit(1))
    b = new.select(key.alias("k")).distinct().withColumn("n", F.lit(1))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept")
    return a.join(b, "k", "full").select("k", change.alias("change"))


def merge_review(base: DataFrame, head: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """One row: new and fixed findings between two revisions and the recommendation: critical blocks, high asks for changes, else approve.

    With ``changed`` (file), only new findings in those files count.
    """
    every = head
    if changed is not None:
        head = head.join(changed.select("file").distinct(), "file", "left_semi")
    new = head.join(base.select("fingerprint").distinct(), "fingerprint", "left_anti").dropDuplicates(["fingerprint"])
    fixed = base.join(every.select("fingerprint").distinct(), "fingerprint", "left_anti").select("fingerprint").distinct().agg(F.count(F.lit(1)).alias("fixed"))
    counts = new.agg(F.count(F.lit(1)).alias("new"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    advice = F.when(F.col("critical") > 0, "block").when(F.col("high") > 0, "request_changes").otherwise("approve")
    return counts.crossJoin(fixed).withColumn("recommendation", advice)  # one row each


def upsert_counts(items: DataFrame, known: DataFrame, run: str, order: str) -> DataFrame:
    """Per run: findings seen for the first time and recurring ones, given what was known before all runs."""
    first = items.groupBy("fingerprint").agg(F.min(F.struct(order, run)).alias("f"))
    old = known.select("fingerprint").distinct().withColumn("old", F.lit(True))
    marked = items.join(first, "fingerprint").join(old, "fingerprint", "left")
    new = F.col("old").isNull() & (F.col(order) == F.col(f"f.{order}"))
    return marked.groupBy(run).agg(F.count_if(new).alias("new_count"), F.count_if(~new).alias("recurring_count"))


def merged_issues(store: DataFrame, run: DataFrame, now: Column) -> DataFrame:
    """The issue store after a run: first and last sight per fingerprint, new ones open."""
    seen = run.select("fingerprint").distinct().withColumn("__now", now)
    both = store.join(seen, "fingerprint", "full")
    return both.select(
        "fingerprint", F.coalesce("state", F.lit("open")).alias("state"), F.coalesce("first_seen", "__now").alias("first_seen"),
        F.greatest("last_seen", "__now").alias("last_seen"),
    )


def weekly_trend(rows: DataFrame, time: str) -> DataFrame:
    """(week, n, keys): changes and touched records per week, weeks starting on Monday."""
    return rows.where(F.col(time).isNotNull()).groupBy(F.date_trunc("week", F.col(time)).alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("fingerprint").alias("records")
    )


def ratio_drops(rates: DataFrame, by: str, order: str, rate: str, least: float = 0.05) -> DataFrame:
    """Rows whose rate is more than ``least`` below that of the preceding row of the same key."""
    before = F.lag(rate).over(W.partitionBy(by).orderBy(order))
    return rates.withColumn("before", before).where(F.col("before") - F.col(rate) > least)


def chain_breaks(log: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Log rows whose hash is wrong or does not follow the preceding row's hash."""
    before = F.lag("this_hash").over(W.partitionBy(key).orderBy(order))
    good = F.sha2(F.concat_ws("|", F.coalesce("prev_hash", F.lit("")), payload), 256)
    return log.withColumns({"__before": before, "bad_hash": F.col("this_hash") != good}).withColumn(
        "bad_link", F.col("__before").isNotNull() & ~F.col("prev_hash").eqNullSafe(F.col("__before"))
    ).where("bad_hash or bad_link").drop("__before")


def churn(changes: DataFrame, last: Column, days: int = 90, least: int = 10) -> DataFrame:
    """(file, changes): files with many changes in the last days."""
    return changes.where(F.col("at") > F.date_sub(last, days).cast("timestamp")).groupBy("file").agg(F.count(F.lit(1)).alias("changes")).where(F.col("changes") >= least)


def knowledge_drift(changes: DataFrame, most: float = 0.4, least: int = 8) -> DataFrame:
    """Files whose first author made less than ``most`` of more than ``least`` changes; by two partial aggregations."""
    first = changes.groupBy("file").agg(F.min(F.struct("at", "author")).alias("f"), F.count(F.lit(1)).alias("n")).select("file", F.col("f.author").alias("first_author"), "n")
    by = changes.groupBy("file", "author").agg(F.count(F.lit(1)).alias("own"))
    j = first.join(by, (first["file"] == by["file"]) & (first["first_author"] == by["author"])).select(first["file"], "first_author", "n", "own")
    return j.withColumn("share", F.col("own") / F.col("n")).where((F.col("n") > least) & (F.col("share") < most))


def tangled(changes: DataFrame, files: int = 5, folders: int = 3) -> DataFrame:
    """Commits over many files in several top folders."""
    top = F.element_at(F.split("file", "/"), 1)
    return changes.groupBy("commit").agg(F.countDistinct("file").alias("files"), F.countDistinct(top).alias("folders")).where(
        (F.col("files") >= files) & (F.col("folders") >= folders)
    )


def hotspots(changes: DataFrame, complexity: DataFrame, last: Column, days: int = 90, least: int = 10, complex_from: int = 15) -> DataFrame:
    """(file, changes, complexity): files with many changes in the last days that are complex too; ``complexity`` has (file, complexity)."""
    return churn(changes, last, days, least).join(complexity, "file").where(F.col("complexity") >= complex_from).select("file", "changes", "complexity")


def latest_issues(issues: DataFrame, limit: int = 50) -> DataFrame:
    """The issues seen last, a fingerprint once with its latest sight."""
    one = issues.where("fingerprint is not null").groupBy("fingerprint").agg(F.max("last_seen").alias("last_seen"))
    return one.orderBy(F.col("last_seen").desc_nulls_last(), "fingerprint").limit(limit)
