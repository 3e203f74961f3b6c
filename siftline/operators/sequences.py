"""Ordered and windowed analyses of calls, states and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators.blocks import carried_last, near, with_borders


def forbidden_transitions(events: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Consecutive states of a key that are not among the allowed (a, b) pairs."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(*order))
    steps = events.withColumn("a", before).withColumn("b", F.col(state)).where("a is not null and a <> b")
    return steps.join(F.broadcast(allowed), ["a", "b"], "left_anti")  # pairs of states of a machine


def mined_sequences(calls: DataFrame, who: str, of: str, order: list[str], name: str, least: int = 2, top: int = 10, longest: int = 1000) -> DataFrame:
    """(who, sequence, n, confidence): the most frequent call sequences per user of a kind of object.

    An object's calls are cut into pieces of ``longest``, so that an object with most of all calls is no single row; each piece counts as a sequence.
    """
    place = F.row_number().over(W.partitionBy(who, of).orderBy(*order, name)) - 1
    seq = calls.withColumn("__piece", F.floor(place / longest)).groupBy(who, of, "__piece").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*order, name))), lambda x: x[name]).alias("calls")
    )
    counts = seq.groupBy(who, F.array_join("calls", ">").alias("sequence")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(who).agg(F.sum("n").alias("total"))
    rank = F.row_number().over(W.partitionBy(who).orderBy(F.col("n").desc(), "sequence"))
    return counts.join(total, who).withColumn("rank", rank).where((F.col("rank") <= top) & (F.col("n") >= least)).select(
        who, "sequence", "n", (F.col("n") / F.col("total")).alias("confidence")
    )


def sequence_deviations(calls: DataFrame, mined: DataFrame, who: str, of: str, order: list[str], name: str, sure: float = 0.5) -> DataFrame:
    """(who, of, sequence): objects whose calls differ from the one sequence that at least a share ``sure`` of the others follow."""
    usual = mined.where(F.col("confidence") >= sure).groupBy(who).agg(F.max_by("sequence", "n").alias("usual"))
    seq = calls.groupBy(who, of).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, name))), lambda x: x[name]), ">").alias("sequence"))
    return seq.join(usual, who).where("sequence <> usual").select(who, of, "sequence")


def used_after_close(events: DataFrame, key: str, order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Events of a key after a close that no open has followed."""
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    state = F.when(closes, "closed").when(opens, "open")
    return events.withColumn("__s", F.last(state, ignorenulls=True).over(before)).where((F.col("__s") == "closed") & ~opens).drop("__s")


def runs(lines: DataFrame, flag: Column, least: int = 5) -> DataFrame:
    """(file, first_line, length) of unbroken runs of flagged lines: a run begins where the line before is not flagged, and its beginning is carried along."""
    flagged = lines.where(flag).select("file", "line_no").distinct()
    before = F.lag("line_no").over(near())
    marked = with_borders(flagged, 1, 0).withColumn("__first", F.coalesce(before < F.col("line_no") - 1, F.lit(True))).where("not __copy").drop("__block", "__copy")
    of = carried_last(marked, F.when(F.col("__first"), F.col("line_no")), "first_line")
    return of.groupBy("file", "first_line").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)


def followed_within(lines: DataFrame, flag: Column, by: Column, n: int) -> DataFrame:
    """Flagged lines with whether one of the next n line numbers of the file satisfies a condition."""
    ahead = near().rangeBetween(1, n)
    around = with_borders(lines.withColumns({"__f": flag, "__by": by}), 0, n)
    return around.withColumn("followed", F.coalesce(F.max("__by").over(ahead), F.lit(False))).where("__f and not __copy").drop("__f", "__by", "__block", "__copy")


def first_within(lines: DataFrame, flag: Column, by: Column, n: int, name: str) -> DataFrame:
    """Flagged lines with the first of the next n line numbers of the file that satisfies a condition; those without one are left out."""
    around = with_borders(lines.withColumns({"__f": flag, "__by": F.when(by, F.col("line_no"))}), 0, n)
    return around.withColumn(name, F.min("__by").over(near().rangeBetween(1, n))).where(f"__f and not __copy and {name} is not null").drop("__f", "__by", "__block", "__copy")


def carried(lines: DataFrame, header: Column, name: str) -> DataFrame:
    """Every line with the last header at or before it."""
    return carried_last(lines, header, name)


def extents(lines: DataFrame, header: Column, most: int = 200) -> DataFrame:
    """(file, line_no, name, end_line): from each header to the line before the next, at most ``most`` lines."""
    heads = with_borders(lines.withColumn("name", header).where("name is not null"), 0, most + 1)
    nxt = F.lead("line_no").over(near())
    end = F.least(F.coalesce(nxt - 1, F.col("line_no") + most), F.col("line_no") + most)
    return heads.withColumn("end_line", end).where("not __copy").select("file", "line_no", "name", "end_line")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, start, events): bursts of events separated by at least a gap."""
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), "events")
