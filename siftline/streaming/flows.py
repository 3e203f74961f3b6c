"""Structured Streaming forms: rescans by content hash, debounced sets, lifecycle merges, trends, feedback counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftline.operators.changes import ChangeTable


class _Changed(StatefulProcessor):
    """Keeps a file's last hash and gives the arrivals that differ from it, in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sha string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        # only times and hashes of one file in one micro-batch
        for r in sorted((t for b in rows for t in b[["at", "sha"]].itertuples(index=False)), key=lambda t: (t.at, t.sha)):
            if r.sha != last:
                out.append((key[0], r.at, r.sha, "changed" if last is not None else "new"))
                last = r.sha
        self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["file", "at", "sha", "kind"])

    def close(self) -> None:
        pass


def changed_files(arrivals: DataFrame) -> DataFrame:
    """(file, at, sha, kind): arrivals of (file, content, at) whose content differs from the file's last one; only the hash is kept as state.

    Needs the RocksDB state store.
    """
    hashed = arrivals.select("file", "at", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"))
    return hashed.groupBy("file").transformWithStateInPandas(_Changed(), "file string, at timestamp, sha string, kind string", "Append", "None")


def changed_files_batch(arrivals: DataFrame, scanned: DataFrame) -> DataFrame:
    """Batch form: files whose (file, sha) was not scanned yet."""
    hashed = arrivals.select("file", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha")).distinct()
    return hashed.join(scanned, ["file", "sha"], "left_anti")


def quiet_sets(changes: DataFrame, lateness: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """(root, file, start, end, n): every file of a burst of changes under a top folder, given out once the file has been quiet for the gap.

    A burst is kept per file, so the state of a folder with very many changed files is spread over them; files of one burst
    are those of a folder whose times overlap.
    """
    return (
        changes.withWatermark("at", lateness).withColumn("root", F.element_at(F.split("file", "/"), 1)).groupBy("root", "file", F.session_window("at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n")).select("root", "file", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def trend(changes: DataFrame, time: str, lateness: str = "1 day", width: str = "7 days") -> DataFrame:
    """(start, action, n): changes per window of a week."""
    return changes.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def feedback_counters(feedback: DataFrame) -> DataFrame:
    """(rule_id, tp, fp, suppressed): running counters per rule, for update mode."""
    c = feedback.groupBy("rule_id").agg(F.count_if(F.col("kind") == "tp").alias("tp"), F.count_if(F.col("kind") == "fp").alias("fp"))
    n = F.col("tp") + F.col("fp")
    return c.withColumn("suppressed", (n >= 5) & (F.col("fp") > 0.5 * n))


def maintain(feed: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps a change table current; a batch that is delivered again changes nothing, as repeated changes count once."""
    table = ChangeTable(feed.sparkSession, path)

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.apply(batch)

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decayed(hotspots: DataFrame, days: int = 90) -> DataFrame:
    """Hotspots whose review is older than the given days put back to review, against the clock of each micro-batch."""
    from siftline.operators.metrics import decayed_hotspots

    return decayed_hotspots(hotspots, F.current_timestamp(), days)
