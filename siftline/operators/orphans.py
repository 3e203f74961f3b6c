"""References to records that do not exist, by range-partitioned sorted arrays and binary search.

Parent keys are cut into ranges; each range is stored as one row of aligned sorted arrays (key,
first sight, last purge).  References are routed to their range, heavy ranges of references are
spread over salts, and batches are probed with a vectorised binary search.  Only the range bounds
reach the driver, one string per RANGE_ROWS parents and partition.

Defined results: a null or blank key is no reference; a reference without a date is never early
and never after a purge, and its period is null; repeated reference rows are reported once; a reference
without a row number is reported without one; several rows of a parent count with the earliest first sight; empty tables give no rows or, for parents,
only misses; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.keys import key_of, squeezed
from siftline.runtime import materialise, shuffle_partitions

PARENT, PROBE = 0, 1
SALT_ROWS = 500_000
RANGE_ROWS = 500_000


def parents(issues: DataFrame, history: DataFrame) -> DataFrame:
    """(k, first_seen, purged): every key that is an issue or was purged; microseconds, null where not."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    have = issues.select(
        key_of(F.col("fingerprint")).alias("k"), F.lit(True).alias("here"),
        micros(F.col("first_seen")).alias("first_seen"), F.lit(None).cast("long").alias("purged"),
    )
    gone = history.where(squeezed(F.col("action")) == "purge").select(
        key_of(F.col("fingerprint")).alias("k"), F.lit(False).alias("here"),
        F.lit(None).cast("long").alias("first_seen"), micros(F.col("timestamp")).alias("purged"),
    )
    return (
        have.unionByName(gone).where("k is not null").groupBy("k")
        .agg(F.max("here").alias("here"), F.min("first_seen").alias("first_seen"), F.max("purged").alias("purged"), F.count(F.when(~F.col("here"), 1)).alias("purges"))
    )


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of aligned sorted arrays, as bytes, of at most RANGE_ROWS rows each, from a sorted partition; a block is a range of its own."""
    held: list[pa.RecordBatch] = []
    n = 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return pa.RecordBatch.from_arrays([table["keys"].slice(0, 1).combine_chunks().cast(pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["lo", "arrays"])

    for batch in batches:
        while len(batch):
            part = batch.slice(0, RANGE_ROWS - n)
            held.append(part)
            n, batch = n + len(part), batch.slice(len(part))
            if n == RANGE_ROWS:
                yield block()
                held, n = [], 0
    if n:
        yield block()


STORE_SCHEMA = "lo string, arrays binary"
#: Stands for "no time" in the arrays, so that no comparison with it is true.
NO_LOW, NO_HIGH = -(2**62), 2**62
#: Stands for a missing row number while rows pass through the workers, where whole numbers must stay whole.
NO_ID = -(2**63)


def parent_store(parent_rows: DataFrame, path: str, ranges: int) -> DataFrame:
    """Write the parents as one row of sorted arrays per key range, cut into ``ranges`` partitions and within them by RANGE_ROWS."""
    no_time = lambda c: F.coalesce(c, F.lit(NO_LOW)).alias(c)
    ordered = parent_rows.repartitionByRange(ranges, "k").sortWithinPartitions("k")
    chosen = ordered.select(F.col("k").alias("keys"), "here", no_time("first_seen"), no_time("purged"), "purges")
    return materialise(chosen.mapInArrow(_store, STORE_SCHEMA), path)


def references(table: DataFrame, name: str, key: str, row_id: str, dated: str) -> DataFrame:
    return table.select(
        F.lit(name).alias("ref_table"), F.col(row_id).cast("long").alias("row_id"),
        key_of(F.col(key)).alias("k"), F.col(dated).cast("timestamp").alias("dated"),
    ).where("k is not null")


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (range, salt, kind): a range's arrays, then its references."""
    empty = np.empty(0, dtype=np.int64)
    at, keys, here, first, purged, purges = None, np.empty(0, dtype=object), empty.astype(bool), empty, empty, empty
    for batch in batches:
        place = batch["range_id"].to_numpy(dtype=np.int64) * (1 << 20) + batch["salt"].to_numpy(dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part = batch.iloc[lo:hi]
            if place[lo] != at:
                at, keys = place[lo], np.empty(0, dtype=object)
            if part["kind"].iloc[0] == PARENT:
                table = pa.ipc.open_stream(part["arrays"].iloc[0]).read_all()
                keys = table["keys"].to_pandas().to_numpy(dtype=object)
                here, first, purged, purges = (table[c].to_numpy() for c in ("here", "first_seen", "purged", "purges"))
                part = part.iloc[1:]
            if not len(part):
                continue
            micros = part["micros"].astype("Int64")
            late, early = micros.fillna(NO_LOW).to_numpy(dtype=np.int64), micros.fillna(NO_HIGH).to_numpy(dtype=np.int64)
            probe = part["k"].to_numpy(dtype=object)
            reason = np.full(len(part), None, dtype=object)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                hit = keys[i] == probe
                issue = hit & here[i]
                bought = hit & ~here[i] & (purges[i] > 0)
                reason[issue & (first[i] != NO_LOW) & (early < first[i])] = "early"
                reason[bought & (purged[i] != NO_LOW) & (late > purged[i])] = "deleted"
                reason[~issue & ~bought] = "missing"
            else:
                reason[:] = "missing"
            miss = reason != None  # noqa: E711
            if miss.any():
                yield pd.DataFrame({
                    "ref_table": part["ref_table"].to_numpy()[miss], "row_id": part["row_id"].to_numpy(dtype=np.int64)[miss],
                    "micros": micros[miss].to_numpy(dtype=object), "reason": reason[miss],
                })


def orphan_rows(refs: DataFrame, parent_rows: DataFrame, path: str, ranges: int | None = None) -> DataFrame:
    """(ref_table, period, row_id, reason) of every reference whose record does not exist for it."""
    spark = refs.sparkSession
    ranges = ranges or 2 * shuffle_partitions(spark)
    store = parent_store(parent_rows, path, ranges)
    bounds = [r["lo"] for r in store.select("lo").orderBy("lo").collect()]  # a string per range: one per RANGE_ROWS parents, and per partition

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        found = np.searchsorted(np.asarray(bounds, dtype=object), k.to_numpy(dtype=object), side="right") - 1
        return pd.Series(np.maximum(found, 0).astype(np.int32))

    routed = refs.withColumn("range_id", range_of("k") if bounds else F.lit(0))
    heavy = {
        r["range_id"]: 1 + r["count"] // SALT_ROWS
        for r in routed.groupBy("range_id").count().where(F.col("count") > SALT_ROWS).collect()  # a row per range
    }
    spread = F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv])[F.col("range_id")] if heavy else F.lit(None).cast("long")
    routed = routed.select(
        "range_id", F.when(spread.isNotNull(), F.pmod(F.xxhash64("row_id"), spread)).otherwise(0).cast("int").alias("salt"),
        F.lit(PROBE).alias("kind"), "ref_table", F.coalesce("row_id", F.lit(NO_ID)).alias("row_id"), "k", F.unix_micros("dated").alias("micros"),
    )
    if bounds:
        arrays = store.withColumn("range_id", range_of("lo")).select(
            "range_id", F.explode(F.sequence(F.lit(0), (F.coalesce(spread, F.lit(1)) - 1).cast("int"))).alias("salt"),
            F.lit(PARENT).alias("kind"), F.lit(NO_ID).alias("row_id"), "arrays",
        )
        both = routed.unionByName(arrays, allowMissingColumns=True)
    else:
        both = routed.withColumn("arrays", F.lit(None).cast("binary"))
    ordered = both.repartitionById(max(ranges, len(bounds)), F.col("range_id") + F.col("salt")).sortWithinPartitions("range_id", "salt", "kind")
    found = ordered.mapInPandas(_probe, "ref_table string, row_id long, micros long, reason string")
    return found.select(
        "ref_table", F.date_format(F.timestamp_micros("micros"), "yyyy-MM").alias("period"), F.nullif("row_id", F.lit(NO_ID)).alias("row_id"), "reason"
    ).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, month and reason."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("n"))
