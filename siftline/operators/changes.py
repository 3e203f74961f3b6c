"""Applying a feed of inserts, updates and deletes to a bucketed copy-on-write table.

Method: the table keeps, per key, the changes that can still matter, hashed by key into
buckets.  A delivery is routed to buckets, sort-merged with the rows of the touched
buckets only, and the replacement files are published with a new manifest.

What can still matter, for any later delivery in any order: the purges at the newest purge
time, the updates with a state at the newest such time, and the opens not older than the
newest purge.  Everything else is dominated for good, so a table stays close to one or two
rows per key although late and repeated changes remain applicable.  The merge also writes the
state of every key beside its first row, so reading the current state is a narrow scan.

Buckets are sized by rows: a table that outgrew its buckets is spread over more of them by the next delivery.

Hot keys: times per key are partial aggregates; the join with them is salted for the heaviest keys, and repeated
changes, whose salt is that of their content, collapse in it.  No task sorts or collects all changes of one key
before the dominated ones are gone.

Defined results: null or blank keys, null actions and unknown actions have no effect; a null
timestamp sorts before every other; ``open`` without a state opens as ``open``; empty feeds give
an empty table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.keys import key_of, squeezed, state_of
from siftline.operators.skew import hot_keys, salted_join
from siftline.runtime import shuffle_partitions
from siftline.sources.bucketed import BucketedTable

CHANGE_SCHEMA = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("old_state", T.StringType()),
    T.StructField("new_state", T.StringType()),
    T.StructField("leads", T.BooleanType()),
    T.StructField("state", T.StringType()),
])

#: What each action does to a record.
INSERTS, UPDATES, DELETES = ("open",), ("confirm", "resolve", "reopen", "baseline", "comment"), ("purge",)


CHANGE = ("ts", "action", "old_state", "new_state")


def normalised(feed: DataFrame) -> DataFrame:
    """The effective columns of raw changes that have a key and a known action."""
    return feed.select(
        key_of(F.col("fingerprint")).alias("fingerprint"),
        F.col("timestamp").cast("timestamp").alias("ts"),
        F.col("id").cast("long").alias("id"),
        squeezed(F.col("action")).alias("action"),
        state_of(F.col("old_state")).alias("old_state"),
        state_of(F.col("new_state")).alias("new_state"),
    ).where(F.col("fingerprint").isNotNull() & F.col("action").isin(*INSERTS, *UPDATES, *DELETES))


def compacted(rows: DataFrame) -> DataFrame:
    """Only changes that can still matter, each distinct one once with its smallest id."""
    purge = F.col("action").isin(*DELETES)
    says = F.col("action").isin(*UPDATES) & F.col("new_state").isNotNull()
    # the times are wrapped, so that a null time differs from none
    bounds = rows.groupBy("fingerprint").agg(
        F.max(F.when(purge, F.struct("ts"))).alias("__purge"), F.max(F.when(says, F.struct("ts"))).alias("__says"), F.count(F.lit(1)).alias("__n")
    )
    hot = hot_keys(bounds.select("fingerprint", "__n"), "fingerprint", "__n")
    joined = salted_join(rows, bounds.drop("__n"), "fingerprint", hot, F.xxhash64(*CHANGE), "inner", keep_salt=True)
    keep = (
        (purge & F.col("ts").eqNullSafe(F.col("__purge.ts")))
        | (says & F.col("ts").eqNullSafe(F.col("__says.ts")))
        | (F.col("action").isin(*INSERTS) & (F.col("__purge").isNull() | F.col("__purge.ts").isNull() | (F.col("ts") >= F.col("__purge.ts"))))
    )
    # equal changes have one salt, so they meet where the join left them
    return joined.where(keep).groupBy("fingerprint", "__salt", *CHANGE).agg(F.min("id").alias("id")).drop("__salt")


def with_state(rows: DataFrame) -> DataFrame:
    """Compacted rows, partitioned by key, with the key's state (null where it does not exist) and a mark on the key's first row."""
    key, order = W.partitionBy("fingerprint"), F.struct("ts", "id")
    says = F.col("action").isin(*UPDATES) & F.col("new_state").isNotNull()
    rows = rows.withColumn("__purge", F.max(F.when(F.col("action").isin(*DELETES), order)).over(key))
    opens = F.col("action").isin(*INSERTS) & (F.col("__purge").isNull() | (order > F.col("__purge")))
    told = F.struct("ts", "id", "new_state")
    rows = rows.withColumns({
        "__open": F.min(F.when(opens, told)).over(key), "__last": F.max(F.when(says, told)).over(key)
    })
    later = F.struct("__last.ts", "__last.id") > F.struct("__open.ts", "__open.id")
    state = F.when(F.col("__last").isNotNull() & later, F.col("__last.new_state")).otherwise(F.coalesce("__open.new_state", F.lit("open")))
    rows = rows.withColumn("__place", F.row_number().over(key.orderBy("ts", "id")))
    return rows.select("fingerprint", "id", *CHANGE, (F.col("__place") == 1).alias("leads"), F.when(F.col("__open").isNotNull(), state).alias("state"))


class ChangeTable:
    """Current state of records, rebuilt by applying deliveries of changes in any order."""

    def __init__(self, spark, path: str):
        self.table = BucketedTable(spark, path, "fingerprint", CHANGE_SCHEMA, shuffle_partitions(spark))

    def apply(self, feed: DataFrame) -> int:
        """Merge one delivery; returns the published version."""
        t = self.table
        rows = normalised(feed)
        have = t.manifest()
        n = have["buckets"]
        if n and have["rows"] <= 2 * n * t.ROWS:
            touched = [r[0] for r in rows.select(t.bucket_of(F.col("fingerprint"), n)).distinct().collect()]  # at most `buckets` rows
        else:
            n = t.wanted(have["rows"] if n else feed.count())
            touched = list(range(n))
        if have["at"]:
            base = t.read(touched if n == have["buckets"] else None)
            rows = rows.unionByName(base.select(*rows.columns))
        merged = with_state(compacted(rows).repartition(n, "fingerprint"))
        return t.commit(merged, touched, n)

    def state(self, version: int | None = None) -> DataFrame:
        """(fingerprint, state) of every record that exists."""
        return self.table.read(version=version).where("leads and state is not null").select("fingerprint", "state")
