"""What changed between full snapshots, by persistent ordinals, bitmaps and aligned column vectors.

Every key gets an ordinal once and for ever: its hash bucket and its rank among the keys of
that bucket; keys that appear later are numbered after the known ones.  A snapshot becomes
pages of ``PAGE`` ordinals: a compressed bitmap of the ordinals that are present, and for each
compared column the vector of value hashes of the present ordinals, in ordinal order.  For two
snapshots, AND-NOT of the bitmaps gives additions and removals; the vectors of the common
ordinals, aligned through the ranks of the bitmaps, show changes and their columns.

Work per page is bounded by PAGE ordinals whatever the data; hot keys collapse in the partial
aggregation that picks the speaking row.

Defined results: rows without a key are left out; of rows with the same latest ``last_seen`` the
one with the greatest content hashes speaks; a null ``last_seen`` is older than any; snapshots
without a single keyed row are not delivered snapshots; null and blank values are equal; the first
snapshot reports nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.keys import key_of, state_of, text_of
from siftline.runtime import materialise, shuffle_partitions
from siftline.sources.bucketed import Manifests

PAGE = 8192
#: The compared columns.
COMPARED = ("rule_id", "file", "line", "severity", "message", "layer", "cwe", "state")

PAGE_SCHEMA = "snapshot_no int, bucket int, page int, bitmap binary, vectors binary"
DIFF_SCHEMA = "snapshot_no int, bucket int, ordinal long, change string, columns int"


def speaking_rows(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, fingerprint, v0..v7): per record and snapshot the hashes of the row that speaks for it."""
    def value(name: str):
        c = F.col(name)
        v = state_of(c) if name == "state" else c.cast("string") if name == "line" else text_of(c)
        return F.xxhash64(F.coalesce(v, F.lit("")))

    vs = [f"v{i}" for i in range(len(COMPARED))]
    rows = snapshots.select(
        F.col("snapshot_no").cast("int").alias("snapshot_no"),
        key_of(F.col("fingerprint")).alias("fingerprint"),
        F.col("last_seen"),
        *[value(c).alias(v) for c, v in zip(COMPARED, vs)],
    ).where("fingerprint is not null and snapshot_no is not null")
    best = rows.groupBy("snapshot_no", "fingerprint").agg(F.max(F.struct("last_seen", *vs)).alias("r"))
    return best.select("snapshot_no", "fingerprint", *[f"r.{v}" for v in vs])


class KeyOrdinals:
    """Persistent numbering of keys: (bucket, ordinal, fingerprint) in a shared folder, only ever extended.

    A manifest names the parts that were written and the number of buckets, so another process that opens the same
    folder goes on where the last one ended, and a part without a manifest counts for nothing.
    """

    ROWS = 2_000_000

    def __init__(self, spark: SparkSession, path: str, least: int = 8):
        self.spark, self.path, self.least = spark, path, least
        self.manifests = Manifests(spark, f"{path}/manifest")

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema("bucket int, ordinal long, fingerprint string").parquet(*[f"{self.path}/{p}" for p in parts])

    def read(self) -> DataFrame | None:
        have = self.manifests.read()
        return self._read(have["parts"]) if have else None

    def extend(self, keys: DataFrame, rows: int = 0) -> DataFrame:
        """Number the keys that have no ordinal yet; returns the whole numbering.  ``rows`` sizes the buckets of a new numbering."""
        version = self.manifests.version()
        have = self.manifests.read(version) or {"parts": [], "buckets": max(self.least, -(-rows // self.ROWS))}
        known = self._read(have["parts"]) if have["parts"] else None
        new = keys.select("fingerprint").distinct()
        if known is not None:
            new = new.join(known.select("fingerprint"), "fingerprint", "left_anti")
        new = new.withColumn("bucket", F.pmod(F.xxhash64("fingerprint"), F.lit(have["buckets"])).cast("int"))
        rank = F.row_number().over(W.partitionBy("bucket").orderBy("fingerprint")).cast("long") - 1
        new = new.withColumn("ordinal", rank)
        if known is not None:
            top = known.groupBy("bucket").agg((F.max("ordinal") + 1).alias("top"))  # at most `buckets` rows
            new = new.join(F.broadcast(top), "bucket", "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("top", F.lit(0)))
        part = f"part-{version + 1}"
        materialise(new.select("bucket", "ordinal", "fingerprint"), f"{self.path}/{part}")
        have["parts"].append(part)
        self.manifests.publish(have, version + 1)
        return self._read(have["parts"])


def _page(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("slot")
    bits = np.zeros(PAGE, dtype=bool)
    bits[g["slot"].to_numpy()] = True
    vectors = np.ascontiguousarray(g[[f"v{i}" for i in range(len(COMPARED))]].to_numpy(dtype=np.int64).T)
    return pd.DataFrame({
        "snapshot_no": g["snapshot_no"].iloc[:1], "bucket": g["bucket"].iloc[:1], "page": g["page"].iloc[:1],
        "bitmap": [zlib.compress(np.packbits(bits).tobytes(), 1)], "vectors": [vectors.tobytes()],
    })


def pages(rows: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Snapshots as pages of a bitmap and aligned column vectors."""
    numbered = rows.join(ordinals, "fingerprint").select(
        "snapshot_no", "bucket", (F.col("ordinal") / PAGE).cast("int").alias("page"),
        (F.col("ordinal") % PAGE).cast("int").alias("slot"), *[f"v{i}" for i in range(len(COMPARED))],
    )
    return numbered.groupBy("bucket", "page", "snapshot_no").applyInPandas(_page, PAGE_SCHEMA)


def _bits(b: bytes | None) -> np.ndarray:
    if b is None:
        return np.zeros(PAGE, dtype=bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(b), dtype=np.uint8)).astype(bool)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    k = len(COMPARED)
    for batch in batches:
        for r in batch.itertuples(index=False):
            cur, prev = _bits(r.bitmap), _bits(r.old_bitmap)
            common = cur & prev
            added, removed = np.flatnonzero(cur & ~prev), np.flatnonzero(prev & ~cur)
            changed, masks = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            if common.any():
                a = np.frombuffer(r.vectors, dtype=np.int64).reshape(k, -1)[:, common[cur]]
                b = np.frombuffer(r.old_vectors, dtype=np.int64).reshape(k, -1)[:, common[prev]]
                mask = ((a != b) * (1 << np.arange(k))[:, None]).sum(axis=0)
                at = np.flatnonzero(common)
                changed, masks = at[mask > 0], mask[mask > 0]
            slots = np.concatenate([added, removed, changed]).astype(np.int64)
            if len(slots):
                yield pd.DataFrame({
                    "snapshot_no": np.int32(r.snapshot_no), "bucket": np.int32(r.bucket),
                    "ordinal": slots + np.int64(r.page) * PAGE,
                    "change": ["added"] * len(added) + ["removed"] * len(removed) + ["changed"] * len(changed),
                    "columns": np.concatenate([np.zeros(len(added) + len(removed), dtype=np.int64), masks]).astype(np.int32),
                })


def snapshot_changes(snapshots: DataFrame, path: str, ordinals: KeyOrdinals | None = None) -> DataFrame:
    """(snapshot_no, fingerprint, change, columns): each snapshot against the preceding delivered one.

    ``columns`` names the changed columns, comma-separated.  ``path`` is a folder for the
    numbering and the pages; pass ``ordinals`` to go on with an existing numbering.
    """
    spark = snapshots.sparkSession
    rows = speaking_rows(snapshots)
    ordinals = ordinals or KeyOrdinals(spark, f"{path}/ordinals", shuffle_partitions(spark))
    numbering = ordinals.extend(rows, snapshots.count())
    page_table = materialise(pages(rows, numbering), f"{path}/pages")
    # one row per snapshot
    steps = page_table.select("snapshot_no").distinct().withColumn("next", F.lead("snapshot_no").over(W.orderBy("snapshot_no")))
    old = (
        page_table.join(F.broadcast(steps.where("next is not null")), "snapshot_no")
        .select(F.col("next").alias("snapshot_no"), "bucket", "page", F.col("bitmap").alias("old_bitmap"), F.col("vectors").alias("old_vectors"))
    )
    cur = page_table.join(F.broadcast(steps.where("next is not null").select(F.col("next").alias("snapshot_no"))), "snapshot_no")
    both = cur.join(old, ["snapshot_no", "bucket", "page"], "full")
    found = both.mapInPandas(_compare, DIFF_SCHEMA)
    names = F.concat_ws(",", *[F.when(F.col("columns").bitwiseAND(1 << i) > 0, c) for i, c in enumerate(COMPARED)])
    return found.join(numbering, ["bucket", "ordinal"]).select("snapshot_no", "fingerprint", "change", names.alias("columns"))
