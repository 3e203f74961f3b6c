"""Versioned manifests and bucketed copy-on-write tables in a shared folder."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.runtime import hadoop_fs

BUCKET = "__bucket"


class Manifests:
    """Numbered JSON documents of which the newest counts; a stored table's content is what its manifest names.

    A manifest is written under a temporary name and renamed without overwriting, so readers see one whole version
    and of two writers of the same version one fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        fs, p = hadoop_fs(self.spark, self.path)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])

    def read(self, version: int | None = None):
        """The document of a version, the newest by default; None where there is none."""
        v = self.version() if version is None else version
        if not v:
            return None
        fs, p = hadoop_fs(self.spark, f"{self.path}/{v}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, document, version: int) -> int:
        fs, tmp = hadoop_fs(self.spark, f"{self.path}/.{version}.tmp")
        fs.mkdirs(tmp.getParent())
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps(document).encode()))
        stream.close()
        _, final = hadoop_fs(self.spark, f"{self.path}/{version}.json")
        if fs.exists(final) or not fs.rename(tmp, final):
            raise RuntimeError(f"version {version} in {self.path} was published by another writer")
        return version


class BucketedTable:
    """Rows hashed by a key into buckets; each commit rewrites only touched buckets.

    Layout: ``data/v<N>/__bucket=<b>/*.parquet`` and one manifest per version with, for every bucket that has rows,
    the version whose files hold it.  A bucket is what ``repartition(buckets, key)`` puts into one partition, so rows are
    routed, merged and written in one exchange.  The number of buckets is part of the manifest: it follows from the
    rows of the first commit, at least ``least``, and a commit of all buckets may choose another one.
    """

    ROWS = 500_000

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, least: int = 8):
        self.spark, self.path, self.key, self.schema, self.least = spark, path, key, schema, least
        self.manifests = Manifests(spark, f"{path}/manifest")

    def bucket_of(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.hash(key), F.lit(buckets)).cast("int")

    def wanted(self, rows: int) -> int:
        """Number of buckets for so many rows."""
        return max(self.least, -(-rows // self.ROWS))

    def version(self) -> int:
        return self.manifests.version()

    def manifest(self, version: int | None = None) -> dict:
        """{"buckets": number, "rows": number, "at": {bucket: version}} of a version; empty before the first commit."""
        found = self.manifests.read(version) or {"buckets": 0, "rows": 0, "at": {}}
        return found | {"at": {int(b): v for b, v in found["at"].items()}}

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows of the given buckets (all by default) of a version (the newest by default)."""
        at = self.manifest(version)["at"]
        files = [f"{self.path}/data/v{v}/{BUCKET}={b}" for b, v in sorted(at.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, touched: list[int], buckets: int) -> int:
        """Replace the content of ``touched`` buckets by ``rows``, already partitioned by ``repartition(buckets, key)``, and publish a new version."""
        old = self.version()
        new = old + 1
        out = f"{self.path}/data/v{new}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], self.bucket_of(F.col(self.key), buckets).alias(BUCKET))
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(out)
        fs, p = hadoop_fs(self.spark, out)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        written = {int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")}
        before = self.manifest(old)
        kept = {b: v for b, v in before["at"].items() if b not in set(touched)} if before["buckets"] == buckets else {}
        at = kept | {b: new for b in written}
        files = [f"{self.path}/data/v{v}/{BUCKET}={b}" for b, v in at.items()]
        count = self.spark.read.schema(self.schema).parquet(*files).count() if files else 0  # from the file footers
        return self.manifests.publish({"buckets": buckets, "rows": count, "at": at}, new)
