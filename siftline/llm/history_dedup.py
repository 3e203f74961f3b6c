"""Deduplicating new batches against all history, with Bloom filters and a persistent fingerprint store.

A finding's content is its kind of defect, file name, line and function.  Equal contents are one
class with its earliest order, so copies never multiply.  A class is winnowed: of the GRAM-grams of
the function name those with the smallest hashes are kept, so many that names the verification accepts
always have one in common, and hashed together with kind, file name and band of lines.

The index is a folder: per accepted delivery a table of its classes, a store of (fingerprint, class) laid out by
bucket, and Bloom filters, one per bucket and delivery, with ten bits a fingerprint.  A manifest names the parts, so
another process that opens the folder goes on where the last one ended.  Buckets are sized by rows; their number doubles as the
store grows, and a filter of fewer buckets serves all buckets its own was split into.

A new delivery's fingerprints are routed to their buckets and screened by the filters there; only filters and the delivery
travel, no row of the store is read.  Positive fingerprints are then looked up in the files of the buckets that have any, which
are scanned where they lie.  Fingerprints that occur again within the delivery are positive too, and are looked up
in its own part.  Candidates are verified: lines at most LINES apart, function names at most EDITS edits apart; one shared
fingerprint makes a candidate, so none that would be accepted is lost.  Then the manifest with the delivery's part is published.
No delivery reads the texts of the history again, and the result does not depend on how batches are grouped into deliveries.

Hot keys: the fingerprint contains the band of lines, so a hot file or rule is spread over its bands, and buckets follow the
whole fingerprint, so a band with very many names is spread over buckets; copies collapse into classes in a partial
aggregation; what is broadcast is at most MOST_SENT rows, beyond which rows are exchanged, those of hot classes salted.

Defined results: a row without file or kind can only repeat a row that lacks the same; without a line
it repeats rows without a line; where no function is recognised, the other's function must be found in
the squeezed wording, or both whole wordings must agree up to EDITS edits, of one that visibly ends in an
ellipsis as much as it has; repeated deliveries of an item_id are one row; empty
deliveries give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import findings
from siftline.operators.skew import hot_keys, salted_join
from siftline.runtime import hadoop_fs, materialise, shuffle_partitions
from siftline.sources.bucketed import Manifests

GRAM = 2
LINES, BAND = 25, 50
EDITS = 3
BITS, HASHES = 10, 4
#: Order of everything that was accepted before the first delivery.
BEFORE = -1

#: Rows of a bucket, and the most rows that are sent to every executor.
BUCKET_ROWS = 1_000_000
MOST_SENT = 500_000

FEATURES = "ord long, g long, line int, name string, c binary"
CLASSES = "cid long, g long, line int, name string, ord long, n long"
PRINTS = "f long, cid long"
PROBE = "f long, cid long, own boolean"
SCREENED = "kind int, f long, cid long, bucket int, bits binary"


def _h64(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        order, rule, file, line, message = (batch.column(i).to_pylist() for i in range(5))
        gs, names, cs = [], [], []
        for r, p, n, m in zip(rule, file, line, message):
            block = f"{findings.kind_of(r)}|{findings.base_name(p)}"
            name = findings.function_of(m)
            if not name:
                name = "~" + findings.squeeze(m) + ("…" if (m or "").rstrip().endswith(("...", "…")) else "")
            gs.append(_h64(block))
            names.append(name)
            cs.append(xxhash.xxh3_128_digest(f"{block}|{n}|{name}"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(order, pa.int64()), pa.array(gs, pa.int64()), batch.column(3), pa.array(names, pa.string()), pa.array(cs, pa.binary())],
            names=["ord", "g", "line", "name", "c"],
        )


def features(rows: DataFrame, order: str | None) -> DataFrame:
    """(ord, g, line, name, c) of raw findings; without an order column they count as accepted before."""
    chosen = rows.select(
        (F.col(order).cast("long") if order else F.lit(BEFORE).cast("long")).alias("ord"),
        "rule_id", "file", F.col("line").cast("int").alias("line"), "message",
    )
    return chosen.mapInArrow(_features, FEATURES)


def classes(of: DataFrame) -> DataFrame:
    return of.groupBy("c", "g", "line", "name").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))


def _spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of whole numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x


def most_edits(length: int | np.ndarray) -> np.ndarray:
    """Edits allowed to a name of a length."""
    return np.minimum(EDITS, np.asarray(length) // 4)


def winnowed(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the kept grams of names; of wording (~) all, as any function may hide in it.

    An edit changes at most GRAM grams, so of any GRAM * edits + 1 of a name one is left in whatever the name
    agrees with.  The smallest hashes are kept, so two names also keep the same one.  Equal grams of a name are
    numbered, as they change one by one.
    """
    bodies = [n.lstrip("~").encode().ljust(GRAM, b"_") for n in names]
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8).astype(np.uint64)
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    n = len(data) - GRAM + 1
    owner = np.repeat(np.arange(len(names)), sizes)[:n]
    gram = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        gram = gram * np.uint64(256) + data[j : j + n]
    whole = np.arange(n) + GRAM <= np.cumsum(sizes)[owner]
    owner, gram = owner[whole], gram[whole]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    h = _spread(gram | (_rank(new).astype(np.uint64) << np.uint64(8 * GRAM)))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = owner[1:] != owner[:-1]
    wording = np.array([x[:1] == "~" for x in names], dtype=bool)
    keep = wording[owner] | (_rank(new) <= GRAM * most_edits(sizes)[owner])
    return owner[keep], h[keep]


def _rank(new: np.ndarray) -> np.ndarray:
    """Places of rows within their runs, from where runs begin."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _fingerprints(g: np.ndarray, band: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return _spread(_spread(g.astype(np.int64).view(np.uint64) ^ _spread(band.astype(np.int64).view(np.uint64))) ^ gram).view(np.int64)


def _once(owner: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of an owner once."""
    order = np.lexsort((f, owner))
    owner, f = owner[order], f[order]
    new = np.ones(len(f), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (f[1:] != f[:-1])
    return owner[new], f[new]


NO_LINE = -(2**40)


def _lines(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_LINE).to_numpy(zero_copy_only=False)


def _store_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, gram = winnowed(batch.column(2).to_pylist())
        g, line = batch.column(0).to_numpy(zero_copy_only=False), _lines(batch.column(1))
        owner, f = _once(owner, _fingerprints(g[owner], (line // BAND)[owner], gram))
        yield pa.RecordBatch.from_arrays([pa.array(f), batch.column(3).take(pa.array(owner))], names=["f", "cid"])


def _probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, gram = winnowed(batch.column(2).to_pylist())
        g, line = batch.column(0).to_numpy(zero_copy_only=False), _lines(batch.column(1))
        here = line // BAND
        sides = []
        for band in ((line - LINES) // BAND, (line + LINES) // BAND):
            # a line's own band is among the two; without a line there is one
            band = np.where(line == NO_LINE, here, band)
            o, f = _once(owner, _fingerprints(g[owner], band[owner], gram))
            sides.append((o, f, (band == here)[o]))
        (o1, f1, own1), (o2, f2, own2) = sides
        other = ((line - LINES) // BAND != (line + LINES) // BAND)[o2] & (line != NO_LINE)[o2]
        owner, f, own = np.concatenate([o1, o2[other]]), np.concatenate([f1, f2[other]]), np.concatenate([own1, own2[other]])
        yield pa.RecordBatch.from_arrays([pa.array(f), batch.column(3).take(pa.array(owner)), pa.array(own)], names=["f", "cid", "own"])


def _places(f: np.ndarray, size: int) -> np.ndarray:
    u = f.astype(np.int64).view(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(u + np.uint64(i) * step) & np.uint64(size - 1) for i in range(HASHES)]).astype(np.int64)


def _filter(f: np.ndarray) -> bytes:
    size = max(64, 1 << int(np.ceil(np.log2(BITS * len(f)))))
    bits = np.zeros(size, dtype=bool)
    bits[_places(f, size).ravel()] = True
    return np.packbits(bits).tobytes()


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter per bucket from (bucket, f), of what a task holds of it."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        bucket, f = (batch.column(i).to_numpy() for i in range(2))
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                held.setdefault(int(bucket[lo]), []).append(f[lo:hi].copy())
    for b, parts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_filter(np.concatenate(parts))], pa.binary())], names=["bucket", "bits"])


FILTER, ASKED = 0, 1
POSITIVE, STORED = 1, 2


def _rows(kind: int, f: np.ndarray, cid: np.ndarray, bucket: int, bits: bytes | None = None) -> pa.RecordBatch:
    n = len(f)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, dtype=np.int32)), pa.array(f, pa.int64()), pa.array(cid, pa.int64()), pa.array(np.full(n, bucket, dtype=np.int32)), pa.array([bits] * n, pa.binary())],
        names=["kind", "f", "cid", "bucket", "bits"],
    )


class _Bucket:
    """Filters of one bucket, and the delivery's fingerprints as they come in."""

    def __init__(self, number: int):
        self.number, self.filters, self.own = number, [], []
        # the run of equal fingerprints at the end of what was seen, its own rows, and one of them that waits for a second
        self.run, self.seen, self.waits = None, 0, None

    def known(self, f: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(f), dtype=bool)
        for bits in self.filters:
            hit |= bits[_places(f, len(bits))].all(axis=0)
        return hit

    def ask(self, f: np.ndarray, cid: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        mine = own == 1
        if mine.any():
            self.own.append(f[mine].copy())
            yield _rows(STORED, f[mine], cid[mine], self.number)
        if self.waits:
            f, cid, own = np.append(self.waits[0], f), np.append(self.waits[1], cid), np.append(1, own)
        start = np.ones(len(f), dtype=bool)
        start[1:] = f[1:] != f[:-1]
        run = np.cumsum(start) - 1
        owns = np.bincount(run, weights=own).astype(np.int64)
        if f[0] == self.run:
            owns[0] += self.seen
        # in its own band, one of the equal fingerprints is the asking class's
        hit = (owns[run] > own) | self.known(f)
        self.run, self.seen, self.waits = f[-1], int(owns[-1]), None
        if own[-1] == 1 and owns[-1] == 1:
            self.waits, self.seen, hit[-1] = (f[-1], cid[-1]), 0, False
        if hit.any():
            yield _rows(POSITIVE, f[hit], cid[hit], self.number)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.waits:
            f, cid = np.array([self.waits[0]]), np.array([self.waits[1]])
            if self.known(f)[0]:
                yield _rows(POSITIVE, f, cid, self.number)
        if self.own:
            yield _rows(FILTER, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), self.number, _filter(np.concatenate(self.own)))


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, kind, f, cid, own, bits) come sorted by (bucket, kind, f, own first): a bucket's filters, then the delivery's fingerprints.

    Gives the positive fingerprints, the delivery's own ones for its store, and a filter of those.
    """
    b = None
    for batch in batches:
        bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1), len(bucket)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi <= lo:
                continue
            if b is None or bucket[lo] != b.number:
                if b:
                    yield from b.close()
                b = _Bucket(int(bucket[lo]))
            part = batch.slice(lo, hi - lo)
            if kind[lo] == FILTER:
                b.filters.extend(np.unpackbits(np.frombuffer(x, dtype=np.uint8)).astype(bool) for x in part.column(5).to_pylist())
            else:
                yield from b.ask(part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False).astype(np.int64))
    if b:
        yield from b.close()


def _names_agree(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether names agree: plain ones were compared before; for names of which one at least is squeezed wording (marked by ~, and by … at the end where it was visibly cut off)."""
    def same(x: str, y: str) -> bool:
        if x[:1] != "~" and y[:1] != "~":
            return True
        if x[:1] == "~" and y[:1] == "~":
            a, b = sorted((x[1:], y[1:]), key=len)
            if a.endswith("…"):
                a, b = a[:-1], b.rstrip("…")[: len(a) - 1]
            else:
                b = b.rstrip("…")
            return a == b or (min(len(a), len(b)) >= 12 and findings.edits(a, b, EDITS) <= EDITS)
        text, name = (x[1:], y) if x[:1] == "~" else (y[1:], x)
        most = min(EDITS, len(name) // 4)
        return bool(name) and findings.edits_inside(name, text, most) <= most

    return pd.Series([same(x, y) for x, y in zip(a, b)], dtype=bool)


class HistoryIndex:
    """Everything accepted so far, in a shared folder: classes, fingerprint store and Bloom filters of every accepted delivery."""

    def __init__(self, spark: SparkSession, path: str, least: int | None = None):
        self.spark, self.path, self.least = spark, path, least or max(8, shuffle_partitions(spark))
        self.manifests = Manifests(spark, f"{path}/manifest")
        # {"parts": [{"name", "buckets", "prints", "classes"}]}; kept between deliveries of one writer
        self.version = self.manifests.version()
        self.parts = (self.manifests.read(self.version) or {"parts": []})["parts"]

    def _buckets(self, more: int) -> int:
        """Number of buckets for the store with so many more classes: a least number, doubled until a bucket is small."""
        n = max([self.least, *(p["buckets"] for p in self.parts)])
        while sum(p["classes"] for p in self.parts) + more > n * BUCKET_ROWS // 8:  # a class has about seven fingerprints
            n *= 2
        return n

    def _read(self, name: str, schema: str, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p['name']}/{name}" for p in parts])

    def _publish(self, part: dict) -> None:
        self.parts.append(part)
        self.version = self.manifests.publish({"parts": self.parts}, self.version + 1)

    def _numbered(self, of: DataFrame, name: str) -> DataFrame:
        """Classes of a delivery with numbers that no other delivery has, written."""
        number = F.lit(self.version + 1).cast("long") * 2**50 + F.monotonically_increasing_id()
        return materialise(classes(of).withColumn("cid", number), f"{self.path}/{name}/classes")

    def accept(self, rows: DataFrame) -> None:
        """Add rows that count as accepted before the first delivery."""
        name = f"part-{self.version + 1}"
        known = self._numbered(features(rows, None), name)
        n = known.count()
        buckets = self._buckets(n)
        bucket = F.pmod(F.col("f"), F.lit(buckets)).cast("int")
        prints = known.select("g", "line", "name", "cid").mapInArrow(_store_rows, PRINTS).withColumn("bucket", bucket)
        prints = prints.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("f")
        prints.write.partitionBy("bucket").parquet(f"{self.path}/{name}/prints")
        stored = self.spark.read.schema(PRINTS + ", bucket int").parquet(f"{self.path}/{name}/prints").select("bucket", "f")
        materialise(stored.mapInArrow(_filters, "bucket int, bits binary"), f"{self.path}/{name}/filters")
        self._publish({"name": name, "buckets": buckets, "prints": "prints", "filters": "filters", "classes": n})

    def _screened(self, known: DataFrame, name: str, buckets: int) -> DataFrame:
        """Positive fingerprints (f, cid, bucket) of a delivery's classes; its store and filters are written beside them."""
        bucket = F.pmod(F.col("f"), F.lit(buckets)).cast("int")
        asked = known.select("g", "line", "name", "cid").mapInArrow(_probe_rows, PROBE)
        rows = asked.select(bucket.alias("bucket"), F.lit(ASKED).alias("kind"), "f", "cid", "own", F.lit(None).cast("binary").alias("bits"))
        for size in sorted({p["buckets"] for p in self.parts}):
            some = [p for p in self.parts if p["buckets"] == size]
            filters = self.spark.read.schema("bucket int, bits binary").parquet(*[f"{self.path}/{p['name']}/{p['filters']}" for p in some])
            # a bucket of a smaller number of buckets was split into these
            split = filters.select(F.explode(F.sequence(F.col("bucket"), F.lit(buckets - 1), F.lit(size))).alias("bucket"), "bits")
            rows = rows.unionByName(split.select(
                "bucket", F.lit(FILTER).alias("kind"), F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("cid"), F.lit(True).alias("own"), "bits"
            ))
        ordered = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind", "f", F.col("own").desc())
        ordered.mapInArrow(_screen, SCREENED).write.partitionBy("kind").parquet(f"{self.path}/{name}/screened")
        return self._part(f"{name}/screened/kind={POSITIVE}", PRINTS + ", bucket int")

    def _part(self, name: str, schema: str) -> DataFrame:
        """A written table, empty where nothing was written."""
        fs, p = hadoop_fs(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if fs.exists(p) else self.spark.createDataFrame([], schema)

    def screen(self, rows: DataFrame, order: str) -> DataFrame:
        """The orders of delivered rows that repeat something accepted, or an earlier row of the delivery; then accepts them."""
        name = f"part-{self.version + 1}"
        of = materialise(features(rows, order), f"{self.path}/{name}/rows")
        known = self._numbered(of, name)
        n = known.count()
        if not n:
            return self.spark.createDataFrame([], "ord long")
        buckets = self._buckets(n)
        positive = self._screened(known, name, buckets)
        here = {"name": name, "buckets": buckets, "prints": f"screened/kind={STORED}", "filters": f"screened/kind={FILTER}", "classes": n}
        first = self._first(known, positive, [*self.parts, here])
        found = materialise(self._repeated(of, first, n), f"{self.path}/{name}/found")
        self._publish(here)
        return found

    def _first(self, known: DataFrame, positive: DataFrame, parts: list[dict]) -> DataFrame:
        """(c, first): classes with the earliest order of what they repeat, their own where that is nothing earlier."""
        sizes = positive.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most a row per bucket
        asked, touched = sum(r["n"] for r in sizes), {r["bucket"] for r in sizes}
        if not asked:
            return known.select("c", "n", F.col("ord").alias("first"))
        few = asked <= MOST_SENT
        sent = F.broadcast if few else lambda df: df
        # read only the buckets that have positives; a part of fewer buckets holds them in what was split; parts of one layout are one scan
        layouts: dict[tuple[str, int], list[str]] = {}
        for p in parts:
            layouts.setdefault((p["prints"], p["buckets"]), []).append(f"{self.path}/{p['name']}/{p['prints']}")
        pairs = None
        for (name, size), paths in layouts.items():
            own = sorted({b % size for b in touched})
            for some in [paths] if name != "prints" else [[x] for x in paths]:
                store = self.spark.read.schema(PRINTS + ", bucket int").parquet(*some)
                if len(own) < size:
                    store = store.where(F.col("bucket").isin(own))
                store = store.select("f", F.col("cid").alias("o_cid"))
                pairs = store if pairs is None else pairs.unionByName(store)
        pairs = pairs.join(sent(positive.select("f", "cid")), "f").where("cid <> o_cid").select("cid", "o_cid").distinct()
        asking = known.select("cid", "ord", "line", "name")
        pairs = pairs.join(F.broadcast(asking) if few else asking, "cid")  # no more classes than fingerprints
        pairs = materialise(pairs, f"{self.path}/{parts[-1]['name']}/pairs")
        others = self._read("classes", "cid long, line int, name string, ord long", parts).select(
            F.col("cid").alias("o_cid"), F.col("line").alias("o_line"), F.col("name").alias("o_name"), F.col("ord").alias("o_ord")
        )
        few = pairs.count() <= MOST_SENT
        near = others.join(F.broadcast(pairs) if few else pairs, "o_cid").where(
            (F.abs(F.col("line") - F.col("o_line")) <= LINES) | (F.col("line").isNull() & F.col("o_line").isNull())
        ).where("o_ord < ord")
        plain = (F.substring("name", 1, 1) != "~") & (F.substring("o_name", 1, 1) != "~")
        most = F.least(F.lit(EDITS), (F.least(F.length("name"), F.length("o_name")) / 4).cast("int"))
        fits = near.where(~plain | (F.levenshtein("name", "o_name") <= most)).groupBy("cid", "name", "o_name").agg(F.min("o_ord").alias("o_ord"))
        agree = F.pandas_udf(_names_agree, "boolean")
        earlier = fits.where(agree("name", "o_name")).groupBy("cid").agg(F.min("o_ord").alias("earlier"))
        return known.join(earlier, "cid", "left").select("c", "n", F.least("ord", F.coalesce("earlier", "ord")).alias("first"))

    def _repeated(self, of: DataFrame, first: DataFrame, n: int) -> DataFrame:
        """Orders of rows later than the first of their class; a class's rows are not brought together where the classes can be sent."""
        if n <= MOST_SENT:
            found = of.select("ord", "c").join(F.broadcast(first.select("c", "first")), "c")
        else:
            found = salted_join(of.select("ord", "c"), first.select("c", "first"), "c", hot_keys(first, "c", "n"), F.xxhash64("ord"), "inner")
        return found.where("ord > first").select("ord").distinct()


def repeated_items(history: DataFrame, batches: DataFrame, path: str, order: str = "item_id", batch: str = "batch_no") -> DataFrame:
    """(item_id) of batch rows that report what the history or an earlier row reports already, batch after batch."""
    spark = batches.sparkSession
    index = HistoryIndex(spark, path)
    index.accept(history)
    numbers = [r[0] for r in batches.select(batch).distinct().orderBy(F.col(batch).asc_nulls_last()).collect()]  # one per batch
    out = spark.createDataFrame([], "ord long")
    for n in numbers:
        out = out.unionByName(index.screen(batches.where(F.col(batch).eqNullSafe(F.lit(n).cast(dict(batches.dtypes)[batch]))), order))
    return out.select(F.col("ord").alias(order))
