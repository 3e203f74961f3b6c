"""Similarity, duplication, dependencies and risk scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators.blocks import near, with_borders

QUERY_BLOCK, ROW_BLOCK = 512, 4096


#: Rows on which cells are fitted at most, and rows of a cell that are compared in one block.
SAMPLE, CELL_BLOCK = 20_000, 4096


class CellIndex:
    """Vectors in cells around centres: every row lies in the cell of its nearest centre, and a query looks into the ``probes`` cells nearest to it.

    The centres are fitted on at most SAMPLE rows chosen by a hash of the key; every row is indexed.  A cell is compared in blocks, so one with
    most rows is many tasks.  Recall against ``nearest`` is tested to be at least 0.9.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str, cells: int, rounds: int = 12):
        self.rows, self.key, self.vector = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null"), key, vector
        some = self.rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        data = self._unit(np.array([r["v"] for r in some], dtype=float)) if some else np.zeros((0, 1))
        self.centres = data[np.linspace(0, len(data) - 1, min(cells, len(data))).astype(int)] if len(data) else data
        for _ in range(rounds if len(data) else 0):
            at = (data @ self.centres.T).argmax(axis=1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, at, data)
            full = np.bincount(at, minlength=len(self.centres)) > 0
            self.centres[full] = self._unit(sums[full])

    @staticmethod
    def _unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)

    def _placed(self, rows: DataFrame, n: int) -> DataFrame:
        """Rows with each of their ``n`` nearest cells."""
        centres, unit = self.centres, self._unit

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.argsort(-(unit(np.stack(b["v"].to_numpy())) @ centres.T), axis=1, kind="stable")[:, :n]
                    k = near.shape[1]
                    yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), k), "v": [v for v in b["v"] for _ in range(k)], "cell": near.ravel()})

        return rows.mapInPandas(run, "id long, v array<double>, cell int")

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, neighbour, cosine, rank) for queries of the indexed key and vector."""
        asked = queries.select(F.col(self.key).alias("id"), F.col(self.vector).cast("array<double>").alias("v")).where("v is not null")
        if not len(self.centres):
            return asked.select(F.col("id").alias("query"), F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).where("false")

        def blocks(df: DataFrame, size: int, p: str) -> DataFrame:
            b = df.withColumn("b", F.floor(F.monotonically_increasing_id() / size)).groupBy("cell", "b").agg(F.collect_list(F.struct("id", "v")).alias("items"))
            return b.select("cell", F.col("items.id").alias(f"{p}ids"), F.flatten("items.v").alias(f"{p}flat"))

        pairs = blocks(self._placed(asked, probes), QUERY_BLOCK, "q").join(blocks(self._placed(self.rows, 1), CELL_BLOCK, "r"), "cell").drop("cell")
        return _best(pairs, k)


#: Words that stay themselves when names are made equal.
KEYWORDS = tuple(
    "if else elif for while def class return import from try except finally with as in not and or is None True False lambda yield raise pass break continue global nonlocal del".split()
)
_TOKEN = re.compile(r"\w+|[^\s\w]")
_PRIME = 1_099_511_628_211


def _windows(n: int):
    import xxhash

    fixed = {k: xxhash.xxh3_64_intdigest(k) for k in KEYWORDS}

    def token(t: str) -> int:
        if t in fixed:
            return fixed[t]
        return xxhash.xxh3_64_intdigest("ID" if t.isidentifier() and t.isascii() else t)

    top = pow(_PRIME, n, 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, at = [], []
                for number, line in enumerate((text or "").splitlines(), 1):
                    found = [token(t) for t in _TOKEN.findall(line)]
                    ids += found
                    at += [number] * len(found)
                if len(ids) < n:
                    continue
                # a polynomial over the tokens before each place; a window is the difference of two
                with np.errstate(over="ignore"):
                    h = np.empty(len(ids) + 1, dtype=np.uint64)
                    h[0] = acc = 0
                    for i, x in enumerate(ids):
                        acc = (acc * _PRIME + x) & 0xFFFFFFFFFFFFFFFF
                        h[i + 1] = acc
                    w = (h[n:] - h[: len(ids) - n + 1] * np.uint64(top)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(w)), pa.array(np.array(at[: len(w)], dtype=np.int32)), pa.array(w)], names=["file", "line", "hash"])

    return run


def duplicate_windows(files: DataFrame, n: int = 50, top: int = 20) -> DataFrame:
    """(hash, places, files, first_file, first_line): the ``top`` most repeated windows of n tokens of (file, content), names made equal.

    A window counts where it stands in two files, or twice in one at least n lines apart.  Every window is a class with its number of places;
    places are counted in a partial aggregation and not paired with each other.
    """
    w = files.select("file", "content").mapInArrow(_windows(n), "file string, line int, hash long")
    per_file = w.groupBy("hash", "file").agg(F.count(F.lit(1)).alias("c"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    g = per_file.groupBy("hash").agg(F.sum("c").alias("places"), F.count(F.lit(1)).alias("files"), F.min(F.struct("file", "lo")).alias("f"), F.max(F.col("hi") - F.col("lo")).alias("apart"))
    return g.where((F.col("files") >= 2) | (F.col("apart") >= n)).orderBy(F.col("places").desc(), "f.file", "f.lo", "hash").limit(top).select(
        "hash", "places", "files", F.col("f.file").alias("first_file"), F.col("f.lo").alias("first_line")
    )


def repeated_lines(lines: DataFrame, n: int = 3, top: int = 20) -> DataFrame:
    """The most repeated windows of n neighbouring non-blank lines: hash, places, files and the first place."""
    t = with_borders(lines.where(F.btrim("text") != "").select("file", "line_no", F.btrim("text").alias("text")), 0, n - 1)
    parts = [F.col("text"), *[F.when(F.lead("line_no", i).over(near()) == F.col("line_no") + i, F.lead("text", i).over(near())) for i in range(1, n)]]
    t = t.withColumns({f"__{i}": p for i, p in enumerate(parts)}).where("not __copy")
    for i in range(1, n):
        t = t.where(F.col(f"__{i}").isNotNull())
    t = t.select("file", "line_no", F.substring(F.sha2(F.concat_ws("\n", *[f"__{i}" for i in range(n)]), 256), 1, 16).alias("hash"))
    g = t.groupBy("hash").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("file").alias("files"), F.min(F.struct("file", "line_no")).alias("f"))
    return g.where("places >= 2").orderBy(F.col("places").desc(), "hash").limit(top).select("hash", "places", "files", F.col("f.file").alias("first_file"), F.col("f.line_no").alias("first_line"))


def nearest(rows: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """(query, neighbour, cosine): the k most similar other rows of every query row, against all rows, exactly.

    Queries and rows are packed into blocks; a pair of blocks is one matrix product, from which only the k best
    per query go on to the final choice.
    """
    def blocks(df: DataFrame, size: int, p: str) -> DataFrame:
        b = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v is not null")
        b = b.withColumn("b", F.floor(F.monotonically_increasing_id() / size)).groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("items"))
        return b.select(F.col("b").alias(f"{p}b"), F.col("items.id").alias(f"{p}ids"), F.flatten("items.v").cast("array<double>").alias(f"{p}flat"))

    pairs = blocks(rows.where(is_query), QUERY_BLOCK, "q").crossJoin(blocks(rows, ROW_BLOCK, "r"))  # of blocks, not of rows
    return _best(pairs, k)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, cosine, rank) from pairs of blocks (qids, qflat, rids, rflat): a pair is one matrix product, from which only the k best per query go on."""
    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qids, qflat, rids, rflat in zip(batch["qids"], batch["qflat"], batch["rids"], batch["rflat"]):
                q, r = (np.asarray(f).reshape(len(i), -1) for f, i in ((qflat, qids), (rflat, rids)))
                norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
                c = norm(q) @ norm(r).T
                c[np.asarray(qids)[:, None] == np.asarray(rids)[None, :]] = -np.inf
                m = min(k, c.shape[1])
                best = np.argpartition(-c, m - 1, axis=1)[:, :m]
                # where more are equal at the last place than fit, the smallest ids are taken
                least = np.take_along_axis(c, best, axis=1).min(axis=1, keepdims=True)
                for i in np.flatnonzero((c >= least).sum(axis=1) > m):
                    some = np.flatnonzero(c[i] >= least[i])
                    best[i] = some[np.lexsort((np.asarray(rids)[some], -c[i, some]))[:m]]
                out = pd.DataFrame({
                    "query": np.repeat(np.asarray(qids), m), "neighbour": np.asarray(rids)[best].ravel(), "cosine": np.take_along_axis(c, best, axis=1).ravel(),
                })
                yield out[np.isfinite(out["cosine"])]

    found = pairs.select("qids", "qflat", "rids", "rflat").mapInPandas(product, "query long, neighbour long, cosine double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of a text."""
    low = F.lower(text)
    n = F.greatest(F.length(low) - 2, F.lit(0))
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_similar(names: DataFrame, name: str, least: float) -> DataFrame:
    """(a, b, cosine): pairs of distinct names whose trigram sets have at least a cosine; joined by their rare trigrams first.

    Prefix filter: with the grams of a name in global order of rarity, two names that reach the threshold share one
    of the first n - ceil(least^2 n) + 1 grams of each, so frequent grams never join.
    """
    d = names.select(F.col(name).alias("s")).where("s is not null").distinct()
    grams = d.select("s", F.explode(trigrams(F.col("s"))).alias("g"))
    freq = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    sets = grams.join(freq, "g").groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"]).alias("gs"))
    n = F.size("gs")
    pre = sets.select("s", "gs", F.explode(F.slice("gs", 1, (n - F.ceil(n * least * least) + 1).cast("int"))).alias("g"))
    a = pre.select(F.col("s").alias("a"), F.col("gs").alias("ga"), "g")
    b = pre.select(F.col("s").alias("b"), F.col("gs").alias("gb"), "g")
    pairs = a.join(b, "g").where("a < b").select("a", "b", "ga", "gb").distinct()
    cos = F.size(F.array_intersect("ga", "gb")) / F.sqrt(F.size("ga") * F.size("gb"))
    return pairs.select("a", "b", cos.alias("cosine")).where(F.col("cosine") >= least)


def version_array(c: Column) -> Column:
    """Numbers of a version, comparable from left to right."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def in_range(version: Column, spec: Column) -> Column:
    """Whether a version is in a range written as ``<v``, ``<=v``, ``a-b`` or exactly ``v``."""
    v = version_array(version)
    bound = version_array(F.regexp_replace(spec, r"^<=?", ""))
    return (
        F.when(spec.startswith("<="), v <= bound).when(spec.startswith("<"), v < bound)
        .when(spec.contains("-"), (v >= version_array(F.split(spec, "-")[0])) & (v <= version_array(F.split(spec, "-")[1])))
        .otherwise(v == bound)
    )


def vulnerable(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies in the affected range of an advisory of the same ecosystem and package."""
    j = dependencies.join(advisories.withColumnRenamed("package", "name"), ["ecosystem", "name"])
    return j.where(in_range(F.col("version"), F.col("affected_versions")))


def lookalikes(names: DataFrame, name: str, popular: DataFrame) -> DataFrame:
    """(name, popular, distance): names one edit from a popular one, or two with equal length of at least six; the nearest, then first popular one.

    ``popular`` is a ranked list of bounded length.
    """
    d = names.select(F.col(name).alias("name")).where("length(name) >= 4").distinct().join(F.broadcast(popular.select(F.col("name").alias("known"))), F.col("name") == F.col("known"), "left_anti")
    p = popular.select(F.col("name").alias("popular"))
    dist = F.levenshtein("name", "popular", 2)
    near = (dist == 1) | ((dist == 2) & (F.length("name") == F.length("popular")) & (F.length("name") >= 6))
    j = d.join(F.broadcast(p), (F.abs(F.length("name") - F.length("popular")) <= 1) & near).withColumn("distance", dist)
    return j.groupBy("name").agg(F.min(F.struct("distance", "popular")).alias("m")).select("name", "m.popular", "m.distance")


#: Weights of a function's features, and the words two of them count.
RISK_WEIGHTS = {"calls": 0.10, "branches": 0.05, "loops": 0.08, "sensitive": 0.30, "unsafe": 0.45, "arguments": 0.02, "handles": -0.10, "length": 0.005}
SENSITIVE_TOKENS = (
    r"(?i)\b(?:password|secret|token|key|admin|root|exec|eval|sql|query|delete|update|insert|drop|system|cmd|shell|os\.|subprocess|pickle|yaml\.load|innerHTML|document\.write|dangerouslySetInnerHTML)\b"
)
UNSAFE_LIBRARIES = r"\b(?:md5|sha1|DES|ECB|PKCS1_v1_5|random\.|Math\.random|strcpy|gets|sprintf)\b"


def risk_features(body: Column, arguments: Column) -> dict[str, Column]:
    """The eight features of a function's body and argument list."""
    n = lambda p: F.regexp_count(body, F.lit(p)).cast("double")
    args = F.filter(F.split(arguments, ","), lambda a: F.btrim(a) != "")
    return {
        "calls": n(r"\w+\s*\("), "branches": n(r"\bif\b|\belif\b|\belse\b"), "loops": n(r"\bfor\b|\bwhile\b"), "sensitive": n(SENSITIVE_TOKENS), "unsafe": n(UNSAFE_LIBRARIES),
        "arguments": F.size(args).cast("double"), "handles": F.when(body.rlike(r"\btry\b|\bcatch\b|\bexcept\b"), 1.0).otherwise(0.0), "length": n(r"\n"),
    }


def risk(body: Column, arguments: Column | None = None) -> Column:
    """Logistic risk score of a function's body, between 0 and 1."""
    f = risk_features(body, F.lit("") if arguments is None else arguments)
    z = F.lit(0.0)
    for name, w in RISK_WEIGHTS.items():
        z = z + w * f[name]
    return 1 / (1 + F.exp(-z))


def trigram_counts(text: Column) -> Column:
    """Map of the character trigrams of a lower-case text to their number; shorter texts have none."""
    low = F.lower(text)
    n = F.greatest(F.length(low) - 2, F.lit(0))
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.map_from_entries(F.transform(F.array_distinct(grams), lambda g: F.struct(g, F.size(F.filter(grams, lambda x: x == g)))))


def frequency_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps of trigram frequencies, 0 where one is empty."""
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v * v))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def informativeness(confidence: Column, novelty: Column, diversity: Column) -> Column:
    """What a label would teach: half uncertainty, three tenths novelty, two tenths diversity."""
    return 0.5 * (1 - F.abs(2 * confidence - 1)) + 0.3 * novelty + 0.2 * diversity
