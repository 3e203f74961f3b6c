"""Reachability, call graphs, bounded taint and dead code over node and edge tables.

Loops expand a frontier by an equi-join with the edges and drop what was visited by an anti-join; every
round is written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.runtime import materialise, work_dir


def reach(starts: DataFrame, edges: DataFrame, depth: int, through: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(start, node, hops): nodes within ``depth`` steps of every start, with their least number of steps.

    ``through`` holds tables (src, via) and (via, dst): a step also leads from src to every dst of its via.  A start follows a via once, and
    the product of both tables is never made.
    """
    spark = edges.sparkSession
    path = work_dir(spark, "reach")
    e = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst")).distinct()
    seen = materialise(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("hops", F.lit(0)), f"{path}/0")
    frontier, passed = seen, None
    for d in range(1, depth + 1):
        step = frontier.join(e, F.col("node") == F.col("__src")).select("start", F.col("__dst").alias("node"))
        if through:
            via = frontier.join(through[0].select(F.col("src").alias("__src"), "via"), F.col("node") == F.col("__src")).select("start", "via").distinct()
            via = materialise(via.join(passed, ["start", "via"], "left_anti") if passed is not None else via, f"{path}/via{d}")
            passed = passed.unionByName(via) if passed is not None else via
            step = step.unionByName(via.join(through[1].select("via", "dst"), "via").select("start", F.col("dst").alias("node")))
        new = step.distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(d))
        frontier = materialise(new, f"{path}/{d}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def blast_radius(changed: DataFrame, calls: DataFrame, depth: int = 3) -> DataFrame:
    """(start, affected, risk): callers within ``depth`` steps against the calls; over 10 is high, over 3 medium."""
    r = reach(changed, calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth).where("hops > 0")
    n = r.groupBy("start").agg(F.count(F.lit(1)).alias("affected"))
    return n.withColumn("risk", F.when(F.col("affected") > 10, "high").when(F.col("affected") > 3, "medium").otherwise("low"))


def bind_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls with the function they mean: of equal names one in the same file before others, then the first by file and line.

    A call meets one row per name and one per name and file, however many files define the name.
    """
    own = functions.groupBy(F.col("name").alias("callee"), "file").agg(F.min(F.struct(F.col("file").alias("callee_file"), F.col("line").alias("callee_line"))).alias("own"))
    first = own.groupBy("callee").agg(F.min("own").alias("first"))
    j = calls.select("file", "caller", "callee", "line").distinct().join(first, "callee").join(own, ["callee", "file"], "left")
    return j.withColumn("b", F.coalesce("own", "first")).select("file", "caller", "callee", "line", "b.callee_file", "b.callee_line")


def tainted(sources: DataFrame, sinks: DataFrame, flows: DataFrame, sanitised: DataFrame, depth: int = 8, through: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(source, sink, hops): sinks within ``depth`` flow steps of a source, not through sanitised nodes; ``through`` as for ``reach``."""
    clean = lambda t: t.join(sanitised.select(F.col("node").alias("dst")), "dst", "left_anti")
    edges = clean(flows)
    if through:  # every round reads them, so they are cleaned once
        path = work_dir(flows.sparkSession, "tainted")
        edges, through = materialise(edges, f"{path}/edges"), (through[0], materialise(clean(through[1]), f"{path}/out"))
    r = reach(sources, edges, depth, through)
    return r.join(sinks.select("node").distinct(), "node").where("hops > 0").select(F.col("start").alias("source"), F.col("node").alias("sink"), "hops")


def unreferenced(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that nothing calls."""
    return functions.join(calls.select(F.col("callee").alias("name")).distinct(), "name", "left_anti")


def layer_violations(imports: DataFrame, layers: dict[str, int]) -> DataFrame:
    """Imports from a lower into a higher layer, by the top folder of both paths."""
    from siftline.schema import lookup

    top = lambda c: lookup(F.element_at(F.split(c, "/"), 1), layers)
    return imports.withColumns({"a": top(F.col("file")), "b": top(F.col("target"))}).where("a < b")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
