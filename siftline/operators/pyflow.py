"""Bounded taint over the facts of Python sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.graphs import tainted
from siftline.runtime import materialise, work_dir

#: Parameter names that carry outside input, calls that must not receive it, and calls that clean it.
SOURCES = ("request", "argv", "payload", "body", "params", "query_string", "user_input")
SINKS = ("eval", "exec", "system", "execute", "popen", "loads")
CLEANERS = ("escape", "quote", "sanitize", "int", "float")
#: Kinds of facts that are read.
KINDS = ("flow", "argument", "parameter", "made")


def taint_of(facts: DataFrame, depth: int = 8) -> DataFrame:
    """(source, sink, hops): nodes are ``file:function:variable``; flows are assignments and argument-to-parameter bindings by name and position.

    The facts are computed once.  A name and position that many calls and many functions share is a via, so no pair of them is a row.
    """
    path = work_dir(facts.sparkSession, "taint")
    facts = materialise(facts.where(F.col("kind").isin(*KINDS)).select("kind", "file", "scope", "name", "position", "detail"), f"{path}/facts")
    node = lambda file, scope, name: F.concat_ws(":", file, scope, name)
    col = F.col
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    via = lambda callee: F.concat(callee, F.lit(":"), col("position")).alias("via")
    flows = facts.where("kind = 'flow'").select(node(col("file"), col("scope"), col("detail")).alias("src"), node(col("file"), col("scope"), col("name")).alias("dst"))
    args = facts.where("kind = 'argument'").select(node(col("file"), col("scope"), col("detail")).alias("src"), "file", last(col("name")).alias("callee"), "position")
    params = facts.where("kind = 'parameter' and name not in ('self', 'cls')").select(via(last(col("scope"))), node(col("file"), col("scope"), col("name")).alias("dst"))
    at_sink = args.where(col("callee").isin(*SINKS)).select("src", F.concat_ws(":", F.lit("sink"), col("file"), col("callee")).alias("dst"))
    edges = flows.unionByName(at_sink).distinct()
    given = args.select("src", via(col("callee"))).distinct()
    taken = params.join(given.select("via").distinct(), "via", "left_semi").distinct()
    given = materialise(given.join(params.select("via").distinct(), "via", "left_semi"), f"{path}/given")  # most calls mean none of the functions
    sources = facts.where((col("kind") == "parameter") & col("name").isin(*SOURCES)).select(node(col("file"), col("scope"), col("name")).alias("node"))
    cleaned = facts.where((col("kind") == "made") & last(col("detail")).isin(*CLEANERS)).select(node(col("file"), col("scope"), col("name")).alias("node"))
    return tainted(sources, at_sink.select(col("dst").alias("node")), edges, cleaned, depth, (given, taken))
