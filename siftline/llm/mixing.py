"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every distinct text of a source gets an exponential key, -ln(u) / quality, with u hashed from the
text, so the order is the same on any cluster.  A source whose budget is e times its size and a
rest gets e complete epochs; the rest is filled in key order until the tokens are used up.

The prefix sum over a source is taken in two steps, so that a source with most of the corpus is no
single task: tokens are summed in slots of the keys' logarithm, FINE to each factor of e, the slot where the budget ends is
found from the slot sums, and only the documents of that slot are put in order.  Exponential keys put at most 1 / (e * FINE) of a
source's documents into a slot, whatever their quality weights.

The total: the largest for which every source with documents can reach its target share within its
``max_repeats``.  A target without documents cannot contribute; its share is spread over the others
in proportion and reported as not reached.

Defined results: null and empty texts have no tokens and are not used; equal texts of one source are
one text, represented by its smallest doc_id, so no text is used more than ``max_repeats`` times;
documents of sources without target are not used; a null or negative ``max_repeats`` or share counts
as 0; of repeated target rows the largest share and repeats count; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.encoding import token_counts
from siftline.runtime import materialise

FINE = 2048
SEED = 20


def quality(text):
    """Quality weight in [0.05, 1.05]: letters and blanks among the characters, words of a usual length, distinct words, distinct lines.

    The least of the four decides, so that a text of one repeated line, of figures, or of one endless word has little weight.
    """
    length = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]+", "")) / length
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    mean = length / n
    usual = F.least(F.lit(1.0), mean / 4, 16 / mean)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")
    distinct = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    # the number of distinct words grows slower than a text; a fourth root of the share is near 1 for plain prose of any length
    rich = F.sqrt(F.sqrt(F.size(F.array_distinct(words)) / n))
    return F.lit(0.05) + F.coalesce(F.least(letters, usual, distinct, rich), F.lit(0.0))


def units(docs: DataFrame, targets: DataFrame, work: str, vocabulary: str | None = None) -> DataFrame:
    """(source, doc_id, tokens, key): one row per distinct text of a source with a target."""
    known = targets.where("source is not null").select("source").distinct()
    some = docs.where("text is not null and text <> ''").select("doc_id", "source", "text").join(F.broadcast(known), "source", "left_semi")
    some = some.withColumn("quality", quality(F.col("text")))
    counted = token_counts(some, vocabulary=vocabulary, keep=["doc_id", "source", "quality"])
    one = counted.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.max("quality").alias("quality"))
    u = (F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(2**53)).cast("double") + 0.5) / float(2**53)
    return materialise(
        one.where("tokens > 0").select("source", "doc_id", "tokens", (-F.log(u) / F.col("quality")).alias("key")), f"{work}/units"
    )


def budgets(of_units: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: size, budget, complete epochs and the tokens left for the fraction."""
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.greatest(F.max(F.coalesce("target_share", F.lit(0.0))), F.lit(0.0)).alias("target_share"),
        F.greatest(F.max(F.coalesce("max_repeats", F.lit(0))), F.lit(0)).cast("long").alias("max_repeats"),
    )
    sizes = of_units.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("texts"))
    t = wanted.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    usable = (F.col("size") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    every = W.partitionBy()  # one row per target
    t = t.withColumn("share", F.when(usable, F.try_divide(F.col("target_share"), F.sum(F.when(usable, F.col("target_share"))).over(every))).otherwise(0.0))
    t = t.withColumn("total", F.min(F.when(usable, F.try_divide(F.col("size") * F.col("max_repeats"), F.col("share")))).over(every))
    t = t.withColumn("budget", F.least(F.floor(F.col("total") * F.col("share") + 1e-6), F.col("size") * F.col("max_repeats")))
    t = t.withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.try_divide(F.col("budget"), F.col("size")))).otherwise(0))
    return t.withColumn("left_over", F.coalesce(F.col("budget") - F.col("epochs") * F.col("size"), F.lit(0)))


def mixture(of_units: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, doc_id, tokens, copies): the chosen texts and how often each is used."""
    plan = budgets(of_units, targets).select("source", "epochs", "left_over")
    slotted = of_units.withColumn("slot", F.floor(F.log(F.greatest(F.col("key"), F.lit(1e-300))) * FINE).cast("int"))
    sums = slotted.groupBy("source", "slot").agg(F.sum("tokens").alias("st"))
    run = F.sum("st").over(W.partitionBy("source").orderBy("slot"))  # a source has about 60 * FINE slots, whatever its size
    edges = (
        sums.withColumn("before", run - F.col("st")).join(F.broadcast(plan), "source").where("before + st > left_over")
        .groupBy("source").agg(F.min(F.struct("slot", "before")).alias("edge"))
    )
    # one row per target
    placed = slotted.join(F.broadcast(plan), "source").join(F.broadcast(edges), "source", "left")
    inside = F.col("edge").isNull() | (F.col("slot") < F.col("edge.slot"))
    plain = placed.where(inside | (F.col("slot") > F.col("edge.slot"))).select("source", "doc_id", "tokens", (F.col("epochs") + inside.cast("int")).alias("copies"))
    edge = placed.where(F.col("slot") == F.col("edge.slot"))
    upto = F.col("edge.before") + F.sum("tokens").over(W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    part = edge.withColumn("upto", upto).select("source", "doc_id", "tokens", (F.col("epochs") + (F.col("upto") <= F.col("left_over")).cast("int")).alias("copies"))
    return plain.unionByName(part).where("copies > 0").withColumn("copies", F.col("copies").cast("int"))


def shares(mix: DataFrame, of_units: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: wanted and reached share of all tokens, tokens used, texts used and the most copies of one."""
    used = mix.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("used_texts"), F.max("copies").alias("most_copies")
    )
    t = budgets(of_units, targets).select("source", "target_share", "max_repeats", F.col("size").alias("available_tokens"))
    t = t.join(used, "source", "left").fillna(0, ["used_tokens", "used_texts", "most_copies"])
    every = W.partitionBy()  # one row per target
    return t.withColumn("reached_share", F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(every)), F.lit(0.0)))
