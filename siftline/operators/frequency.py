"""Per-key results without imbalance, by value-frequency compression.

Rows are first grouped by (key, value), which a partial aggregation does before any shuffle and
which spreads a hot key over its values; the weighted values then give exact counts, distinct
counts, modes and percentiles.  A percentile never sorts all values of a key in one task: values
are counted in slots, slots are accumulated (a key has few), and only the one slot that holds the
percentile is opened.

Defined results: a null key is a key of its own in profiles and never a heavy key; a null value is
counted in ``n`` but is no distinct value, mode or percentile; of equally frequent values the
smallest is the mode; the percentile p of n weighted values is the smallest value whose cumulated
weight reaches p * n; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.runtime import materialise


def frequencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, v, w): the number of rows of every (key, value)."""
    return df.groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("w"))


def mode_of(freq: DataFrame, mode: str) -> DataFrame:
    """(k, mode): the heaviest value per key, the smallest of equals; one partial aggregation."""
    order = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("w")).alias("w"), F.col("v").alias("v"))))
    return freq.groupBy("k").agg(order.alias("__m")).select("k", F.col("__m.v").alias(mode))


def weighted_percentiles(freq: DataFrame, shares: dict[str, float], width: int = 256) -> DataFrame:
    """Exact percentiles per key from (k, v, w) with whole-number values; ``width`` values make a slot."""
    f = freq.where("v is not null").withColumn("slot", F.floor(F.col("v") / width))
    slots = f.groupBy("k", "slot").agg(F.sum("w").alias("sw"))
    by = W.partitionBy("k")
    run = slots.withColumn("upto", F.sum("sw").over(by.orderBy("slot"))).withColumn("n", F.sum("sw").over(by))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in shares.items()])
    goal = run.withColumn("want", F.explode(wanted)).withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("want.p") * F.col("n"))))
    inside = goal.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("sw") < F.col("need"))).select(
        F.col("k").alias("gk"), F.col("slot").alias("gslot"), F.col("want.name").alias("name"),
        (F.col("need") - F.col("upto") + F.col("sw")).alias("left_over"),
    )
    opened = f.join(inside, f["k"].eqNullSafe(inside["gk"]) & (f["slot"] == inside["gslot"]))
    upto = F.sum("w").over(W.partitionBy("k", "name").orderBy("v"))
    at = opened.withColumn("upto", upto).where(F.col("upto") >= F.col("left_over"))
    return at.groupBy("k").pivot("name", list(shares)).agg(F.min("v"))


def heavy_values(df: DataFrame, fields: list[str], share: float) -> DataFrame:
    """(field_name, key_value, n): values that hold more than ``share`` of all rows, one scan for all fields."""
    freq = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("w"))
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_value")) for f in fields]))
    values = freq.select(one.alias("x"), "w").select("x.*", "w").groupBy("field_name", "key_value").agg(F.sum("w").alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return (
        values.where("key_value is not null").join(F.broadcast(total), F.col("n") > F.col("total") * F.lit(share))
        .select("field_name", "key_value", "n")
    )


#: The value columns of a profile and their normal forms.
VALUES = {"fingerprint": lambda: F.col("fingerprint"), "severity": lambda: F.lower(F.btrim("severity")), "line": lambda: F.col("line").cast("string")}


def value_frequencies(df: DataFrame, fields: list[str], path: str) -> DataFrame:
    """(field_name, k, value_name, v, w, first_seen, last_seen): every value column's frequencies under every field, in one scan and one exchange.

    The table is written, as all results of a profile read it.
    """
    one = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("k"), F.lit(n).alias("value_name"), v().alias("v")) for f in fields for n, v in VALUES.items()
    ]))
    rows = df.select(one.alias("x"), "first_seen", "last_seen").select("x.*", "first_seen", "last_seen")
    return materialise(
        rows.groupBy("field_name", "k", "value_name", "v").agg(
            F.count(F.lit(1)).alias("w"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
        ), path,
    )


def profile(df: DataFrame, fields: list[str], path: str) -> DataFrame:
    """Counts, first and last sight, distinct records, most frequent severity and line percentiles per value of each field."""
    freq = value_frequencies(df, fields, path).withColumn("k", F.struct("field_name", "k"))
    of = lambda n: freq.where(F.col("value_name") == n)
    base = of("line").groupBy("k").agg(F.sum("w").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    keys = of("fingerprint").groupBy("k").agg(F.count("v").alias("records"))
    mode = mode_of(of("severity"), "severity")
    cuts = weighted_percentiles(of("line").withColumn("v", F.col("v").cast("int")).select("k", "v", "w"), {"line_p50": 0.5, "line_p90": 0.9})
    out = base
    for part in (keys, mode, cuts):
        p = part.withColumnRenamed("k", "__k")
        out = out.join(p, out["k"].eqNullSafe(p["__k"]), "left").drop("__k")
    return out.select(
        F.col("k.field_name").alias("field_name"), F.col("k.k").alias("key_value"), "n", "records", "severity", "line_p50", "line_p90", "first_seen", "last_seen"
    )
