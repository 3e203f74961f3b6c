"""Windows over the lines of files that do not bring a whole file into one task.

A file's lines are cut into blocks of BLOCK line numbers.  What looks a bounded number of lines ahead or behind gets its neighbours'
border lines as copies; what runs from the beginning of the file carries the last value of each block into the next ones, over one row
per block.  So a file that holds most of all lines is spread over its blocks.

Defined results: lines are ordered by ``line_no``; a null file is a file of its own; a null line number belongs to no block and has neither
neighbours nor a carried value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096


def block_of(line: Column) -> Column:
    return F.floor(line / BLOCK)


def with_borders(lines: DataFrame, behind: int, ahead: int, by: str = "file", at: str = "line_no") -> DataFrame:
    """Lines with ``__block``, and copies (``__copy``) of those up to ``behind`` lines before and ``ahead`` lines after each block; both at most BLOCK."""
    line = F.col(at)
    own = block_of(line)
    blocks = F.array_distinct(F.array(block_of(line - ahead), own, block_of(line + behind)))
    return lines.withColumn("__block", F.explode_outer(blocks)).withColumn("__copy", F.col("__block") != own)


def near(by: str = "file", at: str = "line_no"):
    """Window over the lines of a block, in order."""
    return W.partitionBy(by, "__block").orderBy(at)


def carried_last(lines: DataFrame, value: Column, name: str, by: str = "file", at: str = "line_no") -> DataFrame:
    """Every line with the last non-null value at or before it."""
    kept = lines.withColumns({"__block": block_of(F.col(at)), "__value": value})
    ends = kept.where("__value is not null").groupBy(by, "__block").agg(F.max_by("__value", at).alias("__end"))
    return _carry(lines, kept, ends, name, by, at)


def _carry(lines: DataFrame, kept: DataFrame, ends: DataFrame, name: str, by: str, at: str) -> DataFrame:
    spans = kept.select(by, "__block").distinct()
    marks = spans.select(by, "__block", F.lit(None).cast(dict(ends.dtypes)["__end"]).alias("__end")).unionByName(ends)
    one = marks.groupBy(by, "__block").agg(F.max("__end").alias("__end"))  # one row per block
    before = F.last("__end", ignorenulls=True).over(W.partitionBy(by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    carry = one.select(F.col(by).alias("__by"), F.col("__block").alias("__at"), before.alias("__before"))
    joined = kept.join(carry, kept[by].eqNullSafe(carry["__by"]) & (kept["__block"] == carry["__at"]), "left")
    inside = F.last("__value", ignorenulls=True).over(W.partitionBy(by, "__block").orderBy(at))
    return joined.withColumn(name, F.coalesce(inside, "__before")).select(*lines.columns, name)


def running_sum(lines: DataFrame, value: Column, name: str, by: str = "file", at: str = "line_no") -> DataFrame:
    """Every line with the sum of a value over all lines at or before it."""
    kept = lines.withColumns({"__block": block_of(F.col(at)), "__value": value})
    ends = kept.groupBy(by, "__block").agg(F.sum("__value").alias("__end"))
    before = F.sum("__end").over(W.partitionBy(by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    carry = ends.select(F.col(by).alias("__by"), F.col("__block").alias("__at"), before.alias("__before"))
    joined = kept.join(carry, kept[by].eqNullSafe(carry["__by"]) & kept["__block"].eqNullSafe(carry["__at"]), "left")
    inside = F.sum("__value").over(W.partitionBy(by, "__block").orderBy(at).rangeBetween(W.unboundedPreceding, 0))
    return joined.withColumn(name, F.coalesce("__before", F.lit(0)) + F.coalesce(inside, F.lit(0))).select(*lines.columns, name)
