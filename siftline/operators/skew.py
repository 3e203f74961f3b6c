"""Salting of heavy keys with a provably short list of them.

A key is heavy with more than ``floor`` rows and more than one SHARE-th of all rows.  There are fewer than SHARE such
keys whatever the data, so broadcasting them is safe, and a key outside the list is less than a task's fair part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
SHARE = 4096


def hot_keys(counts: DataFrame, key: str, n: str, floor: int = 50_000) -> DataFrame:
    """The fewer than SHARE keys with more than ``floor`` rows and more than total / SHARE, from (key, n)."""
    total = counts.agg(F.sum(n).alias("__total"))
    over = counts.where((F.col(n) > floor) & F.col(key).isNotNull()).join(F.broadcast(total), F.col(n) > F.col("__total") / SHARE)
    return over.select(F.col(key).alias("__hot"))


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "left", keep_salt: bool = False) -> DataFrame:
    """Join ``big`` with ``small`` (unique in ``key``), spreading the rows of hot keys over SALTS tasks.

    ``small`` repeats only its hot rows, so it grows by fewer than SHARE * SALTS rows.
    """
    b = big.join(F.broadcast(hot), big[key] == hot["__hot"], "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull(), F.pmod(spread, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    ).drop("__hot")
    s = small.join(F.broadcast(hot), small[key] == hot["__hot"], "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("__hot")
    joined = b.join(s, [key, "__salt"], how)
    return joined if keep_salt else joined.drop("__salt")
