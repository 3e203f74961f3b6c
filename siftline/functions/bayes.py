"""Bayesian second opinion on a fuzzy decision, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity given the blended score, by descending threshold; decision given severity and trust.
SEVERITY_GIVEN = ((0.7, (0.8, 0.18, 0.02)), (0.45, (0.3, 0.6, 0.1)), (0.25, (0.05, 0.5, 0.45)), (None, (0.0, 0.2, 0.8)))
DECISION_GIVEN = {
    ("high", "yes"): (0.85, 0.13, 0.02), ("high", "no"): (0.55, 0.30, 0.15), ("medium", "yes"): (0.30, 0.55, 0.15),
    ("medium", "no"): (0.10, 0.50, 0.40), ("low", "yes"): (0.05, 0.25, 0.70), ("low", "no"): (0.02, 0.15, 0.83),
}
GOOD, BAD = ("confidence", "exploitability", "reliability", "corroboration"), ("fp_history", "test_exclusion")


def add_posterior(df: DataFrame, evidence: dict[str, Column], score: Column) -> DataFrame:
    """Append p_block, p_warn, p_pass and bbn_decision, from evidence values in [0, 1] by name."""
    e = {k: evidence.get(k, F.lit(0.0)) for k in (*GOOD, *BAD)}
    blend = 0.6 * score + 0.4 * e["exploitability"]
    levels = []
    for i in range(3):
        out = F.lit(SEVERITY_GIVEN[-1][1][i])
        for least, p in reversed(SEVERITY_GIVEN[:-1]):
            out = F.when(blend >= least, p[i]).otherwise(out)
        levels.append(out)
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * e["reliability"] + 0.3 * e["corroboration"] - 0.4 * e["fp_history"] + 0.2))
    sums = []
    for d in range(3):
        total = F.lit(0.0)
        for level, p in zip(("high", "medium", "low"), levels):
            total = total + p * (trust * DECISION_GIVEN[level, "yes"][d] + (1 - trust) * DECISION_GIVEN[level, "no"][d])
        sums.append(total)
    for_block, for_pass = F.lit(1.0), F.lit(1.0)
    for k in GOOD:
        m = 0.5 + e[k]
        for_block, for_pass = for_block * m, for_pass * (2.0 - m)
    for k in BAD:
        m = 1.0 - 0.9 * e[k]
        for_block, for_pass = for_block * m, for_pass * (2.0 - m)
    for_block = for_block * F.when(e["test_exclusion"] > 0.5, 1.0 - e["test_exclusion"]).otherwise(1.0)
    df = df.withColumns({"__b": sums[0] * for_block, "__w": sums[1], "__p": sums[2] * for_pass})
    every = F.col("__b") + F.col("__w") + F.col("__p")
    part = lambda c: F.coalesce(F.try_divide(F.col(c), every), F.lit(1.0 / 3.0))
    df = df.withColumns({"p_block": part("__b"), "p_warn": part("__w"), "p_pass": part("__p")}).drop("__b", "__w", "__p")
    best = F.greatest("p_block", "p_warn", "p_pass")
    return df.withColumn("bbn_decision", F.when(F.col("p_block") == best, "block").when(F.col("p_warn") == best, "warn").otherwise("pass"))


def vote(fis: Column, bbn: Column, verified: Column) -> Column:
    """Joint decision: agreement wins, else the counterfactual check decides; a refuted block is only a warning."""
    split = F.when(verified, fis).when(~verified, F.lit("pass")).otherwise(F.lit("warn"))
    joint = F.when(fis == bbn, fis).otherwise(split)
    return F.when(~F.coalesce(verified, F.lit(True)) & (joint == "block"), F.lit("warn")).otherwise(joint)
