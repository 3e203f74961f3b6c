"""Interval type-2 fuzzy decision of a finding, as column expressions inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.schema import BLAST_CODE, lookup
from siftline.schema import severity_score as score_of

#: The terms of every input as corner points and footprint of uncertainty.
TRAPEZOIDS = {
    "severity": {
        "low": (0.0, 0.0, 0.2, 0.35, 0.08), "medium": (0.25, 0.4, 0.55, 0.7, 0.08),
        "high": (0.6, 0.75, 0.85, 0.92, 0.08), "critical": (0.88, 0.95, 1.0, 1.0, 0.05),
    },
    "confidence": {
        "uncertain": (0.0, 0.0, 0.3, 0.5, 0.15), "moderate": (0.35, 0.5, 0.7, 0.85, 0.15), "certain": (0.75, 0.9, 1.0, 1.0, 0.08),
    },
    "exploitability": {
        "none": (0.0, 0.0, 0.15, 0.3, 0.08), "indirect": (0.25, 0.4, 0.6, 0.75, 0.10), "direct": (0.7, 0.85, 1.0, 1.0, 0.08),
    },
    "reliability": {
        "unproven": (0.0, 0.0, 0.3, 0.45, 0.12), "reliable": (0.4, 0.55, 0.75, 0.85, 0.10), "trusted": (0.8, 0.9, 1.0, 1.0, 0.05),
    },
}
TRIANGLES = {"blast": {"function": (0.0, 0.0, 0.3, 0.08), "module": (0.2, 0.5, 0.8, 0.10), "system": (0.7, 1.0, 1.0, 0.08)}}

#: The rule base; blank premises hold always.
INPUTS = ("severity", "confidence", "blast", "exploitability", "reliability")
RULES = (
    ("critical", "", "", "direct", "", "block"),
    ("critical", "", "system", "indirect", "", "block"),
    ("critical", "certain", "", "", "", "block"),
    ("critical", "moderate", "", "", "trusted", "block"),
    ("critical", "moderate", "", "", "reliable", "warn"),
    ("critical", "uncertain", "", "", "", "warn"),
    ("high", "", "system", "direct", "", "block"),
    ("high", "certain", "module", "direct", "", "block"),
    ("high", "moderate", "", "direct", "", "warn"),
    ("high", "", "", "direct", "", "warn"),
    ("high", "certain", "system", "indirect", "", "block"),
    ("high", "", "system", "indirect", "", "warn"),
    ("high", "", "", "indirect", "", "warn"),
    ("high", "", "", "none", "", "warn"),
    ("high", "certain", "", "", "", "warn"),
    ("medium", "certain", "system", "direct", "", "block"),
    ("medium", "", "", "direct", "", "warn"),
    ("medium", "certain", "", "indirect", "", "warn"),
    ("medium", "uncertain", "", "indirect", "", "warn"),
    ("medium", "certain", "", "none", "", "warn"),
    ("medium", "uncertain", "", "none", "", "pass"),
    ("medium", "", "", "", "", "warn"),
    ("low", "certain", "system", "direct", "", "warn"),
    ("low", "", "", "direct", "", "pass"),
    ("low", "", "", "indirect", "", "pass"),
    ("low", "", "", "none", "", "pass"),
    ("low", "", "", "", "", "pass"),
    ("high", "moderate", "", "none", "unproven", "pass"),
    ("medium", "uncertain", "", "", "unproven", "pass"),
    ("", "certain", "system", "direct", "", "block"),
    ("medium", "uncertain", "", "none", "", "warn"),
    ("low", "moderate", "", "none", "", "pass"),
)
CENTROIDS = {"pass": 0.0, "warn": 0.5, "block": 1.0}


def _shape(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Membership in a trapezoid with feet a and d and shoulders b and c."""
    rise = (x - a) / (b - a) if b > a else F.lit(1.0)
    fall = (F.lit(d) - x) / (d - c) if d > c else F.lit(1.0)
    return F.when((x < a) | (x > d), 0.0).when((x >= b) & (x <= c), 1.0).when(x < b, rise).otherwise(fall)


def membership(x: Column, name: str, term: str, closed_shoulders: bool = False) -> tuple[Column, Column]:
    """(lower, upper) membership of a value in a term.

    With ``closed_shoulders`` a term that starts at 0 or ends at 1 keeps its full lower membership there.
    """
    if name in TRIANGLES:
        a, b, d, foot = TRIANGLES[name][term]
        narrow, wide = (b + foot / 2, b + foot / 2), (b - foot / 2, b - foot / 2)
    else:
        a, b, c, d, foot = TRAPEZOIDS[name][term]
        narrow, wide = (b + foot / 2, c - foot / 2), (b - foot / 2, c + foot / 2)
        if closed_shoulders:
            narrow = (b if a == b else narrow[0], c if c == d else narrow[1])
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    lower = clamp(_shape(x, a, *narrow, d))
    return lower, F.greatest(lower, clamp(_shape(x, a, *wide, d)))


def add_decision(df: DataFrame, reliability: Column, severity_score: Column | None = None, closed_shoulders: bool = False) -> DataFrame:
    """Append fis_lower, fis_upper, fis_score and decision to findings.

    The steps are separate projections, so a membership is computed once and used by all its rules.
    """
    kept = df.columns
    inputs = (
        severity_score if severity_score is not None else score_of(F.col("severity")), F.col("confidence"),
        lookup(F.col("blast_radius"), BLAST_CODE, 0.0), F.col("exploitability"), reliability,
    )
    df = df.withColumns({f"__{i}": v for i, v in zip(INPUTS, inputs)})
    terms = {}
    for i, ts in {**TRAPEZOIDS, **TRIANGLES}.items():
        for t in ts:
            terms[f"__{i}_{t}_l"], terms[f"__{i}_{t}_u"] = membership(F.col(f"__{i}"), i, t, closed_shoulders)
    df = df.withColumns(terms)
    fired = {}
    for side in "lu":
        for outcome in CENTROIDS:
            strengths = []
            for *premises, then in RULES:
                if then == outcome:
                    used = [F.col(f"__{i}_{p}_{side}") for i, p in zip(INPUTS, premises) if p]
                    strengths.append(F.least(*used) if len(used) > 1 else used[0])
            fired[f"__{outcome}_{side}"] = F.greatest(*strengths)
    df = df.withColumns(fired)
    weighed = lambda side, by: sum((F.col(f"__{d}_{side}") * (c if by else 1.0) for d, c in CENTROIDS.items()), F.lit(0.0))
    df = df.withColumns({"__nl": weighed("l", True), "__nu": weighed("u", True), "__dl": weighed("l", False), "__du": weighed("u", False)})
    none = F.col("__du") == 0
    df = df.withColumns({
        "__one": F.when(none, 0.5).otherwise(F.try_divide("__nl", "__du")),
        "__two": F.when(none | (F.col("__dl") == 0), 0.5).otherwise(F.try_divide("__nu", "__dl")),
    })
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    df = df.withColumn("fis_lower", clamp(F.least("__one", "__two")))
    df = df.withColumn("fis_upper", F.greatest("fis_lower", F.least(F.lit(1.0), F.greatest("__one", "__two"))))
    df = df.withColumn("fis_score", (F.col("fis_lower") + F.col("fis_upper")) / 2)
    s = F.col("fis_score")
    plain = F.when(s < 0.30, "pass").when(s < 0.70, "warn").otherwise("block")
    unsure = (F.col("fis_upper") - F.col("fis_lower") > 0.5) & (s > 0.35) & (s < 0.65)
    df = df.withColumn("decision", F.when(unsure, "uncertain").otherwise(plain))
    return df.select(*kept, "fis_lower", "fis_upper", "fis_score", "decision")
