"""The three entry flows as lazily planned frames: whole scan, scan of changed lines, review of a merge.

``full_scan``: rules over lines, first deduplication, further findings, inline suppression, known bug patterns, detector names, corroboration, learnt false
positives, calibration, re-check of what line rules found, second deduplication, strictness, rule multipliers, decision, baseline, known false
positives, advisories.  A diff scan is the same over changed lines, deduplicated by fingerprint.  Every table of state is optional; nothing is collected.

Defined results: the decision is a column of its finding; findings without a file or line are decided like others; a missing table of state changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import schema
from siftline.functions import fuzzy
from siftline.operators import detectors, history, scan, triage
from siftline.operators.scan import Rule


@dataclass
class State:
    """What earlier runs left: verdicts (rule_id, file, kind), calibration points (confidence, correct), baseline (fingerprint), issues (fingerprint, state), reliability
    (layer, reliability), advisories (cwe, language, advisory)."""

    feedback: DataFrame | None = None
    points: DataFrame | None = None
    baseline: DataFrame | None = None
    issues: DataFrame | None = None
    reliability: DataFrame | None = None
    advisories: DataFrame | None = None


@dataclass
class Settings:
    marker: str = "siftline"
    strictness: int = 5
    #: beginnings of rule names whose hits are a function of their line and are tried again on its mutants
    rechecked: tuple[str, ...] = field(default_factory=tuple)
    seeds: dict = field(default_factory=lambda: detectors.SEEDS)


def findings_of(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of line rules as findings."""
    about = {r.rule_id: r for r in rules}
    hits = scan.line_hits(lines, rules)
    look = lambda f: schema.lookup(F.col("rule_id"), {k: f(r) for k, r in about.items() if f(r)})
    if len(about) > 200:  # a chain of conditions has its limits; the rules' texts are configuration
        texts = lines.sparkSession.createDataFrame([(k, r.message, r.cwe) for k, r in about.items()], "rule_id string, message string, cwe string")
        rows = hits.join(F.broadcast(texts), "rule_id")
    else:
        rows = hits.withColumns({"message": F.coalesce(look(lambda r: r.message), F.lit("")), "cwe": look(lambda r: r.cwe)})
    return schema.as_findings(rows.select(
        F.lit("L0_fast").alias("layer"), F.concat(F.lit("L0.yaml."), "rule_id").alias("rule_id"), "message", "file", F.col("line_no").alias("start_line"), "severity", "confidence",
        F.lit("module").alias("blast_radius"), F.lit(0.5).alias("exploitability"), F.lit("security").alias("category"), "cwe", F.lit("").alias("engine"),
    ))


def refined(found: DataFrame, lines: DataFrame, state: State, settings: Settings) -> DataFrame:
    """Suppression to the calibrated confidence."""
    kept, _ = triage.split_suppressed(found, triage.suppressions(lines, settings.marker).withColumn("rule_id", F.concat(F.lit("L0.yaml."), "rule_id")))
    f = triage.seed_boosted(kept, settings.seeds).drop("seed")
    f = triage.corroborated(triage.with_engine(f)).drop("boost")
    if state.feedback is not None:
        f = triage.apply_false_positives(f, triage.learn_false_positives(state.feedback.withColumn("is_fp", F.col("kind") == "fp").where("rule_id is not null and file is not null")))
    if state.points is not None:
        f = triage.calibrated(f, triage.calibration_bins(state.points))
    if settings.rechecked:
        again = F.lit(False)
        for p in settings.rechecked:
            again = again | F.col("rule_id").startswith(p)
        # a line rule finds nothing where its line is gone, so what is tried again is confirmed
        f = f.withColumn("confidence", F.when(again & (F.col("confidence") >= 0.5), F.least(F.col("confidence") + 0.15, F.lit(0.99))).otherwise(F.col("confidence")))
    return f


def decided(found: DataFrame, state: State, settings: Settings) -> DataFrame:
    """Strictness to advisories, with fis_lower, fis_upper, fis_score and decision."""
    f = triage.at_strictness(found, settings.strictness)
    if state.feedback is not None:
        f = triage.tuned(f, triage.rule_stats(state.feedback.where("rule_id is not null")))
    reliability: Column = F.lit(0.5)
    if state.reliability is not None:
        f = f.join(F.broadcast(state.reliability.select("layer", F.col("reliability").alias("__rel"))), "layer", "left")  # one row per layer
        reliability = F.coalesce("__rel", F.lit(0.5))
    f = fuzzy.add_decision(f, reliability).drop("__rel")
    if state.baseline is not None:
        f = history.against_baseline(f, state.baseline)[0]
    if state.issues is not None:
        f = triage.without_known_false(f, state.issues)
    if state.advisories is not None:
        f = triage.enriched(f, state.advisories)
    return f


def full_scan(lines: DataFrame, rules: list[Rule], state: State | None = None, settings: Settings | None = None, more: DataFrame | None = None) -> DataFrame:
    """Decided findings of all lines; ``more`` are findings of other detectors."""
    state, settings = state or State(), settings or Settings()
    found = triage.deduplicated(findings_of(lines, rules))
    if more is not None:
        found = found.unionByName(more)
    return decided(triage.deduplicated(refined(found, lines, state, settings), with_message=False), state, settings)


def diff_scan(changed: DataFrame, rules: list[Rule], state: State | None = None, settings: Settings | None = None) -> DataFrame:
    """Decided findings of changed lines (file, line_no, text), each fingerprint once."""
    state, settings = state or State(), settings or Settings()
    return decided(refined(triage.once_per_fingerprint(findings_of(changed, rules)), changed, state, settings), state, settings)


def merge_review(base: DataFrame, head: DataFrame, rules: list[Rule], changed: DataFrame | None = None) -> DataFrame:
    """One row: new and fixed findings between the lines of two revisions, and the recommendation."""
    return history.merge_review(findings_of(base, rules), findings_of(head, rules), changed)


def summary(of: DataFrame) -> DataFrame:
    """One row per decision and severity."""
    return of.groupBy("decision", "severity").agg(F.count(F.lit(1)).alias("n"))
