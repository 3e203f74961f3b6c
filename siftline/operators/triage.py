"""Post-processing of findings: deduplication, suppression, enrichment, corroboration, learning, filters, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.schema import DECISION_PRIORITY, lookup, severity_rank

#: Middle parts of a rule name that name a scanner's category, for the first and the second deduplication.
CATEGORIES_FIRST = (
    "state", "concurrency", "crypto", "modern", "idor", "cq", "biz", "auth", "ast", "taint", "bl", "v4", "yaml", "semgrep", "deepflow",
    "toctou", "field_taint", "runtime",
)
CATEGORIES_SECOND = CATEGORIES_FIRST[:12]

#: Detector names by a part of the rule name, first match wins.
ENGINES = {
    "L0.bl.": "multi_language_bl", "L0.v4.": "v4_restored", "L0.v42.": "multi_language_advanced", "L0.cq.": "code_quality",
    "L0.ast.": "tree_sitter_analyzer", "L0.state.": "state_machine", "L0.crypto.": "crypto_audit", "L0.idor.": "modern_attacks",
    "L0.jspattern.": "js_pattern_scanner", "L0.pii.": "pii_detection", "L0.auth.": "business_logic", "L0.sast.": "baseline",
    "L0.nullness.": "nullness", "L0.secrets.": "advanced_secrets", "L0.entropy_secret.": "advanced_secrets", "L0.doc_audit.": "doc_audit",
    "L0f.": "commit_risk", "L0e.": "iac_scanner", "L0b.": "supply_chain", "L0c.": "dependency_check", "L0d.": "behavioral",
    "L0.contracts.": "contracts", "L0.malicious.": "malicious_patterns", "L0.flawfinder.": "flawfinder_db",
    "L0.architecture.": "architecture", "L0.html.": "html_scanner", "L0.js_taint.": "js_cpg", "L0.js_pattern.": "js_pattern_scanner",
    "L0.cross_file.": "taint_cross_file", "L0.typestate.": "typestate", "L0.metamorphic.": "metamorphic", "L0.cpg.": "cpg_queries",
}

#: The severities reported at each strictness level.
STRICTNESS = {
    1: ("critical",), 2: ("critical", "high"), 3: ("critical", "high"), 4: ("critical", "high", "medium"),
    5: ("critical", "high", "medium", "low"), 6: ("critical", "high", "medium"), 7: ("critical", "high", "medium", "low"),
    8: ("critical", "high", "medium", "low"), 9: ("critical", "high", "medium", "low", "info"),
}

#: Our total order of findings, where the first of several is wanted.
ORDER = ("layer", "rule_id", "file", "start_line", "message", "fingerprint")


def normalised_rule(rule: Column, categories: tuple[str, ...]) -> Column:
    """Rule name without a leading L0.<category>. when at least three parts are there."""
    return F.regexp_replace(rule, rf"^L0\.({'|'.join(categories)})\.(?=.)", "")


def deduplicated(findings: DataFrame, with_message: bool = True) -> DataFrame:
    """The first finding per (normalised rule, file, line[, first 40 characters of the message])."""
    keys = [
        normalised_rule(F.col("rule_id"), CATEGORIES_FIRST if with_message else CATEGORIES_SECOND).alias("__r"),
        F.regexp_replace("file", r"^[./]+", "").alias("__f"), F.col("start_line").alias("__l"),
    ]
    if with_message:
        keys.append(F.substring(F.coalesce("message", F.lit("")), 1, 40).alias("__m"))
    names = ["__r", "__f", "__l", "__m"][: len(keys)]
    others = [c for c in findings.columns if c not in ORDER]
    # min of a struct is a partial aggregation, so a location with endless repeats is no single task
    first = findings.select(*keys, F.struct(*ORDER, *others).alias("__row")).groupBy(*names).agg(F.min("__row").alias("__row"))
    return first.select(*[F.col("__row")[c].alias(c) for c in findings.columns])


def with_engine(findings: DataFrame) -> DataFrame:
    """Name the detector of findings that have none."""
    out = F.lit("orchestrator")
    for part, name in reversed(list(ENGINES.items())):
        out = F.when(F.col("rule_id").contains(part), name).otherwise(out)
    return findings.withColumn("engine", F.when(F.coalesce("engine", F.lit("")) != "", F.col("engine")).otherwise(out))


def suppressions(lines: DataFrame, marker: str) -> DataFrame:
    """(file, line, rule_id, reason) of inline suppression comments for a tool named ``marker``; the first syntax that fits counts."""
    text = F.col("text")
    plain = rf"(?i){marker}:\s*ignore\b(?:\s*\[([^\]]+)\])?(?:\s*--\s*(.*))?$"
    noqa, pylint = rf"(?i)noqa:\s*{marker}=(\S+)", rf"(?i)pylint:\s*disable={marker}-(\S+)"
    blank = lambda c: F.when(c != "", c)
    is_plain = text.rlike(plain)
    rule = F.when(is_plain, blank(F.regexp_extract(text, plain, 1))).when(text.rlike(noqa), blank(F.regexp_extract(text, noqa, 1))).otherwise(
        blank(F.regexp_extract(text, pylint, 1))
    )
    return lines.where(is_plain | text.rlike(noqa) | text.rlike(pylint)).select(
        "file", F.col("line_no").alias("line"), rule.alias("rule_id"), F.when(is_plain, blank(F.regexp_extract(text, plain, 2))).alias("reason")
    )


def split_suppressed(findings: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): a comment covers its own and the next line, for every rule, its rule or a rule name's beginning."""
    c = comments.select(
        F.col("file").alias("__file"), F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("__line"), F.col("rule_id").alias("__rule")
    )
    hit = (F.col("file") == F.col("__file")) & (F.col("start_line") == F.col("__line")) & (
        F.col("__rule").isNull() | F.col("rule_id").startswith(F.col("__rule"))
    )
    return findings.join(c, hit, "left_anti"), findings.join(c, hit, "left_semi")


def corroborated(findings: DataFrame) -> DataFrame:
    """Raise confidence where several engines agree within one line: min(0.2, 0.05 n) for n agreeing (layer, engine).

    A finding belongs to the groups of its own and both neighbouring lines; of the groups with two or more
    engines the one at the greatest line gives the boost.
    """
    around = findings.where("file <> '' and start_line > 0").select(
        "fingerprint", "file", F.explode(F.array(*[F.col("start_line") + d for d in (-1, 0, 1)])).alias("at"),
        F.concat_ws("|", "layer", F.when(F.coalesce("engine", F.lit("")) != "", F.col("engine")).otherwise(F.element_at(F.split("rule_id", r"\."), 1))).alias("who"),
    ).where("at > 0")
    groups = around.groupBy("file", "at").agg(F.countDistinct("who").alias("engines")).where("engines >= 2")
    boosts = around.join(groups, ["file", "at"]).groupBy("fingerprint").agg(F.max_by("engines", "at").alias("engines"))
    boost = F.when(F.col("engines").isNotNull(), F.least(F.lit(0.2), 0.05 * F.col("engines"))).otherwise(0.0)  # least skips nulls
    return findings.join(boosts, "fingerprint", "left").withColumn("boost", boost).withColumn(
        "confidence", F.least(F.lit(1.0), F.col("confidence") + F.col("boost"))
    ).drop("engines")


def file_pattern(file: Column) -> Column:
    """Parent folder and base name of a path."""
    parts = F.split(file, "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(file)


def learn_false_positives(feedback: DataFrame) -> DataFrame:
    """(rule_id, pattern, occurrences, fps, rate, suppressed) from (rule_id, file, is_fp): suppressed with at least 5 seen, over half of them false."""
    return feedback.groupBy("rule_id", file_pattern(F.col("file")).alias("pattern")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_if("is_fp").alias("fps")
    ).withColumn("rate", F.col("fps") / F.col("occurrences")).withColumn("suppressed", (F.col("occurrences") >= 5) & (F.col("rate") > 0.5))


def apply_false_positives(findings: DataFrame, learnt: DataFrame) -> DataFrame:
    """Drop findings of suppressed patterns, scale the confidence of the others by 1 - rate (counters as of the start of the run)."""
    k = learnt.select(F.col("rule_id").alias("__r"), F.col("pattern").alias("__p"), "rate", "suppressed")
    joined = findings.join(k, (F.col("rule_id") == F.col("__r")) & (file_pattern(F.col("file")) == F.col("__p")), "left")
    return joined.where(~F.coalesce("suppressed", F.lit(False))).withColumn(
        "confidence", F.col("confidence") * (1 - F.coalesce("rate", F.lit(0.0)))
    ).drop("__r", "__p", "rate", "suppressed")


def calibration_bins(points: DataFrame) -> DataFrame:
    """(bin, total, correct, accuracy) of (confidence, correct) in ten equal bins."""
    bin_of = F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("int")
    return points.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct")).withColumn(
        "accuracy", F.col("correct") / F.col("total")
    )


def calibrated(findings: DataFrame, bins: DataFrame) -> DataFrame:
    """Replace confidence by its bin's accuracy where the bin has at least 5 points, if there are at least 5 at all; at most ten bins are broadcast."""
    enough = bins.agg(F.sum("total").alias("__all"))
    b = bins.where("total >= 5").crossJoin(F.broadcast(enough)).where("__all >= 5").select("bin", "accuracy")  # one row
    out = findings.withColumn("bin", F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("int")).join(F.broadcast(b), "bin", "left")
    return out.withColumn("confidence", F.coalesce("accuracy", "confidence")).drop("bin", "accuracy")


def rule_stats(feedback: DataFrame) -> DataFrame:
    """Per rule: tp, fp, fn, precision, recall, multiplier round(0.1 + 1.4 sigmoid(6 (precision - 0.7)), 3), suppressed."""
    t = feedback.groupBy("rule_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    half = F.lit(0.5)
    t = t.withColumns({
        "precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), half), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), half),
    })
    seen = F.col("tp") + F.col("fp")
    return t.withColumns({
        "multiplier": F.when(seen == 0, 1.0).otherwise(F.round(0.1 + 1.4 / (1 + F.exp(-6 * (F.col("precision") - 0.7))), 3)),
        "suppressed": (seen >= 5) & (F.col("precision") < 0.2),
    })


def tuned(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """Multiply confidence by the rule's multiplier, 0 for suppressed rules; findings without confidence are dropped."""
    s = stats.select("rule_id", "multiplier", "suppressed")
    c = F.when(F.coalesce("suppressed", F.lit(False)), 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") * F.coalesce("multiplier", F.lit(1.0))))
    )
    return findings.join(s, "rule_id", "left").withColumn("confidence", c).where("confidence > 0").drop("multiplier", "suppressed")


def tuning_adjustments(stats: DataFrame) -> DataFrame:
    """(key, widen, shift): gap of precision or recall below 0.6 with at least 5 labels, halved and at most 0.1."""
    gap = lambda c: F.least(F.lit(0.1), (0.6 - F.col(c)) * 0.5)
    enough = F.col("tp") + F.col("fp") + F.col("fn") >= 5
    return stats.where(enough).select(
        F.col("rule_id").alias("key"), F.when(F.col("precision") < 0.6, gap("precision")).otherwise(0.0).alias("widen"),
        F.when(F.col("recall") < 0.6, gap("recall")).otherwise(0.0).alias("shift"),
    )


def at_strictness(findings: DataFrame, level: int) -> DataFrame:
    return findings.where(F.col("severity").isin(*STRICTNESS[min(9, max(1, level))]))


#: Decisions that block at each strictness level; what is no block but a warning.
BLOCKS = {level: ("block", "warn") if level == 9 else ("block",) for level in STRICTNESS}
WARNS = ("warn",)


def verdict_at(decision: Column, level: int) -> Column:
    """``block``, ``warn`` or ``pass`` of a decision at a strictness level; blocking comes before warning."""
    blocks = BLOCKS[min(9, max(1, level))]
    return F.when(decision.isin(*blocks), "block").when(decision.isin(*WARNS), "warn").otherwise("pass")


def with_profile(findings: DataFrame, min_severity: str, disabled: tuple[str, ...] = (), enabled: tuple[str, ...] = ()) -> DataFrame:
    """Findings of a profile: at least a severity, without disabled rules unless enabled again."""
    off = [r for r in disabled if r not in enabled]
    ranked = findings.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)))
    return ranked.where(~F.col("rule_id").isin(*off)) if off else ranked


#: The built-in profiles with the least severity, disabled rules, paths and decisions that block.
PROFILES = {
    "minimal": ("critical", (), (), ("block",)), "relaxed": ("high", (), (), ("block",)), "default": ("low", (), (), ("block",)), "strict": ("info", (), (), ("block", "warn")),
    "tests": ("medium", ("lintr-line-length", "detekt-magic-number", "detekt-long-parameter-list", "detekt-too-long-method", "spotbugs-unused-param"), ("tests/**", "test_*.py", "*_test.py"), ("block",)),
    "production": ("low", (), ("auth/**", "crypto/**", "payment/**", "pii/**"), ("block", "warn")), "legacy": ("critical", (), (), ()),
}
#: Profiles that are tried for a file, in order.
BY_PATH = ("production", "tests", "legacy")


def profile_of(name: str, custom: dict[str, dict] | None = None) -> dict:
    """A profile with what it inherits: lists are joined, a given value counts before the parent's, ``low`` counts as not given."""
    own = dict((custom or {}).get(name) or {})
    if not own and name in PROFILES:
        least, off, paths, block = PROFILES[name]
        own = {"min_severity": least, "disabled_rules": off, "paths": paths, "block_on": block}
    parent = profile_of(own["extends"], custom) if own.get("extends") else {}
    least = own.get("min_severity", "low")
    joined = lambda k: tuple(sorted(set(own.get(k, ())) | set(parent.get(k, ()))))
    return {
        "min_severity": parent.get("min_severity", "low") if least == "low" and parent else least, "disabled_rules": joined("disabled_rules"), "enabled_rules": joined("enabled_rules"),
        "paths": tuple(own.get("paths", ())) or parent.get("paths", ()), "block_on": tuple(own.get("block_on", ())) or parent.get("block_on", ("block",)),
    }


def profile_name(file: Column, custom: dict[str, dict] | None = None) -> Column:
    """The first profile of BY_PATH one of whose globs fits a path, else ``default``; a glob's star crosses folders."""
    out = F.lit("default")
    for name in reversed(BY_PATH):
        globs = profile_of(name, custom)["paths"]
        if globs:
            import fnmatch

            fits = "|".join(fnmatch.translate(g).replace("(?s:", "(?:").replace(r"\z", "$").replace(r"\Z", "$") for g in globs)
            out = F.when(file.rlike(f"^(?:{fits})"), name).otherwise(out)
    return out


def with_profiles(findings: DataFrame, custom: dict[str, dict] | None = None) -> DataFrame:
    """Findings under the profile of their file."""
    name, rank = profile_name(F.col("file"), custom), severity_rank(F.col("severity"))
    keep = F.lit(True)
    for p in ("default", *BY_PATH):
        chosen = profile_of(p, custom)
        fits = rank >= severity_rank(F.lit(chosen["min_severity"]))
        off = [r for r in chosen["disabled_rules"] if r not in chosen["enabled_rules"]]
        if off:
            fits = fits & ~F.coalesce(F.col("rule_id"), F.lit("")).isin(*off)
        keep = F.when(name == p, fits).otherwise(keep)
    return findings.where(keep)


def without_known_false(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings whose fingerprint no issue in the state false_positive has."""
    from siftline.functions.keys import key_of, state_of

    false = issues.where(state_of(F.col("state")) == "false_positive").select(key_of(F.col("fingerprint")).alias("__k")).where("__k is not null").distinct()
    return findings.join(false, key_of(F.col("fingerprint")) == F.col("__k"), "left_anti")


def once_per_fingerprint(findings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The first finding per fingerprint, as a scan of changes keeps it; by a partial aggregation."""
    order = order or [c for c in ORDER if c != "fingerprint"]
    rest = [c for c in findings.columns if c not in (*order, "fingerprint")]
    first = findings.groupBy("fingerprint").agg(F.min(F.struct(*order, *rest)).alias("__row"))
    return first.select(*[F.col("fingerprint") if c == "fingerprint" else F.col("__row")[c].alias(c) for c in findings.columns])


def merged_engines(findings: DataFrame) -> DataFrame:
    """The first finding per (rule without the pattern engine's prefix, file, line)."""
    rule = F.regexp_replace("rule_id", r"^L0\.(?:semgrep|yaml):", "")
    others = [c for c in findings.columns if c not in ORDER]
    first = findings.groupBy(rule.alias("__r"), F.col("file").alias("__f"), F.col("start_line").alias("__l")).agg(F.min(F.struct(*ORDER, *others)).alias("__row"))
    return first.select(*[F.col("__row")[c].alias(c) for c in findings.columns])


def with_rule_config(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Apply (rule_id, active, severity_override, include, exclude): path filters are regular expressions on the path."""
    c = config.select(F.col("rule_id").alias("__r"), "active", "severity_override", "include", "exclude")
    j = findings.join(c, F.col("rule_id") == F.col("__r"), "left")
    word = F.lower("severity_override")
    word = F.when(word == "warning", "high").when(word == "info", "low").otherwise(word)
    j = j.where(F.coalesce("active", F.lit(True)))
    j = j.where(F.col("include").isNull() | F.expr("file rlike include")).where(F.col("exclude").isNull() | ~F.expr("file rlike exclude"))
    return j.withColumn("severity", F.coalesce(word, "severity")).drop("__r", "active", "severity_override", "include", "exclude")


def enriched(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Attach the sorted advisories of (cwe, language, advisory) to findings by weakness and the file's extension."""
    ext = {"py": "python", "java": "java", "js": "javascript", "ts": "javascript", "go": "go", "rb": "ruby", "php": "php", "kt": "java", "cs": "csharp"}
    lists = known.groupBy("cwe", "language").agg(F.array_sort(F.collect_set("advisory")).alias("known"))
    lang = lookup(F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)$", 1)), ext)
    return findings.withColumn("language", lang).join(lists, ["cwe", "language"], "left")


def seed_boosted(findings: DataFrame, seeds: dict[str, tuple[str, float, tuple[str, ...]]]) -> DataFrame:
    """Raise confidence by 0.1 x exploitability of the matching seed: by weakness, else the first whose keyword is in rule and message."""
    text = F.lower(F.concat_ws(" ", "rule_id", "message"))
    name, power = F.lit(None).cast("string"), F.lit(None).cast("double")
    for seed, p, words in reversed(list(seeds.values())):
        has = F.lit(False)
        for w in words:
            has = has | text.contains(w.lower())
        name, power = F.when(has, seed).otherwise(name), F.when(has, p).otherwise(power)
    cwe = F.upper(F.coalesce("cwe", F.lit("")))
    name = F.coalesce(lookup(cwe, {c: s[0] for c, s in seeds.items()}), name)
    power = F.coalesce(lookup(cwe, {c: s[1] for c, s in seeds.items()}), power)
    return findings.withColumns({"seed": name, "confidence": F.least(F.lit(1.0), F.col("confidence") + F.coalesce(0.1 * power, F.lit(0.0)))})


def overall(decided: DataFrame) -> DataFrame:
    """One row: the decision of highest priority; pass for no findings."""
    p = lookup(F.col("decision"), DECISION_PRIORITY, 0)
    return decided.agg(F.coalesce(F.max_by("decision", p), F.lit("pass")).alias("final_decision"), F.count(F.lit(1)).alias("findings"))


#: Our own presets of a gate: most critical, high, medium and low findings (-1 for any number) and most per 1,000 lines.
GATES = {"strict": (0, 0, 10, 50, 5.0), "balanced": (0, 5, -1, -1, 10.0), "lenient": (5, 20, -1, -1, 50.0)}


def gate(findings: DataFrame, lines: DataFrame, preset: str = "balanced") -> DataFrame:
    """The quality gate of a preset over as many lines as there are."""
    loc = lines.agg(F.count(F.lit(1)).alias("loc"))
    c = findings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]).crossJoin(loc)  # one row each
    most = dict(zip(("critical", "high", "medium", "low"), GATES[preset]))
    density = F.col("total") / F.greatest(F.lit(1.0), F.col("loc") / 1000.0)
    ok = density <= GATES[preset][4]
    for s, m in most.items():
        ok = ok & (F.lit(m < 0) | (F.col(s) <= m))
    return c.withColumns({"density": density, "passed": ok})


def quality_gate(findings: DataFrame, loc: int, max_critical: int, max_high: int, max_medium: int = -1, max_low: int = -1, max_density: float = 10.0) -> DataFrame:
    """One row of counts by severity, density per 1,000 lines and whether every threshold holds; -1 sets no limit."""
    counts = findings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")])
    density = F.col("total") / F.greatest(F.lit(1.0), F.lit(loc / 1000.0))
    ok = (F.col("critical") <= max_critical) & (F.col("high") <= max_high) & (density <= max_density)
    for c, m in (("medium", max_medium), ("low", max_low)):
        ok = ok & (F.lit(m < 0) | (F.col(c) <= m))
    return counts.withColumns({"density": density, "passed": ok})


def layer_reliability(stats: DataFrame) -> DataFrame:
    """Precision, recall and their mean as reliability, from tp, fp, fn per layer; 0.5 where both are 0."""
    zero = F.lit(0.0)
    t = stats.withColumns({
        "precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero),
    })
    mean = (F.col("precision") + F.col("recall")) / 2
    return t.withColumn("reliability", F.when(mean == 0, 0.5).otherwise(mean))


#: Words of a missing check and of what may follow from it.
CHECK_WORDS = ("missing", "validation", "unchecked", "no_check", "nullness", "none", "guard", "precondition")
CONSEQUENCE_WORDS = ("injection", "eval", "exec", "traversal", "xss", "ssrf", "redirect", "dereference")


def _speaks_of(words) -> Column:
    return F.lower(F.concat_ws(" ", "rule_id", "message")).rlike("|".join(words))


def root_causes(findings: DataFrame, reach: int = 30) -> DataFrame:
    """Causes and what follows from them: (file, cause_line, cause, kind, findings), without regard to the order in which causes are met.

    ``missing_validation``: a finding that speaks of a missing check, with the consequences in the next ``reach`` lines of its file, each of
    which counts for the nearest check before it.  ``shared_cwe``: two or more other findings of a weakness in a file; the first is the cause.
    ``shared_source``: two or more flows from one source in a file (findings of a taint rule; the source is a ``source`` column where there
    is one, else the last word of the message); the first is the cause.  A finding that stands in a cluster of checks is in none of the others.
    """
    source = F.col("source") if "source" in findings.columns else F.regexp_extract("message", r"(\w+)\W*$", 1)
    f = findings.where("file is not null and start_line is not null").select(
        "file", "start_line", "fingerprint", "rule_id", "message", "cwe", _speaks_of(CHECK_WORDS).alias("check"), source.alias("source")
    ).distinct().withColumn("follows", ~F.col("check") & _speaks_of(CONSEQUENCE_WORDS))
    checks = f.where("check").groupBy("file", "start_line").agg(F.min("fingerprint").alias("cause"))
    # checks and consequences meet by file and block of lines, so a file with most findings is spread over its blocks
    a = checks.select("file", F.col("start_line").alias("cause_line"), "cause", F.explode(F.array_distinct(F.array(F.floor((F.col("start_line") + 1) / reach), F.floor((F.col("start_line") + reach) / reach)))).alias("block"))
    b = f.where("follows").select("file", "start_line", "fingerprint", F.floor(F.col("start_line") / reach).alias("block"))
    pairs = b.join(a, ["file", "block"]).where((F.col("start_line") > F.col("cause_line")) & (F.col("start_line") <= F.col("cause_line") + reach))
    nearest = pairs.groupBy("file", "start_line", "fingerprint").agg(F.max(F.struct("cause_line", "cause")).alias("c")).select("file", "fingerprint", "c.cause_line", "c.cause")
    validation = nearest.groupBy("file", "cause_line", "cause").agg(F.count(F.lit(1)).alias("findings")).select("file", "cause_line", "cause", F.lit("missing_validation").alias("kind"), "findings")
    used = nearest.select("fingerprint").unionByName(nearest.select(F.col("cause").alias("fingerprint"))).distinct()
    rest = f.join(used, "fingerprint", "left_anti")

    def shared(rows: DataFrame, by: str, kind: str) -> DataFrame:
        g = rows.groupBy("file", by).agg(F.min(F.struct("start_line", "fingerprint")).alias("c"), F.countDistinct("fingerprint").alias("n")).where("n >= 2")
        return g.select("file", F.col("c.start_line").alias("cause_line"), F.col("c.fingerprint").alias("cause"), F.lit(kind).alias("kind"), (F.col("n") - 1).alias("findings"))

    weakness = shared(rest.where("cwe is not null and cwe <> ''"), "cwe", "shared_cwe")
    flows = shared(rest.where(F.lower("rule_id").contains("taint") & (F.coalesce("source", F.lit("")) != "")), "source", "shared_source")
    return validation.unionByName(weakness).unionByName(flows)
