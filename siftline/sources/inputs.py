"""Third-party inputs as tables: unified diffs, dependency manifests, coverage reports, rule files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators.scan import Rule
from siftline.sources.files import lines_of

_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff, file, line, kind, text, hunk, start, lines): added, removed and context lines of unified diffs in (diff, content), with new line numbers and their hunk.

    Headers are carried forward over the lines of their diff; a removed line has the number of the line after it.
    """
    rows = lines_of(diffs.select(F.col("diff").alias("file"), "content")).withColumnRenamed("file", "diff")
    w = W.partitionBy("diff").orderBy("line_no")
    t = F.col("text")
    rows = rows.withColumns({
        "file": F.last(F.when(t.startswith("+++ "), F.regexp_replace(t, r"^\+\+\+ (?:b/)?", "")), ignorenulls=True).over(w),
        "hunk": F.last(F.when(t.rlike(_HUNK), F.col("line_no")), ignorenulls=True).over(w),
        "start": F.last(F.when(t.rlike(_HUNK), F.regexp_extract(t, _HUNK, 1).cast("int")), ignorenulls=True).over(w),
        "lines": F.last(F.when(t.rlike(_HUNK), F.coalesce(F.nullif(F.regexp_extract(t, _HUNK, 2), F.lit("")).cast("int"), F.lit(1))), ignorenulls=True).over(w),
    })
    head = t.startswith("+++ ") | t.startswith("--- ") | t.startswith("diff ") | t.startswith("index ") | t.rlike(_HUNK)
    body = rows.where(F.col("hunk").isNotNull() & ~head)
    inside = W.partitionBy("diff", "hunk").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(t.startswith("-"), 0).otherwise(1)).over(inside), F.lit(0))
    kind = F.when(t.startswith("+"), "added").when(t.startswith("-"), "removed").otherwise("context")
    return body.select(
        "diff", "file", (F.col("start") + before).cast("int").alias("line"), kind.alias("kind"), F.expr("substring(text, 2)").alias("text"), "hunk", "start", "lines"
    )


def hunks(diffs: DataFrame) -> DataFrame:
    """(diff, file, first_line, last_line, added, removed): one row per hunk, with the range of new lines its header names."""
    d = diff_lines(diffs)
    g = d.groupBy("diff", "file", "hunk").agg(
        F.min("start").alias("first_line"), F.min(F.col("start") + F.greatest(F.col("lines") - 1, F.lit(0))).alias("last_line"),
        F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"),
    )
    return g.drop("hunk")


def enclosing_function(places: DataFrame, functions: DataFrame) -> DataFrame:
    """Places (file, line) with the smallest function that contains them."""
    f = functions.select(F.col("file").alias("__f"), F.col("name").alias("function"), F.col("line").alias("__a"), "end_line")
    j = places.join(f, (F.col("file") == F.col("__f")) & F.col("line").between(F.col("__a"), F.col("end_line")), "left")
    return j.groupBy(*places.columns).agg(F.min_by("function", F.col("end_line") - F.col("__a")).alias("function"))


def requirements(files: DataFrame) -> DataFrame:
    """(file, name, version, ecosystem) of requirement lists in (file, content)."""
    pattern = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:[=~<>!]=?=?\s*([0-9][A-Za-z0-9.*+-]*))?"
    t = F.regexp_replace("text", r"\s*#.*$", "")
    rows = lines_of(files).where(t.rlike(r"^\s*[A-Za-z0-9]"))
    return rows.select("file", F.lower(F.regexp_extract(t, pattern, 1)).alias("name"), F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")).alias("version"), F.lit("pip").alias("ecosystem"))


def package_json(files: DataFrame) -> DataFrame:
    """(file, name, version, ecosystem) of package.json files."""
    maps = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    both = files.select("file", maps.alias("m")).select("file", F.array("m.dependencies", "m.devDependencies").alias("ms"))
    rows = both.select("file", F.explode("ms").alias("m")).where("m is not null").select("file", F.explode("m").alias("name", "spec"))
    return rows.select("file", "name", F.nullif(F.regexp_extract("spec", r"(\d[\w.+-]*)", 1), F.lit("")).alias("version"), F.lit("npm").alias("ecosystem"))


def _by_pattern(files: DataFrame, pattern: str, ecosystem: str, name: str = "concat(g1, ':', g2)", version: str = "g3") -> DataFrame:
    """Dependencies of formats that a line or block pattern with up to three groups describes."""
    n = re.compile(pattern).groups
    m = F.explode(F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(i + 1)).alias(f"g{i + 1}") for i in range(n)]))
    rows = files.where("content is not null").select("file", m.alias("m")).select("file", "m.*")
    return rows.select("file", F.expr(name).alias("name"), F.nullif(F.expr(version), F.lit("")).alias("version"), F.lit(ecosystem).alias("ecosystem"))


def pom(files: DataFrame) -> DataFrame:
    return _by_pattern(files, r"(?s)<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>(?:\s*<version>([^<]+)</version>)?", "maven")


def gradle(files: DataFrame) -> DataFrame:
    return _by_pattern(files, r"(?:implementation|api|compile|testImplementation)\s*\(?['\"]([^:'\"]+):([^:'\"]+):([^'\"]+)['\"]", "maven")


def go_mod(files: DataFrame) -> DataFrame:
    return _by_pattern(files, r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v(\S+)", "go", "g1", "g2")


def cargo(files: DataFrame) -> DataFrame:
    return _by_pattern(files, r"(?m)^([A-Za-z0-9_-]+)\s*=\s*(?:\{[^}]*version\s*=\s*)?\"([0-9][^\"]*)\"", "cargo", "g1", "g2")


def gemfile(files: DataFrame) -> DataFrame:
    return _by_pattern(files, r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"][~><= ]*([0-9][^'\"]*)['\"])?", "gem", "g1", "g2")


def composer(files: DataFrame) -> DataFrame:
    maps = F.from_json("content", "require map<string,string>")
    rows = files.select("file", F.explode(maps["require"]).alias("name", "spec")).where("name <> 'php'")
    return rows.select("file", "name", F.nullif(F.regexp_extract("spec", r"(\d[\w.+-]*)", 1), F.lit("")).alias("version"), F.lit("composer").alias("ecosystem"))


def poetry_lock(files: DataFrame) -> DataFrame:
    return _by_pattern(files, r"(?s)\[\[package\]\]\s*name\s*=\s*\"([^\"]+)\"\s*version\s*=\s*\"([^\"]+)\"", "pip", "g1", "g2")


def pyproject(files: DataFrame) -> DataFrame:
    """Dependencies listed in the project table of pyproject.toml."""
    block = F.regexp_extract("content", r"(?s)\[project\].*?\bdependencies\s*=\s*\[(.*?)\n?\]\s*(?:\n|$)", 1)
    items = F.explode(F.regexp_extract_all(block, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1)))
    p = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:[=~<>!^]+\s*([0-9][A-Za-z0-9.*+-]*))?"
    rows = files.where("content is not null").select("file", items.alias("item"))
    return rows.select("file", F.lower(F.regexp_extract("item", p, 1)).alias("name"), F.nullif(F.regexp_extract("item", p, 2), F.lit("")).alias("version"), F.lit("pip").alias("ecosystem")).where("name <> ''")


def pipfile_lock(files: DataFrame) -> DataFrame:
    """Default and development packages of Pipfile.lock."""
    package = "map<string, struct<version: string>>"
    maps = F.from_json("content", f"`default` {package}, develop {package}")
    rows = files.select("file", F.explode(F.array(maps["default"], maps["develop"])).alias("m")).where("m is not null").select("file", F.explode("m").alias("name", "p"))
    return rows.select("file", F.lower("name").alias("name"), F.regexp_replace("p.version", r"^[=~<>!^ ]+", "").alias("version"), F.lit("pip").alias("ecosystem"))


def package_lock(files: DataFrame) -> DataFrame:
    """Packages of package-lock.json, in the form by path (version 2 on) or by name (version 1)."""
    entry = "map<string, struct<version: string>>"
    maps = F.from_json("content", f"packages {entry}, dependencies {entry}")
    both = F.when(maps["packages"].isNotNull(), maps["packages"]).otherwise(maps["dependencies"])
    rows = files.select("file", F.explode(both).alias("path", "p")).where("path <> '' and p.version is not null")
    name = F.regexp_replace("path", r"^(?:.*/)?node_modules/", "")
    return rows.select("file", name.alias("name"), F.col("p.version").alias("version"), F.lit("npm").alias("ecosystem"))


def yarn_lock(files: DataFrame) -> DataFrame:
    return _by_pattern(files, r"(?m)^\"?(@?[^@\s\"]+)@[^\n]*:\n\s+version:? \"?([^\"\s]+)\"?", "npm", "g1", "g2")


def go_sum(files: DataFrame) -> DataFrame:
    return _by_pattern(files, r"(?m)^(\S+) v(\S+?)(?:/go\.mod)? h1:", "go", "g1", "g2")


def gemfile_lock(files: DataFrame) -> DataFrame:
    return _by_pattern(files, r"(?m)^    ([A-Za-z0-9_.-]+) \(([0-9][^)]*)\)", "gem", "g1", "g2")


def composer_lock(files: DataFrame) -> DataFrame:
    package = "array<struct<name: string, version: string>>"
    lists = F.from_json("content", f"packages {package}, `packages-dev` {package}")
    rows = files.select("file", F.explode(F.concat(F.coalesce(lists["packages"], F.array()), F.coalesce(lists["packages-dev"], F.array()))).alias("p"))
    return rows.select("file", F.col("p.name").alias("name"), F.regexp_replace("p.version", "^v", "").alias("version"), F.lit("composer").alias("ecosystem"))


MANIFESTS = {
    "requirements.txt": requirements, "package.json": package_json, "pom.xml": pom, "build.gradle": gradle, "go.mod": go_mod, "Cargo.toml": cargo,
    "Gemfile": gemfile, "composer.json": composer, "poetry.lock": poetry_lock, "Cargo.lock": poetry_lock,
    "pyproject.toml": pyproject, "Pipfile.lock": pipfile_lock, "package-lock.json": package_lock, "yarn.lock": yarn_lock, "go.sum": go_sum, "Gemfile.lock": gemfile_lock,
    "composer.lock": composer_lock, "build.gradle.kts": gradle,
}


def dependencies(files: DataFrame) -> DataFrame:
    """(file, name, version, ecosystem) of every known manifest and lock file among (file, content)."""
    out = None
    for suffix, parse in MANIFESTS.items():
        part = parse(files.where(F.element_at(F.split("file", "/"), -1) == suffix)).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def coverage_python(files: DataFrame) -> DataFrame:
    """(file, covered, total) of JSON reports of the Python tool."""
    schema = "files map<string, struct<summary: struct<covered_lines: int, num_statements: int>>>"
    rows = files.select(F.explode(F.from_json("content", schema)["files"]).alias("file", "f"))
    return rows.select("file", F.col("f.summary.covered_lines").alias("covered"), F.col("f.summary.num_statements").alias("total"))


def coverage_go(files: DataFrame) -> DataFrame:
    """(file, covered, total) of Go profiles: statements by whether they ran."""
    p = r"^(.+):\d+\.\d+,\d+\.\d+ (\d+) (\d+)$"
    rows = lines_of(files).where(F.col("text").rlike(p)).select(F.regexp_extract("text", p, 1).alias("file"), F.regexp_extract("text", p, 2).cast("int").alias("n"), F.regexp_extract("text", p, 3).cast("int").alias("hits"))
    return rows.groupBy("file").agg(F.sum(F.when(F.col("hits") > 0, F.col("n")).otherwise(0)).cast("int").alias("covered"), F.sum("n").cast("int").alias("total"))


def coverage_jacoco(files: DataFrame) -> DataFrame:
    """(file, covered, total) of XML reports: the LINE counter of each source file; one without such a counter has no row."""
    counter = "struct<_type: string, _missed: int, _covered: int>"
    schema = f"package array<struct<sourcefile: array<struct<_name: string, counter: array<{counter}>>>>>"
    report = F.from_xml(F.regexp_replace("content", r"<!DOCTYPE[^>]*>", ""), schema)
    rows = files.where("content is not null").select(F.explode(report["package"]).alias("p")).select(F.explode("p.sourcefile").alias("s"))
    line = F.get(F.filter("s.counter", lambda c: c["_type"] == "LINE"), F.lit(0))
    rows = rows.select(F.col("s._name").alias("file"), line.alias("c")).where("c is not null")
    return rows.select("file", F.col("c._covered").alias("covered"), (F.col("c._covered") + F.col("c._missed")).alias("total"))


def coverage_istanbul(files: DataFrame) -> DataFrame:
    """(file, covered, total) of JSON reports with statement hit counts."""
    rows = files.select(F.explode(F.from_json("content", "map<string, struct<s: map<string,int>>>")).alias("file", "f"))
    hits = F.map_values("f.s")
    return rows.select("file", F.size(F.filter(hits, lambda x: x > 0)).alias("covered"), F.size(hits).alias("total"))


def rules_of(text: str) -> list[Rule]:
    """Line rules of a YAML list; ``pattern``, ``pattern-regex``, ``pattern-either`` (any of) or the first simple one of ``patterns``."""
    import yaml

    alias = {"warning": "medium", "error": "high", "note": "low", "unknown": "medium"}
    out = []
    data = yaml.safe_load(text) or []
    for r in data.get("rules", []) if isinstance(data, dict) else data:
        either = [x.get("pattern") or x.get("pattern-regex") for x in r.get("pattern-either") or []]
        first = next((x.get("pattern") or x.get("pattern-regex") for x in r.get("patterns") or [] if x.get("pattern") or x.get("pattern-regex")), None)
        pattern = r.get("pattern") or r.get("pattern-regex") or "|".join(f"(?:{p})" for p in either if p) or first
        if not pattern:
            continue
        m = re.fullmatch(r"/(.*)/([a-z]*)", pattern, re.S)
        severity = str(r.get("severity", "medium")).lower()
        out.append(Rule(
            str(r["id"]), m.group(1) if m else pattern, alias.get(severity, severity), message=r.get("message", ""), cwe=str((r.get("metadata") or {}).get("cwe", "")),
            ignore_case=bool(m and "i" in m.group(2)), languages=tuple(x for x in r.get("languages") or () if x not in ("generic", "multi", "any")),
            paths=tuple((r.get("paths") or {}).get("include") or ()), skips=tuple((r.get("paths") or {}).get("exclude") or ()),
        ))
    return out


#: Place holders of the rule language and what they match; everything else in a pattern is a regular expression.
PLACEHOLDERS = {"$STRING": r"['\"][^'\"]*['\"]", "$IDENT": r"\w+", "$META": r"(\w+)", "...": r".*?"}


def dsl_regex(pattern: str) -> str:
    """Regular expression of a rule-language pattern."""
    import functools

    return functools.reduce(lambda p, kv: p.replace(*kv), PLACEHOLDERS.items(), pattern)


def dsl_matches(lines: DataFrame, rule_id: str, pattern: str) -> DataFrame:
    """(…, rule_id, column, match): the first match of a rule-language pattern per line, with its column."""
    rx = dsl_regex(pattern)
    m = F.regexp_substr("text", F.lit(rx))
    # the match's first place is not always where its text first occurs, so the part before it is measured
    before = F.length(F.regexp_extract("text", rf"^(.*?)(?:{rx})", 1))
    return lines.where(F.col("text").rlike(rx)).select(*lines.columns, F.lit(rule_id).alias("rule_id"), (before + 1).alias("column"), m.alias("match"))


def state_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored state table, empty where it was never written."""
    from siftline.runtime import hadoop_fs

    fs, p = hadoop_fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)
