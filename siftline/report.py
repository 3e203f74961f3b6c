"""Sinks: report documents, component lists, JSON, pages and logs.

Documents hold a bounded number of results each, so none is built in one task for a hot engine or ecosystem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.schema import severity_rank

PART = 10_000


def parts_of(rows: DataFrame, by: str, key: Column, size: int = PART) -> DataFrame:
    """Rows with a ``part`` number such that a part of a group has about ``size`` rows; groups are counted first, one row each is sent."""
    counts = rows.groupBy(F.col(by).alias("__by")).agg((F.floor(F.count(F.lit(1)) / size) + 1).alias("__parts"))
    j = rows.join(F.broadcast(counts), F.col(by).eqNullSafe(F.col("__by")), "left")
    return j.withColumn("part", F.pmod(F.xxhash64(key), "__parts")).drop("__by", "__parts")


def sarif(findings: DataFrame, results_per_part: int = PART) -> DataFrame:
    """(engine, part, report): report documents with rules, results, code flows and notifications.

    Optional columns: ``source_line`` (where foreign data enters: gives a flow of two places), ``failed`` (text of a detector's failure: gives a
    notification instead of a result).
    """
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")

    def place(line: Column) -> Column:
        return F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))

    start = F.col("start_line")
    flow = F.array(F.struct(F.array(F.struct(F.array(*[F.struct(place(x).alias("location")) for x in (F.col("source_line"), start)]).alias("locations"))).alias("threadFlows"))) if "source_line" in findings.columns else F.lit(None)
    if "source_line" in findings.columns:
        flow = F.when(F.col("source_line").isNotNull(), flow)
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place(start)).alias("locations"),
        F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), *([flow.alias("codeFlows")] if "source_line" in findings.columns else []),
    )
    failed = F.col("failed") if "failed" in findings.columns else F.lit(None).cast("string")
    sized = parts_of(findings, "engine", F.col("fingerprint"), results_per_part)
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(level.alias("level")).alias("defaultConfiguration"))
    docs = sized.groupBy("engine", "part").agg(
        F.array_sort(F.collect_list(F.when(failed.isNull(), result))).alias("results"), F.array_sort(F.collect_set(F.when(failed.isNull(), rule))).alias("rules"),
        F.array_sort(F.collect_list(F.when(failed.isNotNull(), F.struct(F.lit("error").alias("level"), F.struct(failed.alias("text")).alias("message"))))).alias("notes"),
    )
    run = F.struct(
        F.struct(F.struct(F.col("engine").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"),
        F.array(F.struct((F.size("notes") == 0).alias("executionSuccessful"), F.col("notes").alias("toolExecutionNotifications"))).alias("invocations"),
    )
    return docs.select("engine", "part", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("report"))


def _components(components: DataFrame, per_part: int) -> DataFrame:
    licence = F.col("licence") if "licence" in components.columns else F.lit(None).cast("string")
    one = components.select("ecosystem", "name", F.coalesce("version", F.lit("latest")).alias("version"), licence.alias("licence")).distinct()
    return parts_of(one, "ecosystem", F.col("name"), per_part)


def sbom(components: DataFrame, per_part: int = PART) -> DataFrame:
    """(ecosystem, part, bom): component lists of (ecosystem, name, version, licence)."""
    purl = F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "name", F.lit("@"), "version")
    licences = F.when(F.col("licence").isNotNull(), F.array(F.struct(F.struct(F.col("licence").alias("name")).alias("license"))))
    item = F.struct(F.lit("library").alias("type"), "name", "version", purl.alias("purl"), licences.alias("licenses"))
    lists = _components(components, per_part).groupBy("ecosystem", "part").agg(F.array_sort(F.collect_list(item)).alias("components"))
    head = (F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"))
    return lists.select("ecosystem", "part", F.to_json(F.struct(*head, "components")).alias("bom"))


def spdx(components: DataFrame, name: str = "siftline", per_part: int = PART) -> DataFrame:
    """(ecosystem, part, spdx): the same as package lists."""
    said = F.coalesce("licence", F.lit("NOASSERTION"))
    item = F.struct(
        F.concat(F.lit("SPDXRef-Package-"), F.substring(F.sha2(F.concat_ws("|", "ecosystem", "name", "version"), 256), 1, 16)).alias("SPDXID"), "name", F.col("version").alias("versionInfo"),
        F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"), said.alias("licenseConcluded"), said.alias("licenseDeclared"), F.concat(F.lit("Organization: "), "ecosystem").alias("supplier"),
    )
    lists = _components(components, per_part).groupBy("ecosystem", "part").agg(F.array_sort(F.collect_list(item)).alias("packages"))
    head = (F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(name).alias("name"))
    return lists.select("ecosystem", "part", F.to_json(F.struct(*head, "packages")).alias("spdx"))


MOST_IN_PAGE = 5_000


def html(findings: DataFrame, title: str = "Findings", most: int = MOST_IN_PAGE) -> str:
    """A page of the ``most`` gravest findings (the bound is the page's own), with counts of all by severity."""
    from html import escape

    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per severity
    top = findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "start_line", "rule_id").limit(most).select("severity", "rule_id", "file", "start_line", "message").collect()
    cell = lambda x: f"<td>{escape(str('' if x is None else x))}</td>"
    rows = "\n".join(f'<tr class="{escape(str(r["severity"]))}">{"".join(map(cell, r))}</tr>' for r in top)
    heads = "".join(f"<th>{h}</th>" for h in ("severity", "rule", "file", "line", "message"))
    said = ", ".join(f"{escape(str(k))}: {n}" for k, n in sorted(counts.items(), key=str))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><p>{said}</p><table><tr>{heads}</tr>\n{rows}\n</table></body></html>'


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def save_all(findings: DataFrame, path: str) -> list[str]:
    """Write every form of the report below a folder of the shared store; returns the paths."""
    from siftline.runtime import hadoop_fs

    write_json(findings, f"{path}/findings.json")
    sarif(findings).write.mode("overwrite").json(f"{path}/report.sarif")
    fs, p = hadoop_fs(findings.sparkSession, f"{path}/report.html")
    stream = fs.create(p, True)
    stream.write(bytearray(html(findings).encode()))
    stream.close()
    return [f"{path}/findings.json", f"{path}/report.sarif", f"{path}/report.html"]
