"""Flows of foreign data through the lines of a file.

``flows`` follows variables line by line: a line that reads a source taints the variable it assigns, an assignment from a tainted
variable passes the taint on, one through a cleaning function removes it, and a function header begins anew.  Every file is one row,
so the fold runs where the file lies, nothing is shuffled, and a task holds one batch of files.

``source_sink_lines`` relates source and sink lines of a file without following variables.  Instead of all pairs it gives one row per
sink with the number of sources that reach it, which running sums over blocks of lines yield.

Defined results: a null text has no flows; comments are no code; a source that is used in a sink's own line reaches it
directly; of several ways from a variable to a sink in one line one is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.blocks import carried_last, running_sum

#: Sources, sinks with kind, weakness and severity, and cleaning functions, by language.
JS_SOURCES = (
    "req.params", "req.query", "req.body", "req.headers", "req.cookies", "location.hash", "location.search", "document.URL", "document.referrer", "document.location",
    "window.location", "localStorage", "sessionStorage", "event.data", "process.argv", "request.body", "request.query", "request.params",
)
JAVA_SOURCES = (
    "request.getParameter", "request.getHeader", "request.getQueryString", "request.getRequestURI", "request.getCookies", "request.getAttribute", "@RequestParam", "@RequestBody",
    "@PathVariable", "@RequestHeader", "System.getenv", "System.getProperty", "args[", "Scanner.next", "BufferedReader.readLine", "JOptionPane.showInputDialog",
)
JS_SINKS = {
    "eval": ("CWE-95", "critical"), "Function": ("CWE-95", "critical"), "setTimeout": ("CWE-95", "high"), "setInterval": ("CWE-95", "high"), "innerHTML": ("CWE-79", "high"),
    "outerHTML": ("CWE-79", "high"), "document.write": ("CWE-79", "critical"), "document.writeln": ("CWE-79", "high"), "insertAdjacentHTML": ("CWE-79", "high"), "query": ("CWE-89", "critical"),
    "execute": ("CWE-89", "critical"), "exec": ("CWE-78", "critical"), "execSync": ("CWE-78", "critical"), "spawn": ("CWE-78", "high"), "fetch": ("CWE-918", "high"), "axios": ("CWE-918", "high"),
    "request": ("CWE-918", "high"), "redirect": ("CWE-601", "high"), "createWriteStream": ("CWE-22", "high"), "readFile": ("CWE-22", "high"), "readFileSync": ("CWE-22", "high"),
    "unlink": ("CWE-22", "high"), "open": ("CWE-22", "medium"),
}
JAVA_SINKS = {
    "executeQuery": ("CWE-89", "critical"), "executeUpdate": ("CWE-89", "critical"), "execute": ("CWE-89", "critical"), "createStatement": ("CWE-89", "high"), "sendRedirect": ("CWE-601", "high"),
    "getRequestDispatcher": ("CWE-601", "medium"), "exec": ("CWE-78", "critical"), "ProcessBuilder": ("CWE-78", "critical"), "readObject": ("CWE-502", "critical"), "new File": ("CWE-22", "high"),
    "Paths.get": ("CWE-22", "high"), "write": ("CWE-22", "medium"), "println": ("CWE-200", "low"), "printf": ("CWE-200", "low"), "format": ("CWE-134", "medium"), "transform": ("CWE-94", "high"),
    "new URL": ("CWE-918", "high"), "openConnection": ("CWE-918", "high"), "setAttribute": ("CWE-94", "medium"), "println.write": ("CWE-79", "high"),
}
JS_CLEANERS = (
    "DOMPurify.sanitize", "sanitize", "escapeHtml", "escapeHTML", "encodeURIComponent", "encodeURI", "parseInt", "parseFloat", "Number", "Boolean", "validator.isXss", "validator.isEmail",
    "xss", "filter", "stripTags", "he.encode", "escape", "JSON.stringify", "String", "TextEncoder",
)
JAVA_CLEANERS = (
    "Integer.parseInt", "Long.parseLong", "Double.parseDouble", "Float.parseFloat", "Boolean.parseBoolean", "URLEncoder.encode", "URLDecoder.decode", "StringEscapeUtils.escapeHtml",
    "StringEscapeUtils.escapeSql", "escapeHtml", "escapeHtml4", "escapeHtml3", "escapeXml", "setString", "setInt", "setLong", "setDouble", "setBoolean", "Pattern.quote", "Matcher.quoteReplacement",
    "Integer.valueOf", "Long.valueOf",
)
#: Fields that requests must not set.
SENSITIVE_FIELDS = (
    "role", "isAdmin", "is_admin", "is_superuser", "is_staff", "admin", "password", "passwordHash", "password_hash", "salt", "permissions", "permissions_list", "authorities", "balance", "credit",
    "credit_limit", "creditLimit", "status", "verified", "is_verified", "email_verified", "active", "plan", "subscription", "tier", "level", "salary", "wage", "compensation", "apiKey", "api_key", "secret", "token",
)
#: Lines that read foreign data, that do something dangerous, and that clean, for the relation of lines.
LINE_SOURCES = (
    r"localStorage\.getItem\s*\(\s*[\"']([^\"']+)", r"req\.(body|query|params|headers|cookies)\b", r"request\.(body|query|params|headers|cookies)\b", r"useParams\s*\(\s*\)", r"useSearchParams\s*\(\s*\)",
    r"useLocation\s*\(\s*\)", r"event\.target\.value", r"e\.target\.value", r"document\.cookie", r"window\.location\.(search|hash|href)", r"fetch\s*\(", r"axios\.(get|post|put|delete|patch)\s*\(",
)
LINE_SINKS = (
    r"\.innerHTML\s*=", r"\.outerHTML\s*=", r"document\.write\s*\(", r"\beval\s*\(", r"new\s+Function\s*\(", r"dangerouslySetInnerHTML", r"html2pdf\s*\(", r"\.from\s*\(\s*`[^`]*\$\{", r"window\.open\s*\(",
    r"window\.location(?:\.href)?\s*=", r"child_process\.(exec|execSync|spawn)\s*\(", r"require\s*\(\s*[\"']child_process", r"setTimeout\s*\(\s*[\"']", r"setInterval\s*\(\s*[\"']",
    r"localStorage\.setItem\s*\(\s*[\"'].*TOKEN", r"localStorage\.setItem\s*\(\s*[\"']AUTH",
)
LINE_CLEANERS = (
    r"DOMPurify\.sanitize\s*\(", r"escape\s*\(", r"escapeHtml\s*\(", r"textContent\s*=", r"encodeURIComponent\s*\(", r"parseInt\s*\(", r"parseFloat\s*\(", r"Number\s*\(", r"Boolean\s*\(",
)

_JS = {"js", "jsx", "mjs", "ts", "tsx"}
_HEADER = {
    "javascript": re.compile(r"\bfunction\s+\w+\s*\(|\b(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"),
    "java": re.compile(r"\b(?:public|private|protected)\b[^=;]*\b\w+\s*\([^;]*$"),
}
_ASSIGNED = re.compile(r"^(?:(?:const|let|var|final|public|private)\s+)*(?:[A-Za-z_][\w<>\[\], ]*\s+)?(\{[^}]*\}|[A-Za-z_$]\w*)\s*=(?!=)\s*(.*)$")
_NAME = re.compile(r"[A-Za-z_$]\w*")
_ANNOTATED = re.compile(r"(@RequestParam|@RequestBody|@PathVariable|@RequestHeader)(?:\([^)]*\))?\s+\w+(?:<[^>]*>)?\s+(\w+)")
_LITERAL = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'")

FLOW_SCHEMA = "file string, line int, rule_id string, severity string, cwe string, source string, variable string, sink string"


class _Language:
    def __init__(self, name: str, sources, sinks, cleaners, mark: str):
        self.name, self.sources, self.sinks, self.mark = name, sources, sinks, mark
        self.cleans = re.compile("|".join(rf"(?<!\w){re.escape(c)}\s*\(" for c in cleaners))
        # a sink is called with something, or is a property that is set
        self.calls = re.compile("|".join(rf"(?P<s{i}>(?<![\w]){re.escape(s)}\s*\(|\.{re.escape(s)}\s*\+?=(?!=))" for i, s in enumerate(sinks)))
        self.names = list(sinks)


def _argument(text: str, at: int) -> str:
    """What follows an opening parenthesis up to its counterpart, or an assignment up to the end."""
    depth = 1
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return text[at:i]
    return text[at:]


def _flows(language: _Language, text: str) -> Iterator[tuple]:
    tainted: dict[str, str] = {}
    header = _HEADER[language.name]
    comment = False
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if comment or line.startswith("/*"):
            comment = "*/" not in line
            continue
        if not line or line.startswith(("//", "*")):
            continue
        if header.search(line):
            tainted.clear()
            tainted.update((name, what) for what, name in _ANNOTATED.findall(line))
        if not tainted and not any(s in line for s in language.sources):
            continue
        assigned = _ASSIGNED.match(line)
        if assigned:
            target, value = assigned.groups()
            source = next((s for s in language.sources if s in value), None) or next((tainted[n] for n in _NAME.findall(_LITERAL.sub("", value)) if n in tainted), None)
            for name in _NAME.findall(target):
                if source and not language.cleans.search(value):
                    tainted[name] = source
                else:
                    tainted.pop(name, None)
        if language.cleans.search(line):
            continue
        seen = set()
        for m in language.calls.finditer(line):
            sink = language.names[int(m.lastgroup[1:])]
            given = _argument(line, m.end()) if m.group().endswith("(") else line[m.end() :]
            direct = next((s for s in language.sources if s in given), None)
            found = [("", direct)] if direct else []
            found += [(n, tainted[n]) for n in dict.fromkeys(_NAME.findall(_LITERAL.sub("", given))) if n in tainted and not direct]
            for variable, source in found:
                if (variable, sink) not in seen:
                    seen.add((variable, sink))
                    cwe, severity = language.sinks[sink]
                    yield number, f"DF.{language.mark}-FLOW-{sink.upper().replace(' ', '-')}", severity, cwe, source, variable, sink


_LANGUAGES = {
    "javascript": _Language("javascript", JS_SOURCES, JS_SINKS, JS_CLEANERS, "JS"),
    "java": _Language("java", JAVA_SOURCES, JAVA_SINKS, JAVA_CLEANERS, "JAVA"),
}

_FIELD_SOURCES = [re.compile(p) for p in (
    r"@(?:PathVariable|RequestParam)(?:\([^)]*\))?\s+(?:\w+\s+)?(\w+)", r"@(?:RequestBody|ModelAttribute)\s+\w+\s+(\w+)",
    r"(\w+)\s*=\s*request\.(?:POST|GET|args|form|json|data|values)\b", r"(\w+)\s*=\s*(?:req|ctx\.request|ctx)\.(?:body|params|query)\b",
)]
_FIELD_SETTER = re.compile(r"\.(?:set|with)([A-Z]\w*)\s*\(\s*(\w+)\s*\)|\.(\w+)\s*=(?!=)\s*(\w+)")
_FIELD_LOOKUP = re.compile(r"\b(?:findById|getOne|getById)\s*\(\s*(\w+)\s*\)|\.get\s*\(\s*(?:id\s*=\s*|pk\s*=\s*)?(\w+)\s*\)|\.filter\s*\(\s*(?:id|pk|user_id|userId)\s*=\s*(\w+)\s*\)")
_FIELD_SAVE = re.compile(r"\.(?:save|update)\s*\(\s*(\w+)\s*\)")
_COPIES = re.compile(r"BeanUtils\.copyProperties\s*\(\s*(?:request|req|dto|body|form|input)|Object\.assign\s*\(\s*\w+\s*,\s*(?:req\.body|ctx\.request\.body|request\.body)|\{\s*\.\.\.\s*(?:req\.body|ctx\.request\.body|request\.body)", re.I)


def _field_flows(text: str) -> Iterator[tuple]:
    """Requests that choose a record, set a field they must not, or fill a record as a whole."""
    tainted: set[str] = set()
    for number, line in enumerate(text.splitlines(), 1):
        for p in _FIELD_SOURCES:
            tainted.update(p.findall(line))
        if _COPIES.search(line):
            yield number, "L0.field_taint.mass_copy", "high", "CWE-915", "request", "", "copy"
        if not tainted:
            continue
        for a, b, c, d in _FIELD_SETTER.findall(line):
            field, value = (a[:1].lower() + a[1:], b) if a else (c, d)
            if value in tainted and field in SENSITIVE_FIELDS:
                yield number, "L0.field_taint.sensitive_setter", "critical", "CWE-915", "request", value, field
        for names in _FIELD_LOOKUP.findall(line):
            for name in filter(None, names):
                if name in tainted:
                    yield number, "L0.field_taint.idor_sink", "high", "CWE-639", "request", name, "lookup"
        for name in _FIELD_SAVE.findall(line):
            if name in tainted:
                yield number, "L0.field_taint.mass_assignment", "high", "CWE-915", "request", name, "save"


def flows(files: DataFrame) -> DataFrame:
    """Flows of (file, content) by the language of the file's extension, and of fields in every language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                ext = (file or "").rpartition(".")[2].lower()
                language = "javascript" if ext in _JS else "java" if ext in ("java", "kt") else None
                if language:
                    rows.extend((file, *r) for r in _flows(_LANGUAGES[language], text))
                rows.extend((file, *r) for r in _field_flows(text))
            columns = list(zip(*rows)) or [[]] * 8
            types = [pa.string(), pa.int32(), *[pa.string()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "line", "rule_id", "severity", "cwe", "source", "variable", "sink"])

    return files.select("file", "content").mapInArrow(run, FLOW_SCHEMA)


def _any(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def source_sink_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, sources, nearest): sink lines with the number of source lines at or before them that no cleaning line cuts off, and the nearest of them.

    A line that cleans, from the source's own to the sink's own, cuts off.
    """
    text = F.col("text")
    flags = lines.where("text is not null").select(
        "file", "line_no", text.rlike(_any(LINE_SOURCES)).alias("source"), text.rlike(_any(LINE_SINKS)).alias("sink"), text.rlike(_any(LINE_CLEANERS)).alias("clean")
    ).where("source or sink or clean")
    known = running_sum(flags, F.col("source").cast("int"), "upto")
    # sources up to the last cleaning line, its own included, do not count
    known = carried_last(known, F.when(F.col("clean"), F.col("upto")), "cut")
    known = carried_last(known, F.when(F.col("source"), F.col("line_no")), "nearest")
    return known.where("sink and not clean").withColumn("sources", (F.col("upto") - F.coalesce("cut", F.lit(0))).cast("int")).where("sources > 0").select("file", "line_no", "sources", "nearest")
