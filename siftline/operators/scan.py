"""Rule scans over lines and texts.

A few rules are a projection of literal patterns: they compile once per task and stay inside generated code, cut into
blocks so that no generated method grows beyond the compiler's limit.  Many rules are matched batch by batch in
``siftline.operators.manyrules``, where one pass over the text finds the candidates of all rules at once.

Defined results: a null text has no hits; a rule without languages and paths fits every file, and a file whose
language is not known fits only those; a rule is reported once per line.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 100
#: From this number of rules on a scan searches for all of them in one pass.
MANY = 24

#: Languages by file extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "scala": "scala",
    "sh": "bash", "bash": "bash", "sql": "sql", "dart": "dart", "lua": "lua", "r": "r", "hs": "haskell", "ex": "elixir", "exs": "elixir", "m": "objectivec", "groovy": "groovy",
    "jl": "julia", "pl": "perl", "pm": "perl", "cob": "cobol", "cbl": "cobol",
}


@dataclass(frozen=True)
class Rule:
    """A line rule; ``needs`` is a literal that every match contains, ``languages`` are names or extensions, ``paths`` and ``skips`` parts of paths.

    ``hit`` and ``miss`` are lines that the rule must and must not match; § in them stands for a number that tells lines apart.
    """

    rule_id: str
    pattern: str
    severity: str = "medium"
    confidence: float = 0.7
    message: str = ""
    cwe: str = ""
    ignore_case: bool = False
    needs: str = ""
    languages: tuple[str, ...] = field(default_factory=tuple)
    paths: tuple[str, ...] = field(default_factory=tuple)
    skips: tuple[str, ...] = field(default_factory=tuple)
    hit: str = ""
    miss: str = ""

    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


def fold(text: str) -> str:
    """Lower case in which everything is equal that patterns without regard to case take as equal."""
    return text.lower().replace("\u017f", "s").replace("\u0131", "i")


def required_literals(pattern: str, ignore_case: bool = False) -> tuple[bool, frozenset[str]]:
    """(without regard to case, words): every match of the pattern contains one of the words; no words where none is sure."""
    try:
        from re import _constants as c
        from re import _parser
    except ImportError:  # the parser is no public part of the library
        return ignore_case, frozenset()
    folded = [ignore_case]

    def best(sets):
        return max(filter(None, sets), key=lambda ws: (min(map(len, ws)), -len(ws)), default=frozenset())

    def words(nodes) -> frozenset[str]:
        found, run = [], ""
        for op, arg in [*nodes, (None, None)]:
            if op is c.LITERAL and arg < 128:
                run += chr(arg)
                continue
            if run:
                found.append(frozenset([run]))
            run = ""
            if op is c.SUBPATTERN:
                folded[0] |= bool(arg[1] & 2)
                found.append(words(arg[3]))
            elif op is c.ATOMIC_GROUP:
                found.append(words(arg))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] >= 1:
                found.append(words(arg[2]))
            elif op is c.BRANCH:
                ways = [words(w) for w in arg[1]]
                found.append(frozenset().union(*ways) if all(ways) else frozenset())
        return best(found)

    try:
        parsed = _parser.parse(pattern)
    except Exception:  # Java knows forms that Python does not
        return ignore_case, frozenset()
    found = words(parsed)
    folded[0] |= bool(parsed.state.flags & 2)
    return folded[0], frozenset(map(fold, found)) if folded[0] else found


def language_of(file: Column) -> Column:
    """Language by a path's extension, null for an unknown one."""
    from siftline.schema import lookup

    return lookup(F.lower(F.regexp_extract(file, r"\.([A-Za-z]+)$", 1)), LANGUAGES)


def _in_scope(rule: Rule, file: Column) -> Column | None:
    """Whether a rule concerns a file; None where it concerns all."""
    out = None
    if rule.languages:
        ext = F.lower(F.regexp_extract(file, r"\.([A-Za-z]+)$", 1))
        out = ext.isin(*[e for e, n in LANGUAGES.items() if e in rule.languages or n in rule.languages], *rule.languages)
    for part in rule.skips:
        out = ~file.contains(part) if out is None else out & ~file.contains(part)
    if rule.paths:
        some = F.lit(False)
        for part in rule.paths:
            some = some | file.contains(part)
        out = some if out is None else out & some
    return out


def _fits(rule: Rule, text: Column, file: Column | None = None) -> Column:
    """The pattern behind a plain substring test, which turns most lines away far more cheaply."""
    hit = text.rlike(rule.regex())
    folded, words = required_literals(rule.pattern, rule.ignore_case)
    if rule.needs:
        hit = text.contains(rule.needs) & hit
    elif words and len(words) <= 4 and min(map(len, words)) >= 2:
        # Java's lower case leaves the long s and the dotless i as they are, and its patterns do not fold them either
        within = F.lower(text) if folded else text
        some = within.contains(sorted(words)[0])
        for w in sorted(words)[1:]:
            some = some | within.contains(w)
        hit = some & hit
    scope = None if file is None else _in_scope(rule, file)
    return hit if scope is None else scope & hit


def line_hits(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per line and rule that matches it, with rule_id, severity and confidence."""
    if len(rules) >= MANY:
        from siftline.operators.manyrules import many_hits

        return many_hits(lines, rules)
    text, file = F.col("text"), F.col("file") if "file" in lines.columns else None
    blocks = []
    for i in range(0, max(1, len(rules)), BLOCK):
        some = rules[i : i + BLOCK]
        blocks.append(F.array_compact(F.array(*[
            F.when(_fits(r, text, file), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"))) for r in some
        ])))
    found = F.concat(*blocks) if len(blocks) > 1 else blocks[0]
    return lines.withColumn("__hit", F.explode(found)).select(*lines.columns, "__hit.*")


def all_matches(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per distinct match of a rule in a line: adds rule_id, severity, confidence and value."""
    text = F.col("text")

    def matches(r: Rule) -> Column:
        pattern = f"(?i)({r.pattern})" if r.ignore_case else f"({r.pattern})"
        values = F.when(_fits(r, text), F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), v.alias("value")))

    per_rule = [matches(r) for r in rules]
    any_rule = _any(rules, text)
    return lines.where(any_rule).withColumn("__hit", F.explode(F.concat(*per_rule))).select(*lines.columns, "__hit.*")


def _any(rules: list[Rule], text: Column) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _fits(r, text)
    return out


def first_match(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per line that matches some rule: the first rule in their order."""
    text = F.col("text")
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(_fits(r, text), r.rule_id).otherwise(out)
    return lines.withColumn("rule_id", out).where("rule_id is not null")


def absent(texts: DataFrame, text: str, required: dict[str, str]) -> DataFrame:
    """One row per text and required literal (rule_id -> literal) that it does not contain, case aside."""
    low = F.lower(F.col(text))
    missing = F.array_compact(F.array(*[F.when(~low.contains(v.lower()), F.lit(k)) for k, v in required.items()]))
    return texts.where(F.col(text).isNotNull()).withColumn("rule_id", F.explode(missing))


def document_hits(texts: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """One row per text and multi-line rule that matches anywhere in it, with the number of matches."""
    c = F.col(text)
    hits = F.array_compact(F.array(*[
        F.when(_fits(r, c), F.struct(F.lit(r.rule_id).alias("rule_id"), F.regexp_count(c, F.lit(r.regex())).alias("matches"))) for r in rules
    ]))
    return texts.withColumn("__hit", F.explode(hits)).select(*texts.columns, "__hit.*")


def vetoed_matches(files: DataFrame, rules: list[Rule], veto: str, around: int = 500) -> DataFrame:
    """(file, line, rule_id, severity, confidence): matches in (file, content) near which, within so many characters, nothing fits the veto.

    Places in a text are needed, so batches of texts are searched by the workers; one file's text is looked at as a whole.
    """
    import re
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, against = [(r, re.compile(r.regex(), re.M)) for r in rules], re.compile(veto)
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r, p in found if text else ():
                    for m in p.finditer(text):
                        if not against.search(text, max(0, m.start() - around), m.end() + around):
                            rows.append((file, text.count("\n", 0, m.start()) + 1, r.rule_id, r.severity, r.confidence))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "line", "rule_id", "severity", "confidence"])

    return files.select("file", "content").mapInArrow(run, "file string, line int, rule_id string, severity string, confidence double")


#: Patterns that match nearly everything, with the reason.
BROAD = (
    (r"^\.\*\??$", "matches everything"),
    (r"^\.\*\??\$?$", "only a wildcard"),
    (r"^[a-z_]\w*$", "matches any single identifier"),
)


def lint(rules: list[Rule]) -> list[tuple[str, str]]:
    """(rule_id, problem): patterns that are missing, match the empty line, are broad or very short, or do not compile."""
    import re

    out = []
    for r in rules:
        try:
            broad = next((reason for p, reason in BROAD if re.match(p, r.pattern)), None)
            if not r.pattern:
                out.append((r.rule_id, "no pattern"))
            elif broad:
                out.append((r.rule_id, broad))
            elif re.search(r.regex(), "") is not None:
                out.append((r.rule_id, "matches every line"))
            elif len(r.pattern) < 4 and not r.pattern.startswith("\\"):
                out.append((r.rule_id, "very short"))
        except re.error:
            out.append((r.rule_id, "does not compile"))
    return out


def tested(rules: list[Rule], cases: list[tuple[str, str, bool]] | None = None) -> list[tuple[str, str, bool, bool]]:
    """(rule_id, code, expected, actual) of test cases (rule_id, code, should match); of the rules' own lines where none are given."""
    import re

    by_id = {r.rule_id: re.compile(r.regex()) for r in rules}
    own = [(r.rule_id, code.replace("§", "1"), want) for r in rules for code, want in ((r.hit, True), (r.miss, False)) if code]
    return [(i, code, want, i in by_id and by_id[i].search(code) is not None) for i, code, want in (own if cases is None else cases)]
