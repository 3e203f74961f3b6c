"""Relations between the parts of a code base: joins of lines, files, functions, settings and dependencies.

Defined results: null texts take part in nothing; comparisons of names mind the case unless said otherwise; of several equally
good partners the one with the smallest (file, line) is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.scan import language_of
from siftline.operators.sequences import first_within

#: Names of entities that say nothing.
GENERIC_ENTITIES = ("entity", "obj", "object", "data", "item", "value", "model", "dto", "vo")
#: Marks of a page that asks who is there.
PAGE_GUARDS = (
    r"\bwith(?:Auth|Login|Role|Permission)\w*\s*\(\s*\w+\s*\)", r"\brequire(?:Auth|Login|Role|Permission)\s*\(\s*\w+\s*\)", r"\b@?(?:WithAuth|RequireAuth|LoginRequired)\b",
    r"\buse(?:Auth|User|Session|IsAuthenticated)\s*\(\s*\)", r"<\s*(?:ProtectedRoute|AuthGuard|RequireAuth|RequireRole|RequirePermission|PrivateRoute|Gate|Can)(?:\s[^>]*)?>",
    r"\bhasPermission\s*\(\s*['\"][\w:]+['\"]\s*\)", r"\bcan\s*\(\s*['\"][\w:]+['\"]\s*\)", r"\b(?:checkRole|hasRole)\s*\(\s*['\"]\w+['\"]\s*\)", r"\bisAdmin\s*\(\s*\)", r"\bisAuthenticated\s*\(\s*\)",
    r"export\s+(?:default\s+)?function\s+middleware\s*\(", r"getServerSideProps\s*[=(]",
)
#: Folders whose files are pages.
PAGE_FOLDERS = ("pages", "app")
#: Packages that are no longer kept up, with what to use.
DEPRECATED = {
    "boto": "boto3", "distutils": "packaging or setuptools", "nose": "pytest", "mock": "unittest.mock", "pathlib2": "pathlib", "subprocess32": "subprocess", "pysqlite": "sqlite3",
    "ConfigParser": "configparser", "urllib2": "urllib.request",
}
#: Names that are often mistyped on purpose, with what is meant.
TYPOSQUATS = {
    "reqeusts": "requests", "python-dateitme": "python-dateutil", "pymsql": "pymysql", "djang": "django", "cryptograpyh": "cryptography", "boto": "boto3", "openai-api": "openai",
}
#: Runtimes that are no longer supported, and licences that bind.
ENDED = {"python": ("3.7", "3.8", "3.9"), "node": ("v10", "v12", "v14", "v16", "v18")}
RESTRICTIVE = ("GPL", "GPLv2", "GPLv3", "AGPL", "LGPL", "CC-BY-NC", "CC-BY-SA", "SSPL", "BUSL")

URL_OF_DELETION = r"(?i)[`\"'][^`\"']*(?:delete|remove|destroy|purge)[^`\"']*[`\"']"
UPDATE_WRAPPER = r"\b(?:updateData|updateRecord|saveData|patchData|postData|createData|submitData)\s*\("
LITERAL = r"[\"']([^\"'\s]{3,})[\"']"
SETTING = r"^\s*(\w[\w._-]*)\s*[:=]\s*[\"']?([^\"'\s#;,(){}]+)[\"']?\s*[;,]?\s*$"
WRITES = r"\b(\w+?)(?:Repository|Repo|Dao)\.(?:save|saveAll|insert|persist|create|store|add|merge|update|write)\s*\("
READS = r"\b(\w+?)(?:Repository|Repo|Dao)\.(?:find\w*|get\w*|read\w*|load\w*|query\w*|list\w*|count\w*|exists\w*|search\w*|fetch\w*|select\w*)\s*\("


def deletions_by_update(lines: DataFrame) -> DataFrame:
    """(file, line_no, call_line): lines with the address of a deletion, and the first update wrapper called in the next 30 lines."""
    text = F.col("text")
    found = first_within(lines.where(text.rlike(URL_OF_DELETION) | text.rlike(UPDATE_WRAPPER)), text.rlike(URL_OF_DELETION), text.rlike(UPDATE_WRAPPER), 30, "call_line")
    return found.select("file", "line_no", "call_line")


def literals_in_settings(lines: DataFrame, settings: DataFrame) -> DataFrame:
    """(file, line_no, literal, key): literals that the value of a setting repeats; of several keys the first."""
    used = lines.select("file", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(LITERAL), F.lit(1)))).alias("literal"))
    return used.join(settings.groupBy(F.col("value").alias("literal")).agg(F.min("key").alias("key")), "literal").select("file", "line_no", "literal", "key")


def settings_of(lines: DataFrame) -> DataFrame:
    """(file, line_no, key, value) of lines that set a value, unless it is taken from elsewhere."""
    t = F.col("text")
    rows = lines.where(t.rlike(SETTING)).select("file", "line_no", F.lower(F.regexp_extract(t, SETTING, 1)).alias("key"), F.regexp_extract(t, SETTING, 2).alias("value"))
    return rows.where("not value like '$%' and not value like '{%'")


def written_never_read(lines: DataFrame, least: int = 2) -> DataFrame:
    """(entity, writes, file, line_no): entities that are stored in at least ``least`` places and read nowhere, with the first place."""
    def names(pattern: str) -> DataFrame:
        named = lines.where(F.col("text").rlike(pattern)).select("file", "line_no", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("e"))
        return named.select("file", "line_no", F.lower("e").alias("entity"))

    written = names(WRITES).where(~F.col("entity").isin(*GENERIC_ENTITIES))
    counts = written.groupBy("entity").agg(F.count(F.lit(1)).alias("writes"), F.min(F.struct("file", "line_no")).alias("at")).where(F.col("writes") >= least)
    return counts.join(names(READS).select("entity").distinct(), "entity", "left_anti").select("entity", "writes", "at.file", "at.line_no")


def pages_without_guard(lines: DataFrame) -> DataFrame:
    """(file) of script files in a folder of pages in which no line asks who is there."""
    pages = lines.where(F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, PAGE_FOLDERS))) & language_of(F.col("file")).isin("javascript", "typescript"))
    guarded = F.bool_or(F.coalesce(F.col("text").rlike("|".join(f"(?:{p})" for p in PAGE_GUARDS)), F.lit(False)))
    return pages.groupBy("file").agg(guarded.alias("guarded")).where("not guarded").select("file")


def inconsistent_use(lines: DataFrame, direct: str, made: str, own: str, least: int = 3) -> DataFrame:
    """(file, line_no): the first direct use in files that neither make nor use an instance of their own, in a code base of at least ``least`` direct files and one instance.

    The base's two numbers are one row and travel to every file.
    """
    t = F.col("text")
    files = lines.groupBy("file").agg(
        F.min(F.when(t.rlike(direct), F.col("line_no"))).alias("line_no"), F.bool_or(F.coalesce(t.rlike(made), F.lit(False))).alias("makes"), F.bool_or(F.coalesce(t.rlike(own), F.lit(False))).alias("owns")
    )
    base = files.agg(F.count("line_no").alias("directs"), F.count_if("makes").alias("makers"))
    found = files.crossJoin(F.broadcast(base))  # one row
    return found.where((F.col("directs") >= least) & (F.col("makers") >= 1) & F.col("line_no").isNotNull() & ~F.col("makes") & ~F.col("owns")).select("file", "line_no")


def untested_functions(functions: DataFrame, tests: DataFrame) -> DataFrame:
    """(file, name, tested): functions with whether the test file of their file, tests/test_<name>, mentions them.

    ``tests`` has (file, content).
    """
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[A-Za-z]+$", 1)
    t = tests.where(F.col("file").rlike(r"(?:^|/)tests?/test_[^/]+$")).select(F.regexp_replace(stem(F.col("file")), "^test_", "").alias("stem"), "content")
    j = functions.withColumn("stem", stem(F.col("file"))).join(t, "stem", "left")
    mentioned = F.coalesce(F.bool_or(F.col("content").contains(F.col("name"))), F.lit(False))
    return j.groupBy("file", "name").agg(mentioned.alias("tested"))


def reachable_advisories(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, reachable, places): advisories of used packages with whether a line calls one of their functions, and how many do; without known functions they count as reachable.

    ``found`` has (id, functions array); a call's name is looked up, so no function is searched in every file.
    """
    calls = lines.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][\w.]*)\s*\("), F.lit(1)))).alias("call"))
    counts = calls.groupBy("call").agg(F.count(F.lit(1)).alias("n"))
    asked = found.select("id", F.explode("functions").alias("call"))
    places = asked.join(counts, "call").groupBy("id").agg(F.sum("n").alias("places"))
    j = found.select("id", F.coalesce(F.size("functions"), F.lit(0)).alias("known")).join(places, "id", "left")
    return j.select("id", (F.col("places").isNotNull() | (F.col("known") <= 0)).alias("reachable"), F.coalesce("places", F.lit(0)).alias("places"))


def dependency_health(dependencies: DataFrame) -> DataFrame:
    """(name, version, ecosystem, problem): packages that are given up, mistyped, or under a binding licence, and runtimes that have ended.

    A ``licence`` column is optional.
    """
    from siftline.schema import lookup

    name = F.col("name")
    licence = F.upper(F.coalesce(F.col("licence"), F.lit(""))) if "licence" in dependencies.columns else F.lit("")
    bound = F.lit(False)
    for x in RESTRICTIVE:
        bound = bound | licence.contains(x.upper())
    ended = F.lit(False)
    for runtime, versions in ENDED.items():
        ended = ended | ((F.lower(name) == runtime) & F.col("version").isin(*versions))
    problems = F.array_compact(F.array(
        F.concat(F.lit("deprecated: "), lookup(name, DEPRECATED)), F.concat(F.lit("mistyped: "), lookup(F.lower(name), TYPOSQUATS)), F.when(bound, "licence"), F.when(ended, "ended")
    ))
    return dependencies.select("name", "version", "ecosystem", F.explode(problems).alias("problem"))


def grown(old: DataFrame, new: DataFrame, key: str, size: str, factor: float = 1.5) -> DataFrame:
    """(key, before, now): keys whose size grew by more than a factor between two snapshots."""
    a, b = old.select(key, F.col(size).alias("before")), new.select(key, F.col(size).alias("now"))
    return a.join(b, key).where((F.col("before") > 0) & (F.col("now") > F.col("before") * factor))


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The nodes that fit a query best: 3 for the name, 2 for the summary, 1 for the file, case aside; of equals the first by name, file and line."""
    q = query.lower()
    has = lambda c, n: F.when(F.lower(F.coalesce(c, F.lit(""))).contains(q), n).otherwise(0)
    score = has("name", 3) + has("summary", 2) + has("file", 1)
    return nodes.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), "name", "file", "line").limit(limit)


def endpoint(url: Column) -> Column:
    """The path of an address without query and place holders."""
    path = F.when(url.contains("://"), F.concat(F.lit("/"), F.regexp_extract(url, r"://[^/]*/(.*)$", 1))).otherwise(url)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.regexp_replace(F.split(path, r"\?")[0], r"\{[^}]+\}", "")


#: What names and addresses say is done; our own selection of synonyms.
ACTIONS = {
    "create": ("create", "add", "insert", "new", "register"), "update": ("update", "edit", "modify", "change", "patch"), "delete": ("delete", "remove", "destroy", "purge"), "read": ("get", "fetch", "load", "list", "find", "read"),
    "login": ("login", "signin", "authenticate"), "logout": ("logout", "signout"), "pay": ("pay", "charge", "checkout"), "refund": ("refund", "reimburse"), "send": ("send", "notify", "mail"), "upload": ("upload", "import"), "download": ("download", "export"),
}


def action_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for action, words in reversed(list(ACTIONS.items())):
        out = F.when(F.lower(text).rlike("|".join(words)), action).otherwise(out)
    return out


def mismatched_endpoints(lines: DataFrame, function: str = "function") -> DataFrame:
    """(file, line_no, function, endpoint): addresses of an interface whose action differs from that of the function that calls them."""
    path = r"[\"'](/(?:api|v\d+)/[^\s\"']+)[\"']"
    rows = lines.select("file", "line_no", function, F.explode(F.regexp_extract_all("text", F.lit(path), F.lit(1))).alias("url")).withColumn("endpoint", endpoint(F.col("url")))
    a, b = action_of(F.col(function)), action_of(F.col("endpoint"))
    return rows.where(a.isNotNull() & b.isNotNull() & (a != b)).select("file", "line_no", F.col(function).alias("function"), "endpoint").distinct()


def thresholds(lines: DataFrame) -> DataFrame:
    """(file, line_no, value): whole numbers beyond small ones that a condition compares with."""
    p = r"\bif\s*\(?[\w.\[\]]+\s*[<>=!]+\s*(\d+)(?![\d.])"
    rows = lines.select("file", "line_no", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("v"))
    return rows.select("file", "line_no", F.col("v").cast("long").alias("value")).where("value > 4").distinct()


def refactor_pairs(functions: DataFrame) -> DataFrame:
    """(file, old, new): functions with the same parameters whose names differ by a mark of a newer or older version."""
    marks = r"(?:_new|_v2|_old|_optimized|_fast|_legacy|_refactored)$"
    f = functions.withColumn("stem", F.regexp_replace("name", marks, ""))
    marked = f.where(F.col("stem") != F.col("name")).select("file", "stem", "parameters", F.col("name").alias("new"))
    plain = f.where(F.col("stem") == F.col("name")).select("file", "stem", "parameters", F.col("name").alias("old"))
    return marked.join(plain, ["file", "stem", "parameters"]).select("file", "old", "new").distinct()


def contract_breaches(contracts: DataFrame, calls: DataFrame) -> DataFrame:
    """(function, file, line, condition, caller_file, caller_line): calls whose first argument is a constant that a precondition rules out.

    ``contracts`` has (function, file, line, kind, condition), ``calls`` (callee, file, line, first); ``first`` is the constant as text.
    """
    pre = contracts.where("kind = 'pre'").select("function", "file", "line", "condition")
    c = calls.where("first is not null").select(F.col("callee").alias("function"), F.col("file").alias("caller_file"), F.col("line").alias("caller_line"), "first")
    j = pre.join(c, "function")
    positive = F.col("condition").rlike(r"x > 0|x >= 1") & (F.try_to_number(F.when(F.col("first").rlike(r"^-?\d+(?:\.\d+)?$"), F.col("first")), F.lit("S999999999999999.999")) <= 0)
    present = F.col("condition").rlike(r"x is not None|x != None") & (F.col("first") == "None")
    return j.where(F.coalesce(positive, F.lit(False)) | F.coalesce(present, F.lit(False))).drop("first")


#: Our own words for what a function's name promises, with the relations its results should keep.
RELATIONS = {
    "sort": ("idempotent", "same-elements"), "order": ("idempotent", "same-elements"), "reverse": ("involution", "same-elements"), "shuffle": ("same-elements",), "abs": ("idempotent", "non-negative"),
    "normali": ("idempotent",), "trim": ("idempotent",), "strip": ("idempotent",), "upper": ("idempotent",), "lower": ("idempotent",), "encode": ("round-trip",), "decode": ("round-trip",),
    "serial": ("round-trip",), "parse": ("round-trip",), "add": ("commutative",), "sum": ("commutative", "additive"), "mul": ("commutative",), "max": ("commutative", "idempotent"), "min": ("commutative", "idempotent"),
    "count": ("non-negative", "additive"), "len": ("non-negative",), "filter": ("idempotent", "subset"), "distinct": ("idempotent", "subset"), "merge": ("associative",), "hash": ("deterministic",), "scale": ("homogeneous",),
}


def relations_of(name: Column) -> Column:
    """Relations that a function's results should keep, by its name, in the order of the table."""
    out = [F.when(F.lower(name).contains(word), F.lit(r)) for word, rs in RELATIONS.items() for r in rs]
    return F.array_distinct(F.array_compact(F.array(*out)))


PROTOTYPE = r"^\s*(?:extern\s+)?([A-Za-z_][\w\s]*?[\s*]+)(\w+)\s*\(([^()]*)\)\s*;"


def prototypes(lines: DataFrame) -> DataFrame:
    """(function, position, type): parameters of C functions that header lines declare, without their names."""
    t = F.col("text")
    rows = lines.where(t.rlike(PROTOTYPE)).select(F.regexp_extract(t, PROTOTYPE, 2).alias("function"), F.posexplode(F.split(F.regexp_extract(t, PROTOTYPE, 3), r"\s*,\s*")).alias("position", "p"))
    kind = F.regexp_replace(F.regexp_replace(F.btrim("p"), r"\b\w+$", ""), r"\bconst\b|\s+", "")
    return rows.select("function", "position", F.when(kind == "", F.btrim("p")).otherwise(kind).alias("type")).where("type not in ('', 'void')").distinct()


def foreign_arguments(declared: DataFrame, facts: DataFrame) -> DataFrame:
    """(file, line, function, position, given, type): constants passed to foreign functions whose declared parameter is of another kind."""
    given = facts.where("kind = 'constant'").select("file", "line", F.element_at(F.split("name", r"\."), -1).alias("function"), "position", F.col("detail").alias("given"))
    kind = F.when(F.col("given").rlike(r"^['\"]"), "text").when(F.col("given").rlike(r"^-?\d+$"), "whole").when(F.col("given").rlike(r"^-?\d*\.\d+$"), "real").when(F.col("given") == "None", "null")
    want = F.when(F.col("type").rlike(r"^char\*$"), "text").when(F.col("type").contains("*"), "pointer").when(F.col("type").rlike(r"^(?:float|double)$"), "real").otherwise("whole")
    j = given.join(declared, ["function", "position"]).withColumns({"a": kind, "b": want})
    fine = (F.col("a") == F.col("b")) | ((F.col("a") == "whole") & (F.col("b") == "real")) | ((F.col("a") == "null") & F.col("b").isin("text", "pointer")) | ((F.col("a") == "text") & (F.col("b") == "pointer"))
    return j.where(F.col("a").isNotNull() & ~fine).select("file", "line", "function", "position", "given", "type").distinct()


#: Kinds of repair that messages of changes name; our own selection, the first that fits counts.
REPAIRS = {
    "injection": r"(?i)inject|unescaped|sanitiz", "null": r"(?i)\bnull\b|\bnone\b|missing value", "bounds": r"(?i)overflow|out of (?:range|bounds)|off.by.one", "race": r"(?i)\brace\b|deadlock|concurren", "leak": r"(?i)\bleak|not closed|unclosed",
    "access": r"(?i)permission|authoriz|access check", "secret": r"(?i)secret|password|credential", "crash": r"(?i)crash|exception|traceback", "other": r"(?i)\bfix(?:es|ed)?\b|\bbug\b|\brepair",
}


def repair_kind(message: Column) -> Column:
    """Kind of repair a change's message names, null for none."""
    out = F.lit(None).cast("string")
    for kind, p in reversed(list(REPAIRS.items())):
        out = F.when(message.rlike(p), kind).otherwise(out)
    return out


def line_form(text: Column) -> Column:
    """A line with its literals and numbers made equal: what a rule mined from it would look for."""
    plain = F.regexp_replace(F.regexp_replace(F.btrim(text), r"'[^']*'|\"[^\"]*\"|`[^`]*`", r"\$STRING"), r"\b\d+(?:\.\d+)?\b", r"\$NUMBER")
    return F.regexp_replace(plain, r"\s+", " ")


def mined_from_repairs(changes: DataFrame, least: int = 2) -> DataFrame:
    """(kind, form, changes): forms of lines that at least ``least`` repairs removed, from (change, message, removed)."""
    rows = changes.select("change", repair_kind(F.col("message")).alias("kind"), line_form(F.col("removed")).alias("form")).where("kind is not null and length(form) >= 4")
    return rows.groupBy("kind", "form").agg(F.countDistinct("change").alias("changes")).where(F.col("changes") >= least)
