"""Lines of code made from the issues table, and the queries over them.

The driver's texts hold little code, so a line is made for every place of an issue: a template chosen by line number and message
length, with the line number in it.  Spark and SQL make the same lines, one per (file, line), so every rule has hits and they grow
with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import codebase as cb
from siftline.operators import dataflow, fixes, metrics, scan
from siftline.operators import detectors as d
from siftline.operators import triage as t
from siftline.queries.base import table
from siftline.rules import packs
from siftline.rules.apis import APIS

Q: dict = {}
SQL: dict = {}
MARKER = "siftline"

_EXT = {"python": "py", "javascript": "js", "typescript": "ts", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "csharp": "cs", "kotlin": "kt"}


def _of_rules() -> list[tuple[str, str]]:
    tables = (d.SECRETS, d.MINI_SAST, d.LOGS, d.LOG_SOURCES, d.CONFIG, d.INFRASTRUCTURE, d.POLICY, d.QUALITY, d.FAMILIES, d.MORE, [d.OVERFLOW])
    out = []
    for rules in tables:
        for r in rules:
            ext = _EXT[r.languages[0]] if r.languages else ".env" if r.paths else "txt"
            out += [(ext, x) for x in (r.hit, r.miss) if x]
    return out


#: (extension, template) of lines; § stands for the line number.
SAMPLES: list[tuple[str, str]] = [
    *_of_rules(),
    # personal data
    ("txt", "mail: user§@example.org"), ("txt", "mail user§@example.org and other§@example.org"), ("txt", "phone 555-010-1§"), ("txt", "card 4111 1111 1111 1111 of §"), ("txt", "card 5500 0000 0000 0004 of §"),
    ("txt", "card 3400 000000 00009 of §"), ("txt", "card 6011 0000 0000 0004 of §"), ("txt", "iban DE44500105175407324931 §"), ("txt", "born 01/31/1980 (§)"), ("txt", "host 10.0.0.7 port §"), ("txt", "zip 12345-6789 §"),
    ("txt", "passport A12345678 §"), ("txt", "nino AB123456C §"), ("txt", "call +49 123 456 78901 §"), ("txt", "id 1234 5678 9012 §"), ("txt", "ssn 123-45-6789 §"), ("txt", "ssn 000-45-6789 §"),
    # C functions
    *[("c", f"{name}(buf§, src);") for name in d.C_CALLS],
    # malicious behaviour
    *[("py", x) for x in (
        "setup.py: urllib.request.urlretrieve(u§)", "setup.py requests.get(u§)", "setup.py subprocess curl §", "k = read('~/.ssh/id_rsa') # §", "k = read('~/.ssh/id_ed25519') # §", "open(home + '/.ssh/k§')", "p = '~/.aws/credentials' # §",
        "p = '~/.aws/config' # §", "open('.env') # §", "open('a/§.env')", "load_dotenv(); dotenv.load() # §", "requests.get(u§)", "requests.post(u§)", "socket.connect(a§)", "subprocess.run(c§)", "os.system(c§)", "os.popen(c§)",
        "eval(base64.b64decode(x§))", "exec(base64.b64decode(x§))", "exec(b§.decode('x'))", "eval(bytes.fromhex(h§))", "open('/etc/x§', 'w')", "open('/var/spool/cron/§')", "sh('crontab § -e')", "os.chmod('/etc/x§', 1)",
        "open('~/.bashrc') # §", "sh('systemctl § enable')", "__builtins__['p§'] = f", "builtins.open = f§", "requests.post(u, open('.ssh/§'))", "socket.send(os.environ['§'])")],
    # suppression comments beside what they suppress
    ("py", "v§ = eval(x)  # siftline: ignore"), ("py", "v§ = eval(x)  # siftline: ignore[py-eval] -- checked"), ("py", "w§ = 1  # noqa: siftline=py-exec"), ("py", "u§ = 2  # pylint: disable=siftline-py-sql"), ("js", "// siftline: ignore[js-] -- next line §"),
    # foreign data and what is done with it
    ("js", "const a§ = req.query.name;"), ("js", "const b§ = window.location.hash;"), ("js", "box.innerHTML = a§;"), ("js", "document.write(b§);"), ("js", "const c§ = parseInt(req.query.n);"), ("js", "eval(req.body.code§);"), ("js", "const d§ = DOMPurify.sanitize(x);"),
    ("js", "call('/api/rows/delete/§');"), ("js", "updateData(row§);"), ("js", "axios.get('/v1/orders/§');"), ("js", "const http§ = axios.create({});"), ("js", "apiClient.send(§);"), ("js", "axios.post(url§, body)"), ("js", "}, {timeout: 10§})"),
    ("java", "orderRepository.save(order§);"), ("java", "auditRepository.save(audit§);"), ("java", "orderRepository.findById(id§);"), ("java", "auditRepo.insert(a§);"), ("java", "userDao.findAll(p§);"), ("java", "if (count > §) {"),
    ("py", "limit_a = 'gold-§'"), ("txt", "tier = gold-17"), ("txt", "region: eu-west-§"), ("txt", "mode = fast"), ("py", "m§ = pick('fast')"), ("py", "if size > §:"), ("py", "def load_orders§(a, b):"), ("py", "    return fetch('/api/delete/§')"),
    ("js", "function deleteRow§(id) {"), ("js", "  send('/api/update/row§');"), ("js", "const user = useAuth(); // §"), ("js", "return <div>{page§}</div>;"),
    # missing patches
    ("py", "d§ = yaml.load(text)"), ("py", "d§ = yaml.full_load(text)"), ("py", "t§ = paramiko.Transport(host)"), ("js", "o§ = defaultsDeep(a, b)"), ("js", "f§ = _.template(t)"), ("java", "new BeanWrapperImpl(b§);"), ("java", "InvokerTransformer t§;"),
    ("java", "HttpInvokerServiceExporter e§;"), ("java", "JakartaMultiPartRequest r§;"),
    # tests before use, and business risks
    ("java", "if (f§.exists()) { f§.delete(); }"), ("js", "if (fs.existsSync(p§)) { fs.unlinkSync(p§); }"), ("java", "if (!m§.containsKey(k)) { m§.put(k, v); }"), ("js", "try { f§() } catch (e) { return { error: e }; }"), ("java", "try { l§.lock(); f(); } finally { }"),
    ("js", "useEffect(() => { f§() }, [{a: 1}])"), ("js", "amount = req.body.amount§"), ("js", "refundOrder§(order)"), ("java", "balance -= cost§;"), ("js", "rows.deleteMany(§)"),
    # comments and blanks
    ("py", "# note § of a run"), ("py", "# another note §"), ("py", ""), ("js", "// note §"), ("java", "/* note § */"), ("py", "x§ = 'A9fk3LmQ0zX7bT2vR8sW'"), ("py", "label§ = 'repeated literal'"), ("py", "other§ = 'repeated literal'"),
]
_N = len(SAMPLES)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CODE_SQL = f"""
samples(n, ext, t) as (values {', '.join(f"({i}, {_text(e)}, {_text(x)})" for i, (e, x) in enumerate(SAMPLES))}),
places as (select file, line line_no, min(length(message)) m from issues where file is not null and line is not null and message is not null group by 1, 2),
code as (select case when ext = '.env' then regexp_replace(file, '[^/]+$', '.env') else regexp_replace(file, '\\.[A-Za-z]+$', '') || '.' || ext end file, line_no, replace(t, '§', cast(line_no as varchar)) as text
  from places join samples on (line_no * 31 + m) % {_N} = n)"""


def code(spark, sf) -> DataFrame:
    """(file, line_no, text): the made lines."""
    places = table(spark, sf, "issues").where("file is not null and line is not null and message is not null").groupBy("file", F.col("line").alias("line_no")).agg(F.min(F.length("message")).alias("m"))
    samples = spark.createDataFrame([(i, e, x) for i, (e, x) in enumerate(SAMPLES)], "n int, ext string, t string")
    j = places.join(F.broadcast(samples), (F.col("line_no") * 31 + F.col("m")) % _N == F.col("n"))  # the templates are a constant
    name = F.when(F.col("ext") == ".env", F.regexp_replace("file", "[^/]+$", ".env")).otherwise(F.concat(F.regexp_replace("file", r"\.[A-Za-z]+$", ""), F.lit("."), "ext"))
    return j.select(name.alias("file"), "line_no", F.replace("t", F.lit("§"), F.col("line_no").cast("string")).alias("text"))


def files_of(lines: DataFrame) -> DataFrame:
    """(file, content) of lines, in blocks of 2,000 line numbers, so that no file becomes one cell however many lines it has."""
    blocks = lines.groupBy("file", F.floor(F.col("line_no") / 2000).alias("block")).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    return blocks.select("file", "block", F.array_join(F.col("ls.text"), "\n").alias("content"))


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _scope_sql(r: scan.Rule) -> str:
    parts = []
    if r.languages:
        exts = sorted({e for e, n in scan.LANGUAGES.items() if e in r.languages or n in r.languages} | set(r.languages))
        parts.append(f"lower(regexp_extract(file, '\\.([A-Za-z]+)$', 1)) in ({', '.join(map(_text, exts))})")
    parts += [f"not contains(file, {_text(x)})" for x in r.skips]
    if r.paths:
        parts.append("(" + " or ".join(f"contains(file, {_text(x)})" for x in r.paths) + ")")
    return "".join(f" and {p}" for p in parts)


def hits_sql(rules, source: str = "code") -> str:
    return " union all ".join(
        f"select file, line_no, {_text(r.rule_id)} rule_id, '{r.severity}' severity, cast({r.confidence} as double) confidence from {source} where regexp_matches(text, {_text(r.regex())}){_scope_sql(r)}" for r in rules
    )


def plain(rules):
    """Rules without look-around, which the SQL engine's patterns lack."""
    return [r for r in rules if "(?!" not in r.pattern and "(?<" not in r.pattern]


def _rules_query(name, rules, doc):
    def run(spark, sf):
        return scan.line_hits(code(spark, sf), rules).select("file", "line_no", "rule_id", "severity", "confidence")

    run.__name__, run.__doc__ = name, doc
    Q[name], SQL[name] = run, f"with {CODE_SQL} {hits_sql(rules)}"


_rules_query("scan_secrets", d.SECRETS, "Secret material, one hit per line and rule.")
_rules_query("scan_mini_sast", d.MINI_SAST, "The small table of code patterns, by language.")
_rules_query("scan_config", plain(d.CONFIG), "Risky settings, one hit per line and rule.")
_rules_query("scan_infrastructure", plain(d.INFRASTRUCTURE), "Risky infrastructure definitions, one hit per line and rule.")
_rules_query("scan_malicious", d.MALICIOUS, "Malicious behaviour in Python, one hit per line and rule.")
_rules_query("scan_policy", d.POLICY, "Policy violations, one hit per line and rule.")
_rules_query("scan_quality", plain(d.QUALITY), "Marks of poor code by language.")
_rules_query("scan_families", plain(d.FAMILIES), "One defect in several languages.")
_rules_query("scan_more", plain(d.MORE), "Concurrency, cryptography and script rules.")


@query()
def scan_with_lookaround(spark, sf):
    """Rules whose patterns look around, which the SQL engine's patterns lack."""
    rules = [r for r in (*d.CONFIG, *d.INFRASTRUCTURE, *d.QUALITY, *d.FAMILIES, *d.MORE) if r not in plain([r])]
    return scan.line_hits(code(spark, sf), rules).select("file", "line_no", "rule_id", "severity", "confidence")


@query(f"with {CODE_SQL} select file, line_no, fn, case fn " + " ".join(f"when '{k}' then {v}" for k, v in d.C_CALLS.items()) + f" end as risk from (select file, line_no, unnest(list_distinct(regexp_extract_all(text, '{d.C_PATTERN}', 1))) as fn from code where regexp_matches(file, '\\.(?:c|cc|cpp|cxx|h|hpp|hxx)$'))")
def scan_c_calls(spark, sf):
    """Dangerous C calls: one alternation of all names, one hit per line and function."""
    from siftline.schema import lookup

    found = code(spark, sf).where(F.col("file").rlike(r"\.(?:c|cc|cpp|cxx|h|hpp|hxx)$") & F.col("text").rlike(d.C_PATTERN))
    found = found.withColumn("fn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(d.C_PATTERN), F.lit(1)))))
    return found.select("file", "line_no", "fn", lookup(F.col("fn"), d.C_CALLS, 0).alias("risk"))


def _pii():
    return [r for r in d.PII if r.rule_id != "ssn"]


_CASE_PII = " ".join(f"when '{r.rule_id}' then {r.confidence}" for r in d.PII)
_PII = " union all ".join(f"select file, line_no, '{r.rule_id}' rule_id, unnest(list_distinct(regexp_extract_all(text, {_text(r.regex())}))) as value from code" for r in _pii())


@query(f"with {CODE_SQL} select rule_id pii_type, count(*) n, count(distinct file) files from ({_PII}) group by 1")
def scan_pii(spark, sf):
    """Personal data: every distinct match in a line, by type."""
    hits = scan.all_matches(code(spark, sf), _pii())
    return hits.groupBy(F.col("rule_id").alias("pii_type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


@query(f"with {CODE_SQL}, v as (select file, line_no, unnest(list_distinct(regexp_extract_all(text, '\\b\\d{{3}}[-\\s]?\\d{{2}}[-\\s]?\\d{{4}}\\b'))) as value from code), w as (select *, regexp_replace(value, '[-\\s]', '', 'g') g from v) select file, line_no, 'XXX-XX-' || right(value, 4) masked from w where left(g, 3) not in ('000', '666') and left(g, 1) <> '9' and g[4:5] <> '00' and right(g, 4) <> '0000'")
def scan_pii_ssn(spark, sf):
    """Personal numbers, whose pattern looks ahead; the SQL tests the parts instead."""
    hits = scan.all_matches(code(spark, sf), [d.PII[0]])
    return hits.select("file", "line_no", d.mask(F.col("value"), F.col("rule_id")).alias("masked"))


_MASK = """case when length(value) <= 4 then repeat('*', length(value))
  when rule_id = 'email' and contains(value, '@') then repeat('*', instr(value, '@') - 1) || substr(value, instr(value, '@'))
  when contains(rule_id, 'credit_card') then repeat('*', length(value) - 4) || right(value, 4)
  else left(value, 2) || repeat('*', length(value) - 4) || right(value, 2) end"""


@query(f"with {CODE_SQL} select file, line_no, rule_id, {_MASK} masked from ({_PII})")
def pii_mask(spark, sf):
    """Masked display form of every personal value."""
    hits = scan.all_matches(code(spark, sf), _pii())
    return hits.select("file", "line_no", "rule_id", d.mask(F.col("value"), F.col("rule_id")).alias("masked"))


@query(f"with {CODE_SQL}, v as (select *, case rule_id {_CASE_PII} end * case when contains(lower(file), 'test') then 0.5 else 1.0 end c from ({_PII}) where file not like '%.env.example') select rule_id pii_type, case when c >= 0.8 then 'high' when c >= 0.5 then 'medium' else 'low' end band, count(*) n from v group by all")
def pii_stats_by_type_band(spark, sf):
    """Counts of personal data by type and confidence band; files of tests count half, example settings not at all."""
    hits = scan.all_matches(code(spark, sf), _pii()).where("file not like '%.env.example'")
    c = F.col("confidence") * F.when(F.lower("file").contains("test"), 0.5).otherwise(1.0)
    band = F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")
    return hits.groupBy(F.col("rule_id").alias("pii_type"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


_HOT = " union all ".join(f"select file, line_no, '{c}' category, {_text(w)} word from code where contains(text, {_text(w)}) and {lang}" for l, cs in d.HOTSPOTS.items() for c, ws in cs.items() for w in ws for lang in [
    f"lower(regexp_extract(file, '\\.([A-Za-z]+)$', 1)) in ({', '.join(_text(e) for e, n in scan.LANGUAGES.items() if n == l or (l == 'javascript' and n == 'typescript'))})"])


@query(f"with {CODE_SQL} select category, word, count(*) n, count(distinct file) files from ({_HOT}) group by all")
def hotspot_substring(spark, sf):
    """Substring tables against lines of their language."""
    language = F.when(scan.language_of(F.col("file")) == "typescript", "javascript").otherwise(scan.language_of(F.col("file")))
    ways = [F.when((F.col("l") == l) & F.col("text").contains(w), F.struct(F.lit(c).alias("category"), F.lit(w).alias("word"))) for l, cs in d.HOTSPOTS.items() for c, ws in cs.items() for w in ws]
    hits = code(spark, sf).withColumn("l", language).select("file", F.explode(F.array_compact(F.array(*ways))).alias("h"))
    return hits.groupBy("h.category", "h.word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


@query(f"with {CODE_SQL} select rule_id, count(*) n from (select case " + " ".join(f"when regexp_matches(text, {_text(r.regex())}) then '{r.rule_id}'" for r in d.LOGS) + " end rule_id from code) where rule_id is not null group by 1")
def log_first_match(spark, sf):
    """Log lines classified by the first rule that fits."""
    return scan.first_match(code(spark, sf), d.LOGS).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CODE_SQL} select file, line_no from code where regexp_matches(text, {_text(d.OVERFLOW.pattern)}) and not regexp_matches(text, {_text(d.OVERFLOW_VETOES)}){_scope_sql(d.OVERFLOW)}")
def integer_overflow(spark, sf):
    """Arithmetic that may wrap, unless something in the line vetoes it."""
    return scan.line_hits(code(spark, sf), [d.OVERFLOW]).where(~F.col("text").rlike(d.OVERFLOW_VETOES)).select("file", "line_no")


_PATCH = " union all ".join(f"select '{c}' cve, file, min(line_no) line_no from code where regexp_matches(file, {_text('(?:^|/)' + g.replace('.', chr(92) + '.').replace('*', '[^/]*') + '$')}) and regexp_matches(text, {_text(p)}) group by file" for c, g, p in d.PATCHES)


@query(f"with {CODE_SQL} {_PATCH}")
def missing_patches(spark, sf):
    """The first line per file and missing patch."""
    from siftline.sources.files import glob_regex

    ways = [F.when(F.element_at(F.split("file", "/"), -1).rlike(glob_regex(g)) & F.col("text").rlike(p), F.lit(c)) for c, g, p in d.PATCHES]
    return code(spark, sf).select("file", "line_no", F.explode(F.array_compact(F.array(*ways))).alias("cve")).groupBy("cve", "file").agg(F.min("line_no").alias("line_no"))


# ---- thousands of rules ----

_CALLS = [(language, _EXT.get(language) or next(e for e, n in scan.LANGUAGES.items() if n == language), name) for language in APIS for names in APIS[language].values() for name in names.split()]
_FORMS = ["y§ = {}({})", "y§ = {}(arg§)", "y§ = {}('a' + arg§)", "# {} without a call §"]
_PACK_N = 4 * len(_CALLS)
_CALLS_SQL = f"""
calls(n, ext, name) as (values {', '.join(f"({i}, '{e}', {_text(n)})" for i, (_, e, n) in enumerate(_CALLS))}),
forms(k, f) as (values (0, 'y§ = @(1)'), (1, 'y§ = @(arg§)'), (2, 'y§ = @(''a'' + arg§)'), (3, '# @ without a call §')),
places as (select file, line line_no, min(length(message)) m from issues where file is not null and line is not null and message is not null group by 1, 2),
code as (select regexp_replace(file, '\\.[A-Za-z]+$', '') || '.' || ext file, line_no, k, name, replace(replace(f, '@', name), '§', cast(line_no as varchar)) as text
  from places join calls on (line_no * 31 + m) % {len(_CALLS)} = n join forms on line_no % 4 = k)"""


def pack_code(spark, sf) -> DataFrame:
    """(file, line_no, text): lines with calls of the functions that the packs know, made from the issues' places."""
    places = table(spark, sf, "issues").where("file is not null and line is not null and message is not null").groupBy("file", F.col("line").alias("line_no")).agg(F.min(F.length("message")).alias("m"))
    calls = spark.createDataFrame([(i, e, n) for i, (_, e, n) in enumerate(_CALLS)], "n int, ext string, name string")
    j = places.join(F.broadcast(calls), (F.col("line_no") * 31 + F.col("m")) % len(_CALLS) == F.col("n"))  # the functions are a constant
    k = F.col("line_no") % 4
    form = F.when(k == 0, "y§ = @(1)").when(k == 1, "y§ = @(arg§)").when(k == 2, "y§ = @('a' + arg§)").otherwise("# @ without a call §")
    text = F.replace(F.replace(form, F.lit("@"), F.col("name")), F.lit("§"), F.col("line_no").cast("string"))
    return j.select(F.concat(F.regexp_replace("file", r"\.[A-Za-z]+$", ""), F.lit("."), "ext").alias("file"), "line_no", text.alias("text"))


# what a call is follows from the form of its line, so the SQL joins names instead of trying patterns
_VARIANTS = {"called": "k <= 2", "with-variable": "k = 1", "with-joined-text": "k = 2"}
_KNOWN = [(r["id"], next(v for v in _VARIANTS if r["id"].endswith(v)), language, name) for language in APIS for kind, names in APIS[language].items() for i, name in enumerate(names.split())
          for r in [x for x in packs.pack_rules(language)] if r["message"].split(" ")[0] == name and r["id"].startswith(f"{language}-{kind}-")]
_LANG_EXT = ", ".join(f"('{e}', '{n}')" for e, n in scan.LANGUAGES.items())


@query(f"""with {_CALLS_SQL}, rules(id, variant, language, name) as (values {', '.join(f"('{i}', '{v}', '{l}', {_text(n)})" for i, v, l, n in _KNOWN)}), langs(ext, language) as (values {_LANG_EXT})
select id rule_id, count(*) n, count(distinct file) files from code join langs on langs.ext = regexp_extract(file, '\\.([A-Za-z]+)$', 1) join rules using (language, name)
where case variant when 'called' then k <= 2 when 'with-variable' then k = 1 else k = 2 end group by 1""")
def scan_packs(spark, sf):
    """All packs' rules over lines, in one pass; packs are chosen by the languages of the files."""
    lines = pack_code(spark, sf)
    rules = [r for r in packs.load(packs.selected(lines)) if not r.rule_id.startswith("any-")]
    return scan.line_hits(lines, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


# ---- suppression, flows and relations ----

_SUPPRESS = f"""
notes as (select file, line_no line, regexp_extract(text, '(?i){MARKER}:\\s*ignore\\b(?:\\s*\\[([^\\]]+)\\])?', 1) r1, regexp_matches(text, '(?i){MARKER}:\\s*ignore\\b') p1,
  regexp_extract(text, '(?i)noqa:\\s*{MARKER}=(\\S+)', 1) r2, regexp_extract(text, '(?i)pylint:\\s*disable={MARKER}-(\\S+)', 1) r3 from code),
sup as (select file, line, nullif(case when p1 then r1 when r2 <> '' then r2 else r3 end, '') rule_id from notes where p1 or r2 <> '' or r3 <> '')"""


@query(f"with {CODE_SQL}, {_SUPPRESS} select * from sup")
def suppression_comments(spark, sf):
    """Inline suppression comments with their rule."""
    return t.suppressions(code(spark, sf), MARKER).select("file", "line", "rule_id")


@query(f"with {CODE_SQL}, {_SUPPRESS}, hits as ({hits_sql(d.MINI_SAST)}), x as (select h.*, exists (select 1 from sup s where s.file = h.file and h.line_no in (s.line, s.line + 1) and (s.rule_id is null or starts_with(h.rule_id, s.rule_id))) suppressed from hits h) select rule_id, count(*) filter (where suppressed) suppressed, count(*) filter (where not suppressed) kept from x group by 1")
def suppression_split(spark, sf):
    """Findings kept and suppressed by comments, per rule."""
    lines = code(spark, sf)
    hits = scan.line_hits(lines, d.MINI_SAST).withColumnRenamed("line_no", "start_line")
    kept, gone = t.split_suppressed(hits, t.suppressions(lines, MARKER))
    both = kept.select("rule_id", F.lit(0).alias("s")).unionByName(gone.select("rule_id", F.lit(1).alias("s")))
    return both.groupBy("rule_id").agg(F.sum("s").alias("suppressed"), F.sum(1 - F.col("s")).alias("kept"))


def _alt(patterns) -> str:
    return _text("|".join(f"(?:{p})" for p in patterns))


@query(f"""with {CODE_SQL}, so as (select file, line_no from code where regexp_matches(text, {_alt(dataflow.LINE_SOURCES)})), si as (select file, line_no from code where regexp_matches(text, {_alt(dataflow.LINE_SINKS)})),
cl as (select file, line_no from code where regexp_matches(text, {_alt(dataflow.LINE_CLEANERS)}))
select si.file, si.line_no, cast(count(*) as int) sources, max(so.line_no) nearest from si join so on so.file = si.file and so.line_no <= si.line_no
where not exists (select 1 from cl where cl.file = si.file and cl.line_no between so.line_no and si.line_no) group by 1, 2""")
def source_sink_lines(spark, sf):
    """Sink lines with the sources before them that nothing cleans; the SQL pairs them."""
    return dataflow.source_sink_lines(code(spark, sf))


@query()
def dataflow_flows(spark, sf):
    """Flows followed variable by variable through made files and the source documents."""
    return dataflow.flows(files_of(code(spark, sf)))


_DENSE_SQL = "dense as (select string_split(file, '/')[1] file, line_no % 101 line_no, min(text) as text from code where contains(text, 'delete/') or contains(text, 'updateData') group by 1, 2)"


def _dense(spark, sf) -> DataFrame:
    """The made lines of two kinds in a top folder as one short file, so that they lie near each other."""
    some = F.col("text").contains("delete/") | F.col("text").contains("updateData")
    return code(spark, sf).where(some).groupBy(F.element_at(F.split("file", "/"), 1).alias("file"), (F.col("line_no") % 101).alias("line_no")).agg(F.min("text").alias("text"))


@query(f"""with {CODE_SQL}, {_DENSE_SQL}, u as (select file, line_no from dense where regexp_matches(text, {_text(cb.URL_OF_DELETION)})), w as (select file, line_no from dense where regexp_matches(text, {_text(cb.UPDATE_WRAPPER)}))
select u.file, u.line_no, min(w.line_no) call_line from u join w on u.file = w.file and w.line_no > u.line_no and w.line_no <= u.line_no + 30 group by 1, 2""")
def delete_by_update(spark, sf):
    """Addresses of deletions and the update wrapper that is called next."""
    return cb.deletions_by_update(_dense(spark, sf))


_SET = f"cfg as (select file, line_no, lower(regexp_extract(text, {_text(cb.SETTING)}, 1)) as key, regexp_extract(text, {_text(cb.SETTING)}, 2) as value from code where regexp_matches(text, {_text(cb.SETTING)}))"


@query(f"with {CODE_SQL}, {_SET}, keys as (select value literal, min(key) as key from cfg where value not like '$%' and value not like '{{%' group by 1), used as (select distinct file, line_no, unnest(regexp_extract_all(text, {_text(cb.LITERAL)}, 1)) literal from code) select file, line_no, literal, key from used join keys using (literal)")
def literals_in_settings(spark, sf):
    """Literals that a setting holds already."""
    lines = code(spark, sf)
    return cb.literals_in_settings(lines, cb.settings_of(lines))


@query(f"""with {CODE_SQL}, w as (select file, line_no, lower(unnest(regexp_extract_all(text, {_text(cb.WRITES)}, 1))) entity from code), r as (select distinct lower(unnest(regexp_extract_all(text, {_text(cb.READS)}, 1))) entity from code),
g as (select entity, count(*) writes, arg_min(file, row(file, line_no)) file, arg_min(line_no, row(file, line_no)) line_no from w where entity not in ({', '.join(map(_text, cb.GENERIC_ENTITIES))}) group by 1 having count(*) >= 2)
select * from g where entity not in (select entity from r)""")
def written_never_read(spark, sf):
    """Entities that are stored and never read."""
    return cb.written_never_read(code(spark, sf))


_SUBJ = "replace(replace(file, 'gateway/', 'pages/'), 'portal/', 'app/')"


@query(f"with {CODE_SQL}, p as (select {_SUBJ} f, text from code) select f as file from p where regexp_matches(f, '(?:^|/)(?:pages|app)/') and regexp_matches(f, '\\.(?:js|jsx|mjs|ts|tsx)$') group by 1 having not bool_or(regexp_matches(text, {_alt(cb.PAGE_GUARDS)}))")
def pages_without_guard(spark, sf):
    """Pages in which nothing asks who is there; two folders of the made files stand for pages."""
    return cb.pages_without_guard(code(spark, sf).withColumn("file", F.replace(F.replace("file", F.lit("gateway/"), F.lit("pages/")), F.lit("portal/"), F.lit("app/"))))


_AXIOS = (r"\baxios\.(?:get|post|put|delete|patch)\s*\(", r"\baxios\.create\s*\(", r"\b(?:authClient|apiClient|httpClient)\b")


@query(f"with {CODE_SQL}, f as (select file, min(line_no) filter (where regexp_matches(text, {_text(_AXIOS[0])})) line_no, bool_or(regexp_matches(text, {_text(_AXIOS[1])})) m, bool_or(regexp_matches(text, {_text(_AXIOS[2])})) o from code group by 1), b as (select count(line_no) c, count(*) filter (where m) k from f) select file, line_no from f, b where c >= 3 and k >= 1 and line_no is not null and not m and not o")
def client_inconsistency(spark, sf):
    """Files that call a client directly while the code base has instances of its own."""
    return cb.inconsistent_use(code(spark, sf), *_AXIOS)


_FN = r"(?:\bdef|\bfunction)\s+(\w+)\s*\("


@query(f"""with {CODE_SQL}, h as (select file, line_no, text, last_value(nullif(regexp_extract(text, {_text(_FN)}, 1), '') ignore nulls) over (partition by file order by line_no) fn from code),
e as (select distinct file, line_no, fn as function, regexp_replace(string_split(u, '?')[1], '\\{{[^}}]+\\}}', '', 'g') endpoint from (select *, unnest(regexp_extract_all(text, '["''](/(?:api|v\\d+)/[^\\s"'']+)["'']', 1)) u from h)),
x as (select *, {' '.join(['case'] + [f"when regexp_matches(lower(function), '{'|'.join(w)}') then '{k}'" for k, w in cb.ACTIONS.items()] + ['end'])} a, {' '.join(['case'] + [f"when regexp_matches(lower(endpoint), '{'|'.join(w)}') then '{k}'" for k, w in cb.ACTIONS.items()] + ['end'])} b from e)
select file, line_no, function, endpoint from x where a is not null and b is not null and a <> b""")
def endpoint_mismatch(spark, sf):
    """Addresses whose action differs from that of the function around them."""
    from siftline.operators.blocks import carried_last

    name = F.nullif(F.regexp_extract("text", _FN, 1), F.lit(""))
    return cb.mismatched_endpoints(carried_last(code(spark, sf), name, "function"))


@query(f"with {CODE_SQL} select distinct file, line_no, cast(v as bigint) as value from (select file, line_no, unnest(regexp_extract_all(text || ' ', '\\bif\\s*\\(?[\\w.\\[\\]]+\\s*[<>=!]+\\s*(\\d+)[^\\d.]', 1)) v from code) where cast(v as bigint) > 4")
def hard_thresholds(spark, sf):
    """Whole numbers that conditions compare with."""
    return cb.thresholds(code(spark, sf))


@query(f"with {CODE_SQL}, l as (select file, unnest(regexp_extract_all(text, '[''\"]([^''\"]{{4,}})[''\"]', 1)) literal from code) select file, literal, count(*) n from l group by all having count(*) >= 3")
def repeated_literals(spark, sf):
    """String literals that a file repeats."""
    return metrics.repeated_literals(code(spark, sf))


@query(f"""with {CODE_SQL}, k as (select file, line_no, unnest(list_distinct(regexp_extract_all(text, '[''\"]([A-Za-z0-9+/=_-]{{20,}})[''\"]', 1))) token from code), c as (select file, line_no, token, unnest(string_split(token, '')) ch from k),
g as (select file, line_no, token, ch, count(*) n, length(token) len from c group by all), e as (select file, line_no, token, -sum(n / len * log2(n / len)) entropy from g group by all) select file, line_no, token, round(entropy, 6) entropy from e where entropy >= 4""")
def entropy_tokens(spark, sf):
    """Quoted tokens of high entropy."""
    return metrics.high_entropy_tokens(code(spark, sf)).select("file", "line_no", "token", F.round("entropy", 6).alias("entropy"))


def _fix_sql(f) -> str:
    scope = _scope_sql(scan.Rule("x", "x", languages=f.languages)) if f.languages else ""
    by = f.by.replace("\\", "\\\\")
    for i in (1, 2):
        by = by.replace(f"${i}", f"\\{i}")
    return f"select file, line_no, '{f.rule_id}' fix, regexp_replace(text, {_text(f.pattern)}, {_text(by)}, 'g') fixed from code where regexp_matches(text, {_text(f.pattern)}){scope}"


_SQL_FIXES = [f for f in fixes.FIXES if "(?!" not in f.pattern and "\\1" not in f.pattern]


@query(f"with {CODE_SQL} {' union all '.join(map(_fix_sql, _SQL_FIXES))}")
def auto_fixes(spark, sf):
    """Lines that single-line fixes change, and how."""
    return fixes.fixed(code(spark, sf), _SQL_FIXES).select("file", "line_no", "fix", "fixed")


@query()
def counterfactual_check(spark, sf):
    """Hits of the small table with the verdict on their mutants."""
    hits = scan.line_hits(code(spark, sf), d.MINI_SAST)
    return fixes.counterfactual(hits, d.MINI_SAST).select("file", "line_no", "rule_id", "survives", F.round("confidence", 6).alias("confidence"))


@query(f"with {CODE_SQL} select " + ", ".join(f"count(*) filter (where regexp_matches(text, {_text(r.regex())})) as \"{r.rule_id}\"" for r in d.RISKY_MESSAGES) + " from (select coalesce(resolution_note, '') as text from issues)")
def risky_messages(spark, sf):
    """Notes that a risky commit message would have, by kind."""
    t_ = F.coalesce("resolution_note", F.lit(""))
    return table(spark, sf, "issues").agg(*[F.count_if(t_.rlike(r.regex())).alias(r.rule_id) for r in d.RISKY_MESSAGES])


@query(f"with {CODE_SQL}, f as (select file, line_no // 2000 b, string_agg(text, chr(10) order by line_no, text) content from code group by all) " + " union all ".join(f"select file, cast(b as int) block, '{r.rule_id}' rule_id from f where regexp_matches(content, {_text(r.pattern)})" for r in d.ACROSS_LINES))
def scan_across_lines(spark, sf):
    """Patterns that span lines, per stretch of a file."""
    hits = scan.document_hits(files_of(code(spark, sf)), "content", d.ACROSS_LINES)
    return hits.select("file", F.col("block").cast("int").alias("block"), "rule_id")


@query()
def scan_blocks(spark, sf):
    """Infrastructure definitions that lack something in a block, by line, and business risks that nothing near them vetoes."""
    files = files_of(code(spark, sf))
    blocks = scan.vetoed_matches(files, d.INFRASTRUCTURE_BLOCKS, r"(?!)")
    return blocks.unionByName(scan.vetoed_matches(files, d.BUSINESS, d.BUSINESS_VETOES)).select("file", "line", "rule_id")


@query(f"with {_CALLS_SQL}, adv(id, fns) as (values ('A-1', ['yaml.load', 'yaml.unsafe_load']), ('A-2', ['never.called']), ('A-3', null), ('A-4', ['statement.executeQuery'])), c as (select distinct file, line_no, name from code where k <= 2), n as (select id, count(*) places from (select id, unnest(fns) fn from adv) a join c on c.name = a.fn group by 1) select adv.id, places is not null or fns is null reachable, coalesce(places, 0) places from adv left join n using (id)")
def reachable_advisories(spark, sf):
    """Advisories whose functions lines call."""
    adv = spark.createDataFrame([("A-1", ["yaml.load", "yaml.unsafe_load"]), ("A-2", ["never.called"]), ("A-3", None), ("A-4", ["statement.executeQuery"])], "id string, functions array<string>")
    return cb.reachable_advisories(adv, pack_code(spark, sf))


_REPAIR = "case " + " ".join(f"when regexp_matches(message, '{p}') then '{k}'" for k, p in cb.REPAIRS.items()) + " end"
_LITERALS = "'[^']*'|\"[^\"]*\"|`[^`]*`"
_FORM = f"regexp_replace(regexp_replace(regexp_replace(trim(removed), {_text(_LITERALS)}, '$STRING', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', '$NUMBER', 'g'), '\\s+', ' ', 'g')"


@query(f"with {CODE_SQL}, ch as (select i.fingerprint as change, i.resolution_note || ' ' || i.message message, c.text removed from issues i join code c on regexp_replace(i.file, '\\.[A-Za-z]+$', '') = regexp_replace(c.file, '\\.[A-Za-z]+$', '') and i.line = c.line_no where i.resolution_note is not null), k as (select change, {_REPAIR} kind, {_FORM} form from ch) select kind, form, count(distinct change) changes from k where kind is not null and length(form) >= 4 group by all having count(distinct change) >= 2")
def mined_repairs(spark, sf):
    """Forms of lines that several resolved issues stand for."""
    stem = lambda c: F.regexp_replace(c, r"\.[A-Za-z]+$", "")
    issues = table(spark, sf, "issues").where("resolution_note is not null").select(F.col("fingerprint").alias("change"), F.concat_ws(" ", "resolution_note", "message").alias("message"), stem(F.col("file")).alias("stem"), F.col("line").alias("line_no")).where("message is not null")
    lines = code(spark, sf).select(stem(F.col("file")).alias("stem"), "line_no", F.col("text").alias("removed"))
    return cb.mined_from_repairs(issues.join(lines, ["stem", "line_no"]))


@query("select fingerprint, resolved_at, case when resolved_at < timestamp '2026-07-01' - interval 90 day then 'to_review' else state end status, last_seen >= timestamp '2026-07-01' - interval 7 day fresh from issues where resolved_at is not null")
def decay_and_expiry(spark, sf):
    """Reviews that are too old, and rows that a cache would still hold, at the day of the export."""
    now = F.to_timestamp(F.lit("2026-07-01"))
    rows = table(spark, sf, "issues").where("resolved_at is not null").select("fingerprint", "resolved_at", F.col("state").alias("status"), F.col("resolved_at").alias("reviewed_at"), "last_seen")
    out = metrics.decayed_hotspots(rows, now)
    return out.select("fingerprint", "resolved_at", "status", (F.col("last_seen") >= now - F.expr("interval 7 days")).alias("fresh"))


QUERIES = Q
