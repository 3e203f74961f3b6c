"""Python files made from the issues table, and the queries over their facts.

Every place of an issue gives a function from a template, named by its line; the functions of a stretch of 2,000 lines of a file make a
file.  What each template holds is written down by hand beside it, so the SQL joins that table with the places and the sources are not read by it.
The source documents of the driver's tables, none of which is Python, are read too: each gives its error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import graphs as g
from siftline.operators import pychecks, pyrules, pysource
from siftline.queries.base import table
from siftline.runtime import materialise, work_dir

Q: dict = {}
SQL: dict = {}

#: (source, checks it fails, facts of its kinds); § is the line number of the place.
TEMPLATES: list[tuple[str, tuple[str, ...]]] = [
    ("def plain_§(a, b):\n    return a + b\n", ()),
    ("def maybe_§(d):\n    x = d.get('k')\n    return x.y\n", ("maybe-none",)),
    ("def used_§():\n    h = open('p')\n    h.close()\n    return h.read()\n", ("use-after-close",)),
    ("def twice_§(h):\n    h.close()\n    h.close()\n", ("double-close",)),
    ("def left_§():\n    h = open('p')\n    h.read()\n", ("never-closed",)),
    ("def act_§(p, os):\n    if os.path.exists(p):\n        os.remove(p)\n", ("check-then-act", "sensitive-without-guard")),
    ("def wipe_§(db):\n    db.delete_user(1)\n", ("sensitive-without-guard",)),
    ("def asked_§(db):\n    check_permission(db)\n    db.delete_user(1)\n", ()),
    ("def shared_§(a=[]):\n    return a\n", ("shared-default",)),
    ("def drop_§():\n    try:\n        plain_§(1, 2)\n    except Exception:\n        pass\n", ("swallowed-exception",)),
    ("def run_§(request):\n    q = request\n    eval(q)\n", ("evaluates-variable",)),
    ('def told_§(a):\n    """Count.\n\n    :param a: what\n    :param b: gone\n    """\n    return a\n', ("documentation-drift",)),
    ("@pre(lambda x: x > 0)\ndef root_§(x):\n    if x is None:\n        raise ValueError\n    return x\n\ndef bad_§():\n    return root_§(-1)\n", ()),
    ("def draw_§():\n    return random.randint(0, §)\n", ()),
    ("def over_§():\n    n = 3\n    k = n - 3\n    return n / k\n", ()),
    ("def chain_§(db):\n    wipe_all(db)\n\ndef wipe_all(db):\n    db.drop_table(db)\n", ("sensitive-without-guard",)),
]
_N = len(TEMPLATES)

_PLACES = "places as (select file, line, min(length(message)) m from issues where file is not null and line is not null and message is not null group by 1, 2), p as (select regexp_replace(file, '\\.[A-Za-z]+$', '') || '/' || (line // 2000) || '.py' file, line, cast((line * 31 + m) % {n} as int) k from places)".replace("{n}", str(_N))
_EXPECTED = ", ".join(f"({k}, '{c}')" for k, (_, cs) in enumerate(TEMPLATES) for c in cs)


def sources(spark, sf) -> DataFrame:
    """(file, content): the made files, and the source documents."""
    places = table(spark, sf, "issues").where("file is not null and line is not null and message is not null").groupBy("file", "line").agg(F.min(F.length("message")).alias("m"))
    templates = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(TEMPLATES)], "k int, s string")
    j = places.join(F.broadcast(templates), (F.col("line") * 31 + F.col("m")) % _N == F.col("k"))  # the templates are a constant
    name = F.concat(F.regexp_replace("file", r"\.[A-Za-z]+$", ""), F.lit("/"), F.expr("line div 2000"), F.lit(".py"))
    parts = j.select(name.alias("file"), "line", F.replace("s", F.lit("§"), F.col("line").cast("string")).alias("s"))
    # at most 2,000 functions a file
    made = parts.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n").alias("content"))
    docs = table(spark, sf, "documents").where("doc_kind = 'source'").select(F.concat(F.lit("documents/"), "doc_id").alias("file"), F.col("text").alias("content"))
    return made.unionByName(docs)


def facts(spark, sf) -> DataFrame:
    return pysource.python_facts(sources(spark, sf))


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {_PLACES}, e(k, rule_id) as (values {_EXPECTED}) select file, rule_id, count(*) n from p join e using (k) group by all")
def python_checks(spark, sf):
    """Defects of the made files found by the parser, per file and rule."""
    found = pychecks.python_checks(sources(spark, sf)).where("rule_id not in ('parse-error', 'unused-variable') and file not like 'documents/%'")
    return found.groupBy("file", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_PLACES} select file, count(*) + count(*) filter (where k in (12, 15)) functions from p group by 1")
def python_facts(spark, sf):
    """Functions per made file."""
    return facts(spark, sf).where("kind = 'function' and file not like 'documents/%'").groupBy("file").agg(F.count(F.lit(1)).alias("functions"))


@query()
def python_errors(spark, sf):
    """Sources that do not parse, with the line and kind of their error."""
    return facts(spark, sf).where("kind = 'error'").select("file", "line", "detail")


@query(f"with {_PLACES} select file, line, case k when 12 then 'bad_' || line when 15 then 'chain_' || line else (['plain_', 'maybe_', 'used_', 'twice_', 'left_', 'act_', 'wipe_', 'asked_', 'shared_', 'drop_', 'run_', 'told_', '', 'draw_', 'over_'])[k + 1] || line end as name from p where not (k = 0 and exists (select 1 from p q where q.line = p.line and q.k = 9))")
def python_dead_code(spark, sf):
    """Functions that nothing calls, by the line in their name; calls are bound by name over all files."""
    f = facts(spark, sf).where("file not like 'documents/%'")
    calls = f.where("kind = 'call'").select(F.element_at(F.split("name", r"\."), -1).alias("callee"))
    dead = g.unreferenced(f.where("kind = 'function'").select("name", "file"), calls)
    return dead.select("file", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("line"), "name")


@query(f"with {_PLACES}, roots as (select line, min(file) f from p where k = 12 group by 1), own as (select file, line from p where k = 12) select 'bad_' || line caller, 'root_' || line callee, file, file callee_file from own union all select 'drop_' || line, 'plain_' || line, p.file, case when exists (select 1 from p q where q.file = p.file and q.line = p.line and q.k = 0) then p.file else (select min(file) from p q where q.line = p.line and q.k = 0) end from p where k = 9 and exists (select 1 from p q where q.line = p.line and q.k = 0) union all select 'chain_' || line, 'wipe_all', file, file from p where k = 15")
def python_call_graph(spark, sf):
    """Calls with the function they mean: one in the same file before others."""
    f = pysource.python_facts(sources(spark, sf), ("call", "function")).where("file not like 'documents/%'")
    f = materialise(f.select("kind", "file", "scope", "name", "line"), work_dir(spark, "calls"))  # sources are parsed once
    calls = f.where("kind = 'call'").select("file", F.col("scope").alias("caller"), F.element_at(F.split("name", r"\."), -1).alias("callee"), "line")
    return g.bind_calls(calls, f.where("kind = 'function'").select("name", "file", "line")).select("caller", "callee", "file", "callee_file")


@query(f"with {_PLACES} select distinct file || ':run_' || line || ':request' source, 'sink:' || file || ':eval' sink, 2 hops from p where k = 10")
def python_taint(spark, sf):
    """Flows from request parameters to evaluating calls across the files."""
    from siftline.operators import pyflow

    return pyflow.taint_of(pysource.python_facts(sources(spark, sf), pyflow.KINDS).where("file not like 'documents/%'"))


@query(f"with {_PLACES} select file, 'told_' || line as scope, x.problem, x.name from p, (values ('documented only', 'b')) x(problem, name) where k = 11")
def python_doc_drift(spark, sf):
    """What documentation and function say differently."""
    return pyrules.documentation_drift(facts(spark, sf))


@query(f"with {_PLACES} select 'root_' || line as \"function\", 'x' as name, 'not-none' as rule, 'guard' as source, count(*) places from p where k = 12 group by line")
def python_mined_rules(spark, sf):
    """Rules that guards and documentation state."""
    return pyrules.mined_rules(facts(spark, sf))


@query(f"with {_PLACES} select file, 'root_' || line as scope, 'not (x is None)' condition from p where k = 12")
def python_invariants(spark, sf):
    """What assertions and raising tests require."""
    return pyrules.invariants(facts(spark, sf)).select("file", "scope", "condition")


@query(f"with {_PLACES} select a.file, 'root_' || a.line as \"function\", b.file caller_file from p a join p b on a.line = b.line where a.k = 12 and b.k = 12")
def python_contract_breaches(spark, sf):
    """Calls that a precondition rules out; functions of one name are taken as one."""
    return pyrules.contract_breaches(facts(spark, sf)).select("file", "function", "caller_file")


@query(f"""with {_PLACES} select file, case k when 5 then 'act_' when 6 then 'wipe_' end || line caller, '' via, case k when 5 then 'remove' else 'delete_user' end callee, 1 hops from p where k in (5, 6)
union all select distinct file, 'wipe_all', '', 'drop_table', 1 from p where k = 15 union all select file, 'chain_' || line, 'wipe_all', 'drop_table', 2 from p where k = 15""")
def python_auth_chains(spark, sf):
    """Sensitive calls that nobody is asked about, directly or by one more function."""
    return pyrules.auth_chains(facts(spark, sf))


@query(f"with {_PLACES} select file, 'draw_' || line as scope, 1 calls from p where k = 13")
def python_unsteady(spark, sf):
    """Functions that read a clock or draw at random."""
    return pyrules.unsteady_functions(facts(spark, sf)).withColumn("calls", F.col("calls").cast("int"))


@query(f"with {_PLACES} select file, 'over_' || line as scope, x.kind, x.name, x.detail from p, (values ('interval', 'n', '3..3'), ('interval', 'k', '0..0'), ('zero_division', 'k', '')) x(kind, name, detail) where k = 14")
def python_intervals(spark, sf):
    """Bounds of numbers and divisions by what may be zero."""
    return facts(spark, sf).where("kind in ('interval', 'zero_division')").select("file", "scope", "kind", "name", "detail")


@query(f"with {_PLACES} select file, case k when 2 then 'used_' when 4 then 'left_' end || line as scope, 'h' as name, 'file' protocol, 'constructor' evidence, k = 2 closed from p where k in (2, 4)")
def python_protocols(spark, sf):
    """Variables with evidence of a protocol and whether it is ended."""
    return pyrules.protocol_uses(facts(spark, sf))


_HEADER = ["int root_§(const char *name, double x);", "extern double plain_§(int a, char *b);", "void wipe_§(void);"]


@query(f"with {_PLACES} select 'plain_' || line as \"function\", file, 1 as position, '2' given, 'char*' as type from p where k = 9 and line % 2 = 0 union all select 'root_' || line, file, 0, '-1', 'char*' from p where k = 12 and line % 2 = 0")
def python_foreign_arguments(spark, sf):
    """Constants of another kind than a header declares; every second place has a declaration."""
    from siftline.operators import codebase as cb

    places = table(spark, sf, "issues").where("line is not null and file is not null and message is not null and line % 2 = 0").select("line").distinct()
    header = places.select(F.explode(F.array(*[F.replace(F.lit(h), F.lit("§"), F.col("line").cast("string")) for h in _HEADER])).alias("text"))
    return cb.foreign_arguments(cb.prototypes(header), facts(spark, sf)).select("function", "file", "position", "given", "type")


QUERIES = Q
