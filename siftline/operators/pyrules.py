"""Relations over the facts of Python sources: documentation drift, mined rules, chains without authorisation, contracts, determinism, protocols.

A function is named by (file, scope); calls are bound by the last part of their name, as everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import codebase

#: Our own names of calls that ask who is there, that need such a question, and that give another result each time.
AUTH = r"login_required|require_|is_authenticated|check_permission|authorize|has_role|current_user"
SENSITIVE = r"^(?:delete|remove|drop|transfer|grant|reset|refund|promote)_?"
UNSTEADY = r"(?:^|\.)(?:random|randint|choice|shuffle|uuid4|now|utcnow|today|time|urandom|getrandbits)$"
#: Constructors and names that are evidence of a protocol, and the call that ends it.
PROTOCOLS = {"file": (("open",), ("file", "fh", "handle"), "close"), "socket": (("socket.socket", "create_connection"), ("sock", "conn"), "close"), "lock": (("Lock", "threading.Lock"), ("lock", "mutex"), "release")}


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def documentation_drift(facts: DataFrame) -> DataFrame:
    """(file, scope, problem, name): documented parameters a function lacks, parameters its documentation lacks though it names others, and exceptions raised but not documented though others are."""
    of = lambda k: facts.where(F.col("kind") == k).select("file", "scope", "name").distinct()
    params = of("parameter").where("name not in ('self', 'cls')")
    documented, told = of("documented"), of("documented_raise")
    key = ["file", "scope", "name"]
    extra = documented.join(params, key, "left_anti").withColumn("problem", F.lit("documented only"))
    missing = params.join(documented.select("file", "scope").distinct(), ["file", "scope"], "left_semi").join(documented, key, "left_anti").withColumn("problem", F.lit("not documented"))
    raised = of("raises").where("name <> ''").join(told.select("file", "scope").distinct(), ["file", "scope"], "left_semi").join(told, key, "left_anti").withColumn("problem", F.lit("raise not documented"))
    return extra.unionByName(missing).unionByName(raised).select("file", "scope", "problem", "name")


def mined_rules(facts: DataFrame) -> DataFrame:
    """(function, name, rule, source, places): rules that guards and documentation state about parameters; the same rule of several functions of a name once."""
    rows = facts.where("kind in ('guard', 'promise')").select(_last(F.col("scope")).alias("function"), "name", F.col("detail").alias("rule"), F.when(F.col("kind") == "guard", "guard").otherwise("docstring").alias("source"))
    return rows.groupBy("function", "name", "rule", "source").agg(F.count(F.lit(1)).alias("places"))


def rule_breaches(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, line, function, name, rule): calls whose constant argument a mined rule rules out."""
    params = facts.where("kind = 'parameter'").select(_last(F.col("scope")).alias("function"), "name", "position").distinct()
    given = facts.where("kind = 'constant'").select(_last(F.col("name")).alias("function"), "position", "file", "line", F.col("detail").alias("given"))
    j = rules.select("function", "name", "rule").distinct().join(params, ["function", "name"]).join(given, ["function", "position"])
    number = F.when(F.col("given").rlike(r"^-?\d+(?:\.\d+)?$"), F.col("given")).cast("double")
    bad = ((F.col("rule") == "not-none") & (F.col("given") == "None")) | ((F.col("rule") == "positive") & (number <= 0)) | ((F.col("rule") == "negative") & (number >= 0))
    return j.where(F.coalesce(bad, F.lit(False))).select("file", "line", "function", "name", "rule").distinct()


def invariants(facts: DataFrame) -> DataFrame:
    """(file, scope, line, condition): what assertions and raising tests require."""
    return facts.where("kind = 'invariant'").select("file", "scope", "line", F.col("detail").alias("condition"))


def contract_breaches(facts: DataFrame) -> DataFrame:
    """Calls whose first argument is a constant that a precondition rules out."""
    parts = F.split("detail", r"\|", 2)
    contracts = facts.where("kind = 'contract'").select(F.col("name").alias("function"), "file", "line", parts[0].alias("kind"), parts[1].alias("condition"))
    calls = facts.where("kind = 'constant' and position = 0").select(F.col("name").alias("callee"), "file", "line", F.col("detail").alias("first"))
    return codebase.contract_breaches(contracts, calls)


def auth_chains(facts: DataFrame) -> DataFrame:
    """(file, caller, via, callee, hops): functions that ask nobody and call something sensitive, directly or by one function that asks nobody either."""
    fns = facts.where("kind = 'function'").select("file", F.when(F.col("scope") == "", F.col("name")).otherwise(F.concat_ws(".", "scope", "name")).alias("fn"))
    calls = facts.where("kind = 'call' and scope <> ''").select("file", F.col("scope").alias("fn"), _last(F.col("name")).alias("callee"), "name").distinct()
    asking = calls.where(F.col("name").rlike(AUTH)).select("file", "fn").distinct()
    silent = fns.join(asking, ["file", "fn"], "left_anti").distinct()
    own = calls.join(silent, ["file", "fn"], "left_semi")
    direct = own.where(F.col("callee").rlike(SENSITIVE)).select("file", F.col("fn").alias("caller"), F.lit("").alias("via"), "callee", F.lit(1).alias("hops")).distinct()
    second = direct.select(_last(F.col("caller")).alias("step"), F.col("callee").alias("end")).distinct()
    chained = own.join(second, own["callee"] == second["step"]).select("file", F.col("fn").alias("caller"), F.col("step").alias("via"), F.col("end").alias("callee"), F.lit(2).alias("hops"))
    return direct.unionByName(chained.distinct())


def unsteady_functions(facts: DataFrame) -> DataFrame:
    """(file, scope, calls): functions that read a clock or draw at random."""
    calls = facts.where((F.col("kind") == "call") & (F.col("scope") != "") & F.col("name").rlike(UNSTEADY))
    return calls.groupBy("file", "scope").agg(F.count(F.lit(1)).alias("calls"))


def protocol_uses(facts: DataFrame) -> DataFrame:
    """(file, scope, name, protocol, evidence, closed): variables with evidence of a protocol, by constructor before name, and whether it is ended."""
    made = facts.where("kind = 'made'")
    ways = None
    for protocol, (makers, names, end) in PROTOCOLS.items():
        by_maker = made.where(F.col("detail").isin(*makers)).select("file", "scope", "name", F.lit(protocol).alias("protocol"), F.lit("constructor").alias("evidence"), F.lit(end).alias("end"))
        by_name = facts.where((F.col("kind") == "parameter") & F.lower("name").isin(*names)).select("file", "scope", "name", F.lit(protocol).alias("protocol"), F.lit("name").alias("evidence"), F.lit(end).alias("end"))
        part = by_maker.unionByName(by_name)
        ways = part if ways is None else ways.unionByName(part)
    one = ways.groupBy("file", "scope", "name", "protocol", "end").agg(F.min("evidence").alias("evidence"))
    ended = facts.where("kind = 'access'").select("file", "scope", "name", F.col("detail").alias("end"), F.lit(True).alias("closed")).distinct()
    return one.join(ended, ["file", "scope", "name", "end"], "left").select("file", "scope", "name", "protocol", "evidence", F.coalesce("closed", F.lit(False)).alias("closed"))
