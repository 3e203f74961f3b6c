"""Code metrics by patterns, entropy, style consistency, architecture and time-based states."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a branch, an operator and an operand.
BRANCHES = r"\b(?:if|else if|else|for|while|do|case|catch|&&|\|\||\?\s*[^:]*(?=:))\b"
OPERATORS = (
    r"\+|\-|\*|/|%|=|==|!=|===|!==|<|>|<=|>=|&&|\|\||!|&|\||\^|<<|>>|\?|:|\+\+|\-\-|\+=|\-=|\*=|/=|%=|\.|\bnew\b|\btypeof\b|\binstanceof\b|\bin\b"
)
OPERANDS = r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b|\b\d+(?:\.\d+)?\b"


def nesting(text: Column) -> Column:
    """Deepest nesting of brackets of all three kinds; one that closes nothing takes a level below the ground."""
    brackets = F.regexp_extract_all(text, F.lit(r"([{}\[\]()])"), F.lit(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a, b):
        now = a["now"] + F.when(b.isin("{", "[", "("), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(brackets, start, step, lambda a: a["most"])


def toxicity(cyclomatic: Column, depth: Column, parameters: Column, difficulty: Column, lines: Column) -> Column:
    """0 to 100: a blend of branches, nesting, parameters, difficulty and length."""
    part = lambda most, x: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), x))
    blend = part(40, (cyclomatic - 5) * 4) + part(25, depth * 6) + part(15, (parameters - 3) * 4) + part(15, difficulty / 4.0) + part(5, (lines - 50) / 10.0)
    return F.round(F.least(F.lit(100.0), blend), 1)


def grade(score: Column) -> Column:
    """A to F of a toxicity."""
    return F.when(score < 10, "A").when(score < 25, "B").when(score < 45, "C").when(score < 65, "D").when(score < 85, "E").otherwise("F")


def code_metrics(files: DataFrame) -> DataFrame:
    """(file, lines, cyclomatic, nesting, volume, difficulty, toxicity, grade) of (file, content), all JVM-side; a ``parameters`` column is optional."""
    c = F.col("content")
    ops, words = F.regexp_extract_all(c, F.lit(f"({OPERATORS})"), F.lit(1)), F.regexp_extract_all(c, F.lit(f"({OPERANDS})"), F.lit(1))
    n1, n2, m1, m2 = F.size(F.array_distinct(ops)), F.size(F.array_distinct(words)), F.size(ops), F.size(words)
    some = (m1 > 0) & (m2 > 0)
    parameters = F.col("parameters") if "parameters" in files.columns else F.lit(0)
    m = files.where(c.isNotNull()).select(
        "file", (F.regexp_count(c, F.lit(r"\n")) + 1).alias("lines"), (F.regexp_count(c, F.lit(BRANCHES)) + 1).alias("cyclomatic"), nesting(c).alias("nesting"), parameters.alias("parameters"),
        F.when(some, (m1 + m2) * F.log2(F.greatest(n1 + n2, F.lit(2)).cast("double"))).otherwise(0.0).alias("volume"), F.when(some, n1 / 2.0 * (m2 / F.greatest(n2, F.lit(1)))).otherwise(0.0).alias("difficulty"),
    )
    m = m.withColumn("toxicity", toxicity(F.col("cyclomatic"), F.col("nesting"), F.col("parameters"), F.col("difficulty"), F.col("lines")))
    return m.withColumn("grade", grade(F.col("toxicity"))).drop("parameters")


#: A comment, or a literal that stays as an empty pair of its marks; by the language's comment marks.
_HASH = r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|#[^\n]*"
_SLASH = r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|//[^\n]*"


def stripped(content: Column, file: Column) -> Column:
    """Text without comments and without what strings hold, line by line as it was: line ends stay, so line numbers do too.

    Python's triple-quoted strings and block comments keep only their line ends.
    """
    from siftline.operators.scan import language_of

    def only_ends(c: Column, opening: str, closing: str, body: str) -> Column:
        # inside a block everything but line ends goes: a character with the block's end ahead and no other opening before it
        pieces = F.split(c, opening)
        first = F.get(pieces, F.lit(0))
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.concat(
            F.regexp_replace(F.regexp_extract(p, rf"(?s)^(.*?)(?:{closing}|\z)", 1), r"[^\n]", ""), F.regexp_extract(p, rf"(?s)^.*?(?:{closing}|\z)(.*)$", 1)
        ))
        return F.concat(first, F.array_join(rest, ""))

    language = language_of(file)
    triple = F.split(content, '\"\"\"')
    docless = F.array_join(F.transform(triple, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"[^\n]", "")).otherwise(p)), "")
    empty = lambda c, p: F.regexp_replace(F.regexp_replace(c, p, "$1"), r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "''")
    hashed = language.isin("python", "ruby", "bash", "r", "perl", "elixir", "julia")
    return F.when(hashed, empty(docless, _HASH)).otherwise(empty(only_ends(content, r"/\*", r"\*/", "block"), _SLASH))


def balanced_block(text: Column, start: Column) -> Column:
    """The block in braces that begins at ``start`` (from 1), quotes and escapes honoured; empty where none begins there, and just the rest of nothing where it never ends."""
    @F.pandas_udf("string")
    def block(texts: pd.Series, starts: pd.Series) -> pd.Series:
        def one(t, at):
            if t is None or pd.isna(at) or not 0 < at <= len(t) or t[int(at) - 1] != "{":
                return ""
            depth, quote, i, begin = 0, "", int(at) - 1, int(at) - 1
            while i < len(t):
                ch = t[i]
                if quote:
                    i += ch == "\\"
                    quote = "" if ch == quote else quote
                elif ch in "\"'`":
                    quote = ch
                else:
                    depth += (ch == "{") - (ch == "}")
                    if not depth:
                        return t[begin : i + 1]
                i += 1
            return ""

        return pd.Series([one(t, s) for t, s in zip(texts, starts)], dtype=object)

    return block(text, start)


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    chars = F.split(text, "")
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def high_entropy_tokens(lines: DataFrame, least: float = 4.0, length: int = 20) -> DataFrame:
    """Quoted tokens of at least ``length`` characters whose entropy is high: likely secrets."""
    p = rf"['\"]([A-Za-z0-9+/=_-]{{{length},}})['\"]"
    t = lines.where(F.col("text").rlike(p)).withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))))
    return t.withColumn("entropy", entropy(F.col("token"))).where(F.col("entropy") >= least)


def mixed_styles(lines: DataFrame, styles: dict[str, tuple[str, str]]) -> DataFrame:
    """(check, a_files, b_files): checks of which both styles occur in the corpus."""
    flags = [F.bool_or(F.col("text").rlike(p)).alias(f"{k}__{i}") for k, ab in styles.items() for i, p in enumerate(ab)]
    per_file = lines.groupBy("file").agg(*flags)
    counts = per_file.agg(*[F.count_if(F.col(f"{k}__{i}")).alias(f"{k}__{i}") for k in styles for i in (0, 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"{k}__0").alias("a_files"), F.col(f"{k}__1").alias("b_files")) for k in styles])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("a_files > 0 and b_files > 0")


def repeated_literals(lines: DataFrame, least: int = 3) -> DataFrame:
    """String literals that a file repeats."""
    p = r"['\"]([^'\"]{4,})['\"]"
    t = lines.withColumn("literal", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))))
    return t.groupBy("file", "literal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def decayed_hotspots(hotspots: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Hotspots with reviews that are older than the given days put back to review."""
    old = F.col("reviewed_at").isNotNull() & (F.col("reviewed_at") < now - F.make_interval(days=F.lit(days)))
    return hotspots.withColumn("status", F.when(old & (F.col("status") != "to_review"), "to_review").otherwise(F.col("status")))


def unexpired(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cache rows that are younger than the given days."""
    return cache.where(F.col("stored_at") >= now - F.make_interval(days=F.lit(days)))


def invariants(observations: DataFrame) -> DataFrame:
    """(function, variable, kind, value) of at least three observations: constant, positive, non-negative or range."""
    g = observations.groupBy("function", "variable").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("n >= 3")
    kind = F.when(F.col("lo") == F.col("hi"), "constant").when(F.col("lo") > 0, "positive").when(F.col("lo") >= 0, "non_negative").otherwise("range")
    return g.select("function", "variable", kind.alias("kind"), F.concat_ws("..", F.col("lo").cast("string"), F.when(F.col("lo") != F.col("hi"), F.col("hi").cast("string"))).alias("value"))
