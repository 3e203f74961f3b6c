"""Rewriting of single lines, mutation of lines, and the check whether a finding survives it.

A fix is a pattern with its replacement and runs inside generated code.  A mutant is the line with a change; as the line rules are
functions of a line, a finding's verdict on the mutant is the rule tried on the mutated text, without writing anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.scan import Rule, language_of


@dataclass(frozen=True)
class Fix:
    """``pattern`` is replaced by ``by``; ``languages`` are names, none for all."""

    rule_id: str
    pattern: str
    by: str
    languages: tuple[str, ...] = ()
    before: str = ""
    after: str = ""


#: Single-line fixes; our own selection, with a line before and after each.
FIXES = [
    Fix("yaml-load", r"\byaml\.load\(\s*([^,()]+)\s*\)", "yaml.safe_load($1)", ("python",), "d = yaml.load(text)", "d = yaml.safe_load(text)"),
    Fix("none-compare", r"==\s*None\b", "is None", ("python",), "if x == None:", "if x is None:"),
    Fix("not-none-compare", r"!=\s*None\b", "is not None", ("python",), "if x != None:", "if x is not None:"),
    Fix("true-compare", r"\s*==\s*True\b", "", ("python",), "if x == True:", "if x:"),
    Fix("bare-except", r"\bexcept\s*:", "except Exception:", ("python",), "except:", "except Exception:"),
    Fix("md5", r"\bhashlib\.(?:md5|sha1)\(", "hashlib.sha256(", ("python",), "h = hashlib.md5(b)", "h = hashlib.sha256(b)"),
    Fix("mktemp", r"\btempfile\.mktemp\(", "tempfile.mkstemp(", ("python",), "p = tempfile.mktemp()", "p = tempfile.mkstemp()"),
    Fix("verify-off", r",?\s*verify\s*=\s*False", "", ("python",), "get(u, verify=False)", "get(u)"),
    Fix("shell-on", r"shell\s*=\s*True", "shell=False", ("python",), "run(c, shell=True)", "run(c, shell=False)"),
    Fix("random-choice", r"\brandom\.(choice|randint|random)\(", "secrets.SystemRandom().$1(", ("python",), "random.choice(x)", "secrets.SystemRandom().choice(x)"),
    Fix("debug-on", r"\bdebug\s*=\s*True", "debug=False", ("python",), "app.run(debug=True)", "app.run(debug=False)"),
    Fix("set-trace", r"^\s*(?:import pdb; *)?(?:pdb\.set_trace|breakpoint)\(\)\s*$", "", ("python",), "    breakpoint()", ""),
    Fix("has-key", r"(\w+)\.has_key\(([^()]+)\)", "$2 in $1", ("python",), "if d.has_key(k):", "if k in d:"),
    Fix("len-zero", r"\bif\s+len\((\w+)\)\s*==\s*0\s*:", "if not $1:", ("python",), "if len(x) == 0:", "if not x:"),
    Fix("assert-equals", r"\bassertEquals\(", "assertEqual(", ("python",), "self.assertEquals(a, b)", "self.assertEqual(a, b)"),
    Fix("loose-equality", r"([^=!])==([^=])", "$1===$2", ("javascript", "typescript"), "if (a == b) {", "if (a === b) {"),
    Fix("loose-inequality", r"!=([^=])", "!==$1", ("javascript", "typescript"), "if (a != b) {", "if (a !== b) {"),
    Fix("var", r"^(\s*)var\s+", "$1let ", ("javascript", "typescript"), "var x = 1;", "let x = 1;"),
    Fix("inner-html", r"\.innerHTML\s*=", ".textContent =", ("javascript", "typescript"), "b.innerHTML = t;", "b.textContent = t;"),
    Fix("reject-unauthorized", r"rejectUnauthorized\s*:\s*false", "rejectUnauthorized: true", ("javascript", "typescript"), "{rejectUnauthorized: false}", "{rejectUnauthorized: true}"),
    Fix("console", r"^\s*console\.(?:log|debug)\([^;]*\);?\s*$", "", ("javascript", "typescript"), "console.log(x);", ""),
    Fix("debugger", r"^\s*debugger\s*;?\s*$", "", ("javascript", "typescript"), "debugger;", ""),
    Fix("parse-int", r"\bparseInt\(\s*([^,()]+)\s*\)", "parseInt($1, 10)", ("javascript", "typescript"), "parseInt(x)", "parseInt(x, 10)"),
    Fix("new-array", r"\bnew\s+Array\(\s*\)", "[]", ("javascript", "typescript"), "a = new Array();", "a = [];"),
    Fix("create-hash", r"createHash\(\s*(['\"])(?:md5|sha1)\1\s*\)", "createHash($1sha256$1)", ("javascript", "typescript"), "createHash('md5')", "createHash('sha256')"),
    Fix("string-equality", r"\b(\w+)\s*==\s*(\"[^\"]*\")", "$2.equals($1)", ("java", "kotlin"), 'if (s == "a") {', 'if ("a".equals(s)) {'),
    Fix("print-trace", r"\b(\w+)\.printStackTrace\(\)", 'log.error("", $1)', ("java",), "e.printStackTrace();", 'log.error("", e);'),
    Fix("message-digest", r"getInstance\(\s*\"(?:MD5|SHA-?1)\"\s*\)", 'getInstance("SHA-256")', ("java", "kotlin"), 'MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-256")'),
    Fix("new-integer", r"\bnew\s+(Integer|Long|Double|Boolean)\(", "$1.valueOf(", ("java",), "new Integer(5)", "Integer.valueOf(5)"),
    Fix("des", r"getInstance\(\s*\"DES[^\"]*\"\s*\)", 'getInstance("AES/GCM/NoPadding")', ("java", "kotlin"), 'Cipher.getInstance("DES")', 'Cipher.getInstance("AES/GCM/NoPadding")'),
    Fix("strcpy", r"\bstrcpy\(\s*(\w+)\s*,", "strlcpy($1, sizeof($1),", ("c", "cpp"), "strcpy(a, b);", "strlcpy(a, sizeof(a), b);"),
    Fix("gets", r"\bgets\(\s*(\w+)\s*\)", "fgets($1, sizeof($1), stdin)", ("c", "cpp"), "gets(a);", "fgets(a, sizeof(a), stdin);"),
    Fix("sprintf", r"\bsprintf\(\s*(\w+)\s*,", "snprintf($1, sizeof($1),", ("c", "cpp"), "sprintf(a, f);", "snprintf(a, sizeof(a), f);"),
    Fix("null-macro", r"\bNULL\b", "nullptr", ("cpp",), "p = NULL;", "p = nullptr;"),
    Fix("skip-verify", r"InsecureSkipVerify\s*:\s*true", "InsecureSkipVerify: false", ("go",), "{InsecureSkipVerify: true}", "{InsecureSkipVerify: false}"),
    Fix("context-todo", r"\bcontext\.TODO\(\)", "context.Background()", ("go",), "f(context.TODO())", "f(context.Background())"),
    Fix("plain-http", r"\bhttp://(?!localhost|127\.)", "https://", (), "u = 'http://h/x'", "u = 'https://h/x'"),
    Fix("chmod-all", r"\bchmod\s+777\b", "chmod 755", (), "RUN chmod 777 /d", "RUN chmod 755 /d"),
    Fix("privileged", r"\bprivileged:\s*true", "privileged: false", (), "privileged: true", "privileged: false"),
    Fix("public-acl", r"acl\s*=\s*\"public-read\"", 'acl = "private"', (), 'acl = "public-read"', 'acl = "private"'),
]


def fixed(lines: DataFrame, fixes: list[Fix] | None = None) -> DataFrame:
    """(…, fix, fixed): lines that fixes change, one row per line and fix."""
    t, language = F.col("text"), language_of(F.col("file"))
    ways = []
    for f in FIXES if fixes is None else fixes:
        fits = t.rlike(f.pattern)
        if f.languages:
            fits = fits & language.isin(*f.languages)
        ways.append(F.when(fits, F.struct(F.lit(f.rule_id).alias("fix"), F.regexp_replace(t, f.pattern, f.by).alias("fixed"))))
    return lines.withColumn("__f", F.explode(F.array_compact(F.array(*ways)))).select(*lines.columns, "__f.*")


def _subject(text: Column) -> Column:
    """The name a line is about: of a call's receiver, of an index, of an assignment, else x."""
    out = F.lit("x")
    for p in (r"(\w+)\s*=", r"(\w+)\s*\[", r"(\w+)\s*\.\s*\w+\s*\("):
        out = F.when(text.rlike(p), F.regexp_extract(text, p, 1)).otherwise(out)
    return out


def _matching(pattern: str):
    return lambda m: m.rlike(pattern)


STRATEGIES = ("line_removal", "guard_injection", "type_annotation")


def mutated(text: Column, file: Column, strategy: str) -> Column:
    """The line after a mutation: gone, or behind a guard or an assertion of its subject; in the file's language."""
    language, indent, name = language_of(file), F.regexp_extract(text, r"^(\s*)", 1), _subject(text)
    script, c_like = language.isin("javascript", "typescript"), language.isin("c", "cpp")
    if strategy == "line_removal":
        return F.concat(indent, F.when(script | c_like, "/* removed */").when(language == "go", "// removed").when(language == "java", ";// removed").otherwise("pass  # removed"))
    if strategy == "guard_injection":
        guard = (
            F.when(script, F.format_string("if (%s === null || %s === undefined) return;", name, name)).when(language == "go", F.format_string("if %s == nil { return }", name))
            .when(language == "java", F.format_string("if (%s == null) return;", name)).when(c_like, F.format_string("if (%s == NULL) return;", name))
            .otherwise(F.format_string("if %s is None: return None", name))
        )
    else:
        guard = (
            F.when(script, F.format_string("if (%s === null) throw new Error();", name)).when(language == "go", F.lit("// not nil")).when(language == "java", F.format_string("assert %s != null;", name))
            .when(c_like, F.format_string("assert(%s != NULL);", name)).otherwise(F.format_string("assert %s is not None", name))
        )
    return F.concat(indent, guard, F.lit("\n"), text)


def counterfactual(hits: DataFrame, rules: list[Rule], least: float = 0.5) -> DataFrame:
    """Hits of line rules (file, line_no, text, rule_id, confidence) with ``survives`` and the confidence after the check.

    A hit of at least ``least`` that a mutation removes is raised by 0.15 to at most 0.99, one that survives all of them lowered
    by 0.2 to at least 0.1.  All hits are checked.  A line cannot vanish under a guard, so the removal of the line decides first.
    """
    # the mutants are columns of their own, so they are made once and not for every rule
    made = hits.withColumns({f"__{s}": mutated(F.col("text"), F.col("file"), s) for s in STRATEGIES})
    made = made.select("*", F.array(*[f"__{s}" for s in STRATEGIES]).alias("__mutants")).drop(*[f"__{s}" for s in STRATEGIES])
    still = F.lit(None).cast("boolean")
    for r in rules:
        still = F.when(F.col("rule_id") == r.rule_id, F.forall("__mutants", _matching(r.regex()))).otherwise(still)
    c = F.col("confidence")
    checked = made.withColumn("survives", F.when(c >= least, still)).drop("__mutants")
    return checked.withColumn("confidence", F.when(F.col("survives").isNull(), c).when(F.col("survives"), F.greatest(c - 0.2, F.lit(0.1))).otherwise(F.least(c + 0.15, F.lit(0.99))))
