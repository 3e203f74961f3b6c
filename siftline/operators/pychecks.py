"""Checks of Python sources by the standard parser, one findings row per defect; sources are never run."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siftline.operators.pysource import _dotted

SCHEMA = "file string, rule_id string, start_line int, severity string, confidence double, message string, category string, cwe string"
#: Calls that may return nothing, that open and that close a resource, and names that guard or act.
MAYBE_NONE = ("get", "find_one", "first", "match", "search", "fullmatch")
OPENERS, CLOSERS, USERS = ("open", "connect", "acquire"), ("close", "disconnect", "release"), ("read", "write", "send", "recv", "execute", "fetch")
GUARDS = re.compile(r"login_required|require_|is_authenticated|check_permission|authorize|has_role|current_user")
SENSITIVE = re.compile(r"^(?:delete|remove|drop|transfer|grant|reset|refund|promote)_?")
EXTERNAL = ("post", "request", "send", "call", "transfer", "publish")


class _Function(ast.NodeVisitor):
    """Facts of one function body in source order."""

    def __init__(self, node: ast.FunctionDef):
        self.node, self.steps, self.guarded = node, [], set()
        for child in node.body:
            self.visit(child)

    def visit_FunctionDef(self, node):  # a nested function is its own
        pass

    visit_AsyncFunctionDef = visit_Lambda = visit_ClassDef = visit_FunctionDef

    def visit_Assign(self, node):
        self.visit(node.value)
        for t in node.targets:
            if isinstance(t, ast.Name):
                call = _dotted(node.value.func) if isinstance(node.value, ast.Call) else ""
                self.steps.append(("set", t.id, call, node.lineno))
            elif isinstance(t, ast.Attribute):
                self.steps.append(("state", _dotted(t), "", node.lineno))
            else:
                self.visit(t)

    def visit_AugAssign(self, node):
        self.visit(node.value)
        if isinstance(node.target, ast.Attribute):
            self.steps.append(("state", _dotted(node.target), "", node.lineno))

    def visit_If(self, node):
        for x in ast.walk(node.test):
            if isinstance(x, ast.Name):
                self.guarded.add(x.id)
        names = {x.id for x in ast.walk(node.test) if isinstance(x, ast.Name)}
        exists = any(isinstance(x, ast.Call) and _dotted(x.func).split(".")[-1] in ("exists", "isfile", "has", "contains") for x in ast.walk(node.test))
        if exists:
            for c in (y for s in node.body for y in ast.walk(s) if isinstance(y, ast.Call)):
                if names & {x.id for a in c.args for x in ast.walk(a) if isinstance(x, ast.Name)}:
                    self.steps.append(("toctou", _dotted(c.func), "", c.lineno))
                    break
        self.generic_visit(node)

    def visit_Call(self, node):
        self.generic_visit(node)
        self.steps.append(("call", _dotted(node.func), "", node.lineno))

    def visit_Attribute(self, node):
        if isinstance(node.value, ast.Name):
            self.steps.append(("use", node.value.id, node.attr, node.lineno))
        self.generic_visit(node)

    def visit_Subscript(self, node):
        if isinstance(node.value, ast.Name):
            self.steps.append(("use", node.value.id, "[]", node.lineno))
        self.generic_visit(node)

    def visit_With(self, node):
        for i in node.items:
            if isinstance(i.optional_vars, ast.Name):
                self.steps.append(("managed", i.optional_vars.id, "", node.lineno))
        self.generic_visit(node)


def _function_checks(node: ast.FunctionDef) -> Iterator[tuple]:
    f = _Function(node)
    maybe, opened, closed, managed, external = {}, {}, {}, set(), None
    used = {x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)}
    for kind, name, detail, line in f.steps:
        last = (detail or name).split(".")[-1]
        if kind == "set":
            maybe.pop(name, None)
            if last in MAYBE_NONE and "." in detail:
                maybe[name] = line
            if last in OPENERS:
                opened[name] = line
                closed.pop(name, None)
            if name not in used and not name.startswith("_"):
                yield "unused-variable", line, "low", 0.75, f"{name} is never read", "maintainability", "CWE-563"
        elif kind == "managed":
            managed.add(name)
        elif kind == "use":
            if name in maybe and name not in f.guarded:
                yield "maybe-none", line, "medium", 0.75, f"{name} may be None here", "reliability", "CWE-476"
                maybe.pop(name)
            if name in closed and detail in USERS:
                yield "use-after-close", line, "high", 0.8, f"{name} is used after it was closed", "reliability", "CWE-416"
            if detail in CLOSERS:
                if name in closed:
                    yield "double-close", line, "medium", 0.8, f"{name} is closed twice", "reliability", "CWE-675"
                closed[name] = line
                opened.pop(name, None)
        elif kind == "toctou":
            yield "check-then-act", line, "medium", 0.7, f"{name} acts on what was only tested before", "concurrency", "CWE-367"
        if kind == "call" and last in EXTERNAL and external is None:
            external = line
        if kind == "state" and external is not None and line > external:
            yield "state-after-call", line, "medium", 0.7, f"{name} changes after an external call", "concurrency", "CWE-841"
            external = None
    for name, line in opened.items():
        if name not in managed and not any(isinstance(x, ast.Return) and isinstance(x.value, ast.Name) and x.value.id == name for x in ast.walk(node)):
            yield "never-closed", line, "medium", 0.75, f"{name} is not closed", "reliability", "CWE-772"
    if not GUARDS.search(ast.unparse(node)):
        for kind, name, _, line in f.steps:
            if kind == "call" and SENSITIVE.match(name.split(".")[-1]):
                yield "sensitive-without-guard", line, "high", 0.7, f"{name} without a guard in {node.name}", "security", "CWE-862"
    for d in [*node.args.defaults, *node.args.kw_defaults]:
        if isinstance(d, (ast.List, ast.Dict, ast.Set)):
            yield "shared-default", node.lineno, "low", 0.9, f"{node.name} shares a default", "correctness", "CWE-1188"
    doc = ast.get_docstring(node) or ""
    named = set(re.findall(r":param (?:\w+ )?(\w+):", doc))
    have = {a.arg for a in node.args.posonlyargs + node.args.args + node.args.kwonlyargs}
    for extra in sorted(named - have):
        yield "documentation-drift", node.lineno, "info", 0.8, f"{extra} is documented but no parameter of {node.name}", "maintainability", ""
    for x in ast.walk(node):
        if isinstance(x, ast.ExceptHandler) and (x.type is None or _dotted(x.type) in ("Exception", "BaseException")) and all(isinstance(b, ast.Pass) for b in x.body):
            yield "swallowed-exception", x.lineno, "low", 0.8, "every error is dropped", "reliability", "CWE-396"


def checks(file: str, source: str | None) -> list[tuple]:
    if source is None:
        return []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(file, "parse-error", getattr(e, "lineno", 0) or 0, "info", 1.0, type(e).__name__, "correctness", "")]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out += [(file, *x) for x in _function_checks(node)]
        elif isinstance(node, ast.Call) and _dotted(node.func) in ("eval", "exec") and node.args and not isinstance(node.args[0], ast.Constant):
            out.append((file, "evaluates-variable", node.lineno, "critical", 0.8, "code is made from a variable", "security", "CWE-95"))
    return sorted(set(out), key=lambda r: (r[2], r[1], r[5]))


def python_checks(files: DataFrame) -> DataFrame:
    """Findings of (file, content); a file that does not parse gives one ``parse-error`` row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for f, c in zip(b["file"], b["content"]) for r in checks(f, c if isinstance(c, str) else None)]
            yield pd.DataFrame(rows, columns=["file", "rule_id", "start_line", "severity", "confidence", "message", "category", "cwe"])

    return files.select("file", "content").mapInPandas(run, SCHEMA)
