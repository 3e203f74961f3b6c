"""Facts of Python sources by the standard parser: functions, calls, imports, flows, contracts, guards, promises of documentation and intervals of numbers.

Sources are parsed, never run.  A file that does not parse gives one ``error`` row; files have any size, one at a time in a task.

Kinds of rows and their ``detail``: function (branches), signature (parameters), parameter, class, import (alias), call, argument (name), constant (value), flow (name),
made (constructor), access (attribute), contract (kind|condition), invariant (condition), guard (name that must not be None), promise (name is positive, negative or
not-none), documented (parameter), raises and documented_raise (exception), interval (lo..hi), zero_division (divisor).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file string, kind string, scope string, name string, line int, end_line int, position int, detail string"
BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.comprehension)
#: Decorators that state a contract, and names of values that are never negative.
CONTRACTS = ("pre", "post", "ensure", "invariant")
NON_NEGATIVE = frozenset("count size length amount price quantity age index total balance width height depth limit offset".split())
#: Kinds of rows that only ``_of_function`` gives.
STATED = frozenset("contract invariant guard promise documented documented_raise raises interval zero_division".split())
_PROMISE = re.compile(r"\b(\w+)\s+must (?:be (positive|negative|not None|non-null|greater than zero)|not be (None|null)\b)")
_PARAM, _RAISES = re.compile(r":param (?:\w+ )?(\w+):"), re.compile(r":raises? (\w+):")


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else "()" if isinstance(node, ast.Call) else ""


INF = float("inf")


class _Intervals(ast.NodeVisitor):
    """Bounds of numbers in one function, statement by statement: both ways of a branch are joined, what a loop changes is unbounded."""

    def __init__(self):
        self.known: dict[str, tuple[float, float]] = {}
        self.rows: list[tuple[str, str, int, str]] = []

    def value(self, e: ast.AST) -> tuple[float, float]:
        if isinstance(e, ast.Constant) and isinstance(e.value, (int, float)) and not isinstance(e.value, bool):
            return float(e.value), float(e.value)
        if isinstance(e, ast.Name):
            return self.known.get(e.id, (-INF, INF))
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub):
            lo, hi = self.value(e.operand)
            return -hi, -lo
        if isinstance(e, ast.BinOp):
            (a, b), (c, d) = self.value(e.left), self.value(e.right)
            if isinstance(e.op, ast.Add):
                return a + c, b + d
            if isinstance(e.op, ast.Sub):
                return a - d, b - c
            if isinstance(e.op, ast.Mult):
                ways = [0.0 if 0.0 in (x, y) else x * y for x in (a, b) for y in (c, d)]
                return min(ways), max(ways)
            if isinstance(e.op, (ast.Div, ast.FloorDiv, ast.Mod)):
                if c <= 0 <= d and (c, d) != (-INF, INF):
                    self.rows.append(("zero_division", ast.unparse(e.right), e.lineno, ""))
                if isinstance(e.op, ast.Mod) and c > 0:
                    return 0.0, d
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name):
            given = [self.value(x) for x in e.args]
            if e.func.id == "len":
                return 0.0, INF
            if e.func.id == "abs" and given:
                lo, hi = given[0]
                return (0.0 if lo <= 0 <= hi else min(abs(lo), abs(hi))), max(abs(lo), abs(hi))
            if e.func.id in ("min", "max") and len(given) > 1:
                f = min if e.func.id == "min" else max
                return f(g[0] for g in given), f(g[1] for g in given)
        return -INF, INF

    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and s.value is not None:
                targets = s.targets if isinstance(s, ast.Assign) else [s.target]
                value = self.value(ast.copy_location(ast.BinOp(targets[0], s.op, s.value), s) if isinstance(s, ast.AugAssign) else s.value)
                for t in targets:
                    if isinstance(t, ast.Name):
                        self.known[t.id] = value
                        if value != (-INF, INF):
                            self.rows.append(("interval", t.id, s.lineno, f"{value[0]:g}..{value[1]:g}"))
            elif isinstance(s, ast.If):
                before = dict(self.known)
                self.block(s.body)
                one, self.known = self.known, before
                self.block(s.orelse)
                self.known = {k: (min(one[k][0], v[0]), max(one[k][1], v[1])) for k, v in self.known.items() if k in one}
            elif isinstance(s, (ast.For, ast.While)):
                for x in ast.walk(s):
                    if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                        self.known.pop(x.id, None)
                self.block(s.body)
                for x in ast.walk(s):
                    if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                        self.known.pop(x.id, None)
            elif isinstance(s, (ast.With, ast.Try)):
                self.block(s.body)
            elif isinstance(s, (ast.Return, ast.Expr)) and s.value is not None:
                for x in ast.walk(s.value):
                    if isinstance(x, ast.BinOp) and isinstance(x.op, (ast.Div, ast.FloorDiv, ast.Mod)):
                        self.value(x)


def _of_function(file: str, inner: str, node: ast.FunctionDef) -> Iterator[tuple]:
    """What a function states about itself."""
    for d in node.decorator_list:
        name = _dotted(d.func).split(".")[-1] if isinstance(d, ast.Call) else ""
        if name in CONTRACTS:
            yield (file, "contract", inner, node.name, node.lineno, node.lineno, 0, f"{name}|{ast.unparse(d.args[0]) if d.args else ''}")
    for i, s in enumerate(node.body):
        if isinstance(s, ast.Assert):
            yield (file, "invariant", inner, "", s.lineno, s.lineno, 0, ast.unparse(s.test))
        if isinstance(s, ast.If) and len(s.body) == 1 and isinstance(s.body[0], ast.Raise) and not s.orelse:
            yield (file, "invariant", inner, "", s.lineno, s.lineno, 0, f"not ({ast.unparse(s.test)})")
            t = s.test
            if i < 5 and isinstance(t, ast.Compare) and isinstance(t.left, ast.Name) and isinstance(t.ops[0], ast.Is) and isinstance(t.comparators[0], ast.Constant) and t.comparators[0].value is None:
                yield (file, "guard", inner, t.left.id, s.lineno, s.lineno, i, "not-none")
    doc = ast.get_docstring(node) or ""
    for name, what, _ in _PROMISE.findall(doc):
        kind = "positive" if what in ("positive", "greater than zero") else "negative" if what == "negative" else "not-none"
        yield (file, "promise", inner, name, node.lineno, node.lineno, 0, kind)
    for name in _PARAM.findall(doc):
        yield (file, "documented", inner, name, node.lineno, node.lineno, 0, "")
    for name in _RAISES.findall(doc):
        yield (file, "documented_raise", inner, name, node.lineno, node.lineno, 0, "")
    for x in ast.walk(node):
        if isinstance(x, ast.Raise) and x.exc is not None:
            yield (file, "raises", inner, _dotted(x.exc.func if isinstance(x.exc, ast.Call) else x.exc), x.lineno, x.lineno, 0, "")
    bounds = _Intervals()
    bounds.block(node.body)
    for kind, name, line, detail in bounds.rows:
        yield (file, kind, inner, name, line, line, 0, detail)


def _children(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes below without contexts and operators, of which there are no facts."""
    for name in node._fields:
        if name not in ("ctx", "op", "ops"):
            value = getattr(node, name, None)
            if isinstance(value, ast.AST):
                yield value
            elif isinstance(value, list):
                for x in value:
                    if isinstance(x, ast.AST):
                        yield x


def _names(e: ast.AST) -> list[str]:
    """Names in an expression; most are one name or a constant."""
    if isinstance(e, (ast.Name, ast.Constant)):
        return [e.id] if isinstance(e, ast.Name) else []
    return [x.id for x in ast.walk(e) if isinstance(x, ast.Name)]


def facts(file: str, source: str | None, kinds: Collection[str] | None = None) -> list[tuple]:
    """Rows of (file, kind, scope, name, line, end_line, position, detail), of all kinds or those named."""
    if source is None:
        return []
    wanted = lambda *k: kinds is None or any(x in kinds for x in k)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(file, "error", "", "", getattr(e, "lineno", 0) or 0, 0, 0, type(e).__name__)] if wanted("error") else []
    stated, constants, arguments, flows = wanted(*STATED), wanted("constant"), wanted("argument"), wanted("flow")
    out: list[tuple] = []
    branches: dict[int, int] = {}  # by the place of a function's row
    todo: list[tuple[ast.AST, str, tuple[int, ...]]] = [(tree, "", ())]
    while todo:
        node, scope, around = todo.pop()
        below = []
        for child in _children(node):
            inner, within = scope, around
            if isinstance(child, BRANCHES):
                for i in around:
                    branches[i] += 1
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = f"{scope}.{child.name}" if scope else child.name
                within = (*around, len(out))
                branches[len(out)] = 1
                out.append((file, "function", scope, child.name, child.lineno, child.end_lineno, 0, ""))
                names = [a.arg for a in child.args.posonlyargs + child.args.args]
                out.append((file, "signature", scope, child.name, child.lineno, child.lineno, len(names), ", ".join(names)))
                for i, a in enumerate(names):
                    out.append((file, "parameter", inner, a, child.lineno, child.lineno, i, "non-negative" if a in NON_NEGATIVE else ""))
                if stated:
                    out.extend(_of_function(file, inner, child))
            elif isinstance(child, ast.ClassDef):
                inner = f"{scope}.{child.name}" if scope else child.name
                out.append((file, "class", scope, child.name, child.lineno, child.end_lineno, 0, ""))
            elif isinstance(child, ast.Import):
                out.extend((file, "import", scope, a.name, child.lineno, child.lineno, 0, a.asname or "") for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.extend((file, "import", scope, f"{child.module or ''}.{a.name}", child.lineno, child.lineno, 0, a.asname or "") for a in child.names)
            elif isinstance(child, ast.Call):
                name = _dotted(child.func)
                out.append((file, "call", scope, name, child.lineno, child.end_lineno, len(child.args), ""))
                for i, a in enumerate(child.args):
                    if constants and (isinstance(a, ast.Constant) or isinstance(a, ast.UnaryOp) and isinstance(a.operand, ast.Constant)):
                        out.append((file, "constant", scope, name, child.lineno, child.lineno, i, ast.unparse(a)))
                    out.extend((file, "argument", scope, name, child.lineno, child.lineno, i, x) for x in (_names(a) if arguments else ()))
            elif isinstance(child, ast.Assign):
                for t in child.targets:
                    if flows and isinstance(t, ast.Name):
                        out.extend((file, "flow", scope, t.id, child.lineno, child.lineno, 0, x) for x in _names(child.value))
                    if isinstance(t, ast.Name) and isinstance(child.value, ast.Call):
                        out.append((file, "made", scope, t.id, child.lineno, child.lineno, 0, _dotted(child.value.func)))
            elif isinstance(child, ast.Attribute) and isinstance(child.value, ast.Name):
                out.append((file, "access", scope, child.value.id, child.lineno, child.lineno, 0, child.attr))
            below.append((child, inner, within))
        todo.extend(reversed(below))
    for i, n in branches.items():
        out[i] = (*out[i][:7], str(n))
    return out if kinds is None else [r for r in out if r[1] in kinds]


#: Rows of a frame that a worker gives on; a file's rows stay together.
_FRAME = 50_000


def python_facts(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Facts of (file, content), of all kinds or those named."""
    kinds = None if kinds is None else frozenset(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["file", "kind", "scope", "name", "line", "end_line", "position", "detail"])
        for b in batches:
            rows: list[tuple] = []
            for f, c in zip(b["file"], b["content"]):
                rows += facts(f, c if isinstance(c, str) else None, kinds)
                if len(rows) >= _FRAME:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return files.select("file", "content").mapInPandas(run, SCHEMA)
