"""Comparable parts of a finding: kind of defect, file name, function and squeezed wording."""

from __future__ import annotations

import functools
import re

#: Words before the kind of defect in a rule's name (languages, scanners, packs).
PREFIXES = frozenset(
    "yaml ast deep top10 top25 owasp cert scan semgrep l0 python py java javascript js typescript ts go golang ruby rb php kotlin kt csharp cs c cpp rust scala swift dart".split()
)

_WORDS = re.compile(r"[a-z0-9]+")
_ODD = re.compile(r"[^a-z0-9]+")
#: Places where a message or description names the function.
_CUES = tuple((mark, re.compile(p)) for mark, p in (
    ("function", r"\(\s*function\s+([a-z0-9_.]+)\s*\)?"),
    ("()", r"(?<![a-z0-9_.])([a-z0-9_.]+)\(\)"),
    (":", r"^(?:\[[^\]]*\] )?in ([a-z0-9_.]+)\s*:"),
    (":", r"^(?:\[[^\]]*\] )?([a-z0-9_.]+)\s*:"),
    (", ", r"\(([a-z0-9_.]+), [a-z0-9_]+\)"),
    ("in ", r"\bin ['`]([a-z0-9_.]+)['`]\.?$"),
))
_SUFFIX = re.compile(r"(?:_v\d+|_?impl|_?async|_new|_old)$")


@functools.lru_cache(maxsize=65536)
def kind_of(rule: str | None) -> str:
    """Rule name without scanner, pack and language; blank for none."""
    words = _WORDS.findall((rule or "").lower())
    k = 0
    while k < len(words) - 1 and words[k] in PREFIXES:
        k += 1
    return "-".join(words[k:])


def path_parts(path: str | None) -> list[str]:
    return [p for p in (path or "").lower().replace("\\", "/").strip().split("/") if p not in ("", ".")]


@functools.lru_cache(maxsize=65536)
def base_name(path: str | None) -> str:
    parts = path_parts(path)
    return parts[-1].strip() if parts else ""


def squeeze(text: str | None) -> str:
    return _ODD.sub("", (text or "").lower())


def function_of(message: str | None) -> str:
    """The function a message names, without separators, qualifier and version suffix; blank when none is recognised."""
    m = " ".join((message or "").lower().split())
    for mark, cue in _CUES:
        found = cue.search(m) if mark in m else None
        if found:
            name = found.group(1).strip(".").split(".")[-1]
            return _ODD.sub("", _SUFFIX.sub("", name))
    return ""


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def edits_inside(name: str, text: str, most: int) -> int:
    """Fewest edits that turn ``name`` into some part of ``text``, or most + 1."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(name, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(min(row), most + 1)
