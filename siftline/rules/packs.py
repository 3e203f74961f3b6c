"""Rule packs built from the table of risky functions, as YAML texts like any other pack.

Every function of a language gives three rules: any call of it, a call with a value from a variable, and a call with text put
together on the spot; the last two are the worse the more the argument may come from outside.  A pack is the YAML text of one
language; the packs in ALWAYS are loaded whatever the files are.
"""

from __future__ import annotations

import functools
import re

from siftline.operators.scan import LANGUAGES, Rule
from siftline.rules.apis import APIS, KINDS

_LOWER = {"critical": "high", "high": "medium", "medium": "low", "low": "info", "info": "info"}
#: Before a function's name no character of a longer name may stand.
_START = r"(?<![\w.:$])"


def _variants(name: str, severity: str) -> list[tuple[str, str, str]]:
    call = _START + re.escape(name) + r"\s*\("
    return [
        ("called", call, _LOWER[severity]),
        ("with-variable", call + r"\s*[$@&]?[A-Za-z_]\w*\s*[,)]", severity),
        ("with-joined-text", call + r"[^)]*[\"']\s*(?:\+|\.\.?|%|<<|&)\s*[$@]?[A-Za-z_]", severity),
    ]


def pack_rules(language: str) -> list[dict]:
    """The rules of a language's pack, as they stand in its YAML text."""
    out = []
    for kind, names in APIS[language].items():
        severity, cwe, message = KINDS[kind]
        for name in names.split():
            slug = re.sub(r"[^a-z0-9_]+", "-", name.lower().replace("!", "-bang")).strip("-")
            for variant, pattern, level in _variants(name, severity):
                out.append({
                    "id": f"{language}-{kind}-{slug}-{variant}", "pattern-regex": pattern, "severity": level, "message": f"{name} {message}",
                    "languages": [language], "metadata": {"cwe": cwe},
                })
    return out


def pack_yaml(language: str) -> str:
    import yaml

    return yaml.safe_dump({"rules": pack_rules(language)}, sort_keys=False)


#: Packs that are loaded for all files: secrets and marks that are no matter of language.
ALWAYS = {
    "secrets": """
rules:
  - {id: any-private-key, pattern: '-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----', severity: critical, message: private key, metadata: {cwe: CWE-321}}
  - {id: any-assigned-secret, pattern: '/(?:password|passwd|secret|api_?key|token)\\s*[:=]\\s*["''][^"'']{6,}["'']/i', severity: critical, message: secret in a literal, metadata: {cwe: CWE-798}}
""",
    "marks": """
rules:
  - id: any-unfinished
    pattern-either: [{pattern: 'TODO'}, {pattern: 'FIXME'}, {pattern: 'XXX:'}]
    severity: note
    message: unfinished work
""",
}


@functools.lru_cache(maxsize=None)
def _loaded(name: str) -> tuple[Rule, ...]:
    from siftline.sources.inputs import rules_of

    return tuple(rules_of(ALWAYS[name] if name in ALWAYS else pack_yaml(name)))


def load(names: list[str]) -> list[Rule]:
    """The rules of packs."""
    return [r for n in names for r in _loaded(n)]


def selected(files, file: str = "file") -> list[str]:
    """Packs for a frame of files: those of the languages that occur, and those for all files.  At most one row per language reaches the driver."""
    from pyspark.sql import functions as F

    from siftline.operators.scan import language_of

    found = {r[0] for r in files.select(language_of(F.col(file)).alias("l")).distinct().collect()}
    # a pack of JavaScript serves TypeScript too
    found |= {"javascript"} if "typescript" in found else set()
    return [*ALWAYS, *sorted(found & APIS.keys())]


def names() -> list[str]:
    return [*ALWAYS, *APIS]


assert set(APIS) <= set(LANGUAGES.values())
