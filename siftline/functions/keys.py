"""Normal forms of keys and enumerated values, as column expressions and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may surround a key: ASCII blanks and the no-break space.
BLANKS = " \t\n\r\x0b\x0c "

#: The states of an issue, as they are written in results.
STATES = ("open", "confirmed", "fixed", "wontfix", "false_positive", "baselined")


def key_of(c: Column) -> Column:
    """Key without surrounding white space and case; NULL for a null or blank one, which is no key."""
    t = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(t != "", t)


def squeezed(c: Column) -> Column:
    """Lower case without white space, hyphens and underscores; NULL when nothing is left."""
    t = F.translate(F.lower(c), BLANKS + "-_", "")
    return F.when(t != "", t)


def state_of(c: Column) -> Column:
    """Canonical state; a value outside the known ones keeps its squeezed form."""
    s = squeezed(c)
    return F.when(s == "falsepositive", "false_positive").otherwise(s)


def text_of(c: Column) -> Column:
    """Comparable text: trimmed, lower case, blank as NULL."""
    return key_of(c)


SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def sql_key(c: str) -> str:
    return f"nullif(lower(trim({c}, {SQL_BLANKS})), '')"


def sql_squeezed(c: str) -> str:
    return f"nullif(translate(lower({c}), {SQL_BLANKS} || '-_', ''), '')"


def sql_state(c: str) -> str:
    s = sql_squeezed(c)
    return f"case when {s} = 'falsepositive' then 'false_positive' else {s} end"
