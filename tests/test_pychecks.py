import pytest

from siftline.operators import pychecks

CASES = [
    ("maybe-none", "def f(d):\n    x = d.get('a')\n    return x.b\n", 1), ("maybe-none", "def f(d):\n    x = d.get('a')\n    if x:\n        return x.b\n", 0),
    ("use-after-close", "def f():\n    h = open('a')\n    h.close()\n    h.read()\n", 1), ("use-after-close", "def f():\n    h = open('a')\n    h.read()\n    h.close()\n", 0),
    ("double-close", "def f(h):\n    h.close()\n    h.close()\n", 1), ("never-closed", "def f():\n    h = open('a')\n    h.read()\n", 1),
    ("never-closed", "def f():\n    with open('a') as h:\n        h.read()\n", 0), ("never-closed", "def f():\n    h = open('a')\n    return h\n", 0),
    ("check-then-act", "def f(p, os):\n    if os.path.exists(p):\n        os.remove(p)\n", 1), ("check-then-act", "def f(p):\n    if p > 1:\n        g(p)\n", 0),
    ("state-after-call", "def f(self, bank):\n    bank.transfer(1)\n    self.total -= 1\n", 1), ("state-after-call", "def f(self, bank):\n    self.total -= 1\n    bank.transfer(1)\n", 0),
    ("sensitive-without-guard", "def f(db):\n    db.delete_user(1)\n", 1), ("sensitive-without-guard", "@login_required\ndef f(db):\n    db.delete_user(1)\n", 0),
    ("shared-default", "def f(a=[]):\n    return a\n", 1), ("documentation-drift", 'def f(a):\n    """x\n\n    :param a: y\n    :param b: z\n    """\n', 1),
    ("swallowed-exception", "def f():\n    try:\n        g()\n    except Exception:\n        pass\n", 1), ("evaluates-variable", "eval(x)\neval('1')\n", 1),
    ("unused-variable", "def f():\n    a = 1\n    b = 2\n    return b\n", 1), ("parse-error", "def (", 1),
]


@pytest.mark.parametrize("rule, source, n", CASES)
def test_checks(rule, source, n):
    assert sum(r[1] == rule for r in pychecks.checks("f.py", source)) == n


def test_over_a_table(spark):
    df = spark.createDataFrame([("a.py", "eval(x)"), ("b.py", None), ("c.py", "")], "file string, content string")
    assert [(r["file"], r["rule_id"]) for r in pychecks.python_checks(df).collect()] == [("a.py", "evaluates-variable")]


def test_facts_that_functions_state():
    from siftline.operators import pysource

    src = """
@deal.pre(lambda x: x > 0, "m")
def f(x, count):
    'The x must be positive. y must not be None.\\n\\n:param x: a\\n:raises KeyError: b'
    if x is None:
        raise ValueError("x")
    assert x < 9
    n = 2
    m = n * 3 - len(x)
    for i in range(3):
        n = n + 1
    k = -n if x else 0
    return 1 / (n - n), 4 % 3

class C:
    async def g(self):
        f(None, -1)
"""
    rows = pysource.facts("a.py", src)
    of = lambda kind: {(r[2], r[3], r[7]) for r in rows if r[1] == kind}
    assert of("contract") == {("f", "f", "pre|lambda x: x > 0")} and of("invariant") == {("f", "", "not (x is None)"), ("f", "", "x < 9")}
    assert of("guard") == {("f", "x", "not-none")} and of("promise") == {("f", "x", "positive"), ("f", "y", "not-none")}
    assert of("documented") == {("f", "x", "")} and of("documented_raise") == {("f", "KeyError", "")} and of("raises") == {("f", "ValueError", "")}
    assert of("interval") == {("f", "n", "2..2"), ("f", "m", "-inf..6")} and of("signature") == {("", "f", "x, count"), ("C", "g", "self")}
    assert of("constant") == {("f", "range", "3"), ("f", "ValueError", "'x'"), ("C.g", "f", "None"), ("C.g", "f", "-1")} | {x for x in of("constant") if x[1] == "deal.pre"}
    assert ("f", "count", "non-negative") in of("parameter")
    assert pysource.facts("b.py", "x = " + "-" * 20000 + "1")[0][1] == "error" and pysource.facts("c.py", None) == [] and pysource.facts("d.py", "") == []
    assert len(pysource.facts("e.py", "f(1)\n" * 300_000)) == 600_000
