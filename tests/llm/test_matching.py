import random

from siftline.llm import matching
from siftline.runtime import work_dir

LEFT = "hit_id long, rule_id string, file string, line int, message string, cwe string, id string, text string"
RIGHT = "ast_id long, rule_id string, file string, line int, description string, cwe string, id string, text string"
KINDS = [("path-escape", "OPEN-FREE", "22"), ("log-forging", "RAW-LOG", "117"), ("debug-left-on", "DEBUG-CONST", "489"), ("wait-forever", "NO-LIMIT", "1088")]


def made(seed, n):
    r = random.Random(seed)
    left, right, truth = [], [], set()
    for i in range(n):
        a, b, cwe = r.choice(KINDS)
        name = "trim_" + "".join(r.choice("bdfgklm") + r.choice("aeiou") for _ in range(4))
        file, line = f"core/x{r.randrange(12)}/main.py", r.randrange(1, 3000)
        left.append((i, f"python-{a}", file, line, f"In {name}: thing is bad." if r.random() < 0.8 else "Thing is bad", f"CWE-{cwe}" if r.random() < 0.8 else None, "q", None))
        if r.random() < 0.7:
            say = f"'{name}()' - bad" if r.random() < 0.8 else "Bad"
            right.append((1000 + i, f"AST-PY-{b}", "/builds/w1/" + file, line + r.randrange(-3, 4), say, cwe if r.random() < 0.8 else "", "q", None))
            truth.add((i, 1000 + i))
        else:
            a2, b2, cwe2 = r.choice(KINDS)
            right.append((1000 + i, f"AST-PY-{b2}", file, line + r.randrange(-3, 4), f"'pack_{i}zuzu()' - bad", cwe2, "q", None))
    return left, right, truth


def run(spark, left, right):
    a = matching.parts(spark.createDataFrame(left, LEFT), "hit_id", "message")
    b = matching.parts(spark.createDataFrame(right, RIGHT), "ast_id", "description")
    return matching.matches(a, b, work_dir(spark, "t")).collect()


def test_finds_the_true_pairs(spark):
    left, right, truth = made(3, 500)
    left += [left[0], (None, None, None, None, None, None, None, None), (5001, "r", "f", None, "x", "", "", "")]
    rows = run(spark, left, right)
    got = {(r["left_id"], r["right_id"]) for r in rows}
    assert len(rows) == len(got) and all(0.5 <= r["confidence"] <= 1 for r in rows)
    assert len(got & truth) / len(truth) > 0.9 and len(got & truth) / len(got) > 0.9


def test_transitivity():
    import numpy as np

    g = matching.transitive(np.array([0.9, 0.8, 0.7, 0.6]), np.array([1, 1, 1, 2]), np.array([5, 5, 7, 7]))
    assert np.allclose(g, [0.9, 0.8, 0.1, 0.6])


def test_empty_tables(spark):
    left, right, _ = made(1, 20)
    assert run(spark, [], []) == run(spark, left, []) == run(spark, [], right) == []
