from siftline.llm import encoding, mixing
from siftline.runtime import work_dir


def run(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    u = mixing.units(d, t, work_dir(spark, "t"))
    mix = mixing.mixture(u, t)
    return mix.collect(), {r["source"]: r for r in mixing.shares(mix, u, t).collect()}


def test_shares_and_repeats(spark):
    docs = [(i, f"large source text number {i} with some words", "large", None) for i in range(900)]
    docs += [(1000 + i, f"small one {i}", "small", None) for i in range(60)]
    docs += [(2000, "small one 1", "small", None), (2001, None, "small", None), (2002, "", "large", None), (2003, "no target", "other", None)]
    mix, shares = run(spark, docs, [("large", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2)])
    assert shares["none"]["reached_share"] == 0
    assert abs(shares["large"]["reached_share"] - 0.6 / 0.9) < 0.02
    assert abs(shares["small"]["reached_share"] - 0.3 / 0.9) < 0.02
    assert max(r["copies"] for r in mix if r["source"] == "small") <= 3
    assert not {r["doc_id"] for r in mix} & {2000, 2001, 2002, 2003}
    tokens = {r["doc_id"]: r["tokens"] for r in mix}
    enc = encoding.encoder(encoding.vocabulary_path())
    assert all(tokens[i] == len(enc.encode_ordinary(t)) for i, t, _, _ in docs if i in tokens)


def test_fraction_is_a_prefix_in_key_order(spark):
    d = spark.createDataFrame([(i, f"text {i} of words", "a") for i in range(400)] + [(900, "tiny", "b")], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 200)], "source string, target_share double, max_repeats int")
    u = mixing.units(d, t, work_dir(spark, "t"))
    chosen = {r["doc_id"] for r in mixing.mixture(u, t).where("source = 'a'").collect()}
    rest = mixing.budgets(u, t).where("source = 'a'").collect()[0]["left_over"]
    want, total = set(), 0
    for r in sorted(u.where("source = 'a'").collect(), key=lambda r: (r["key"], r["doc_id"])):
        total += r["tokens"]
        if total > rest:
            break
        want.add(r["doc_id"])
    assert chosen == want and 0 < len(want) < 400


def test_empty_tables(spark):
    mix, shares = run(spark, [], [("a", 1.0, 1)])
    assert mix == [] and shares["a"]["reached_share"] == 0
    mix, shares = run(spark, [(1, "x", "a", None)], [])
    assert mix == [] and shares == {}
