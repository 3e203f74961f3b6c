import random

import numpy as np
import pytest

from siftline.llm import encoding
from siftline.runtime import work_dir

ALPHABET = ["word ", "naïve", "  ", "\n\n", "\t", "123", "日本語", "'s", "don't", "…", " ", "　", "🎉", "a", " ", "_", "!!", "<|endoftext|>"]


def brute(text):
    return encoding.encoder(encoding.vocabulary_path()).encode_ordinary(text or "")


def random_text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(ALPHABET) for _ in range(n))


@pytest.mark.parametrize("seed", range(20))
def test_joins_are_repaired_exactly(seed):
    r = random.Random(seed)
    text = random_text(seed, 120)
    cuts = sorted({0, *(r.randrange(len(text)) for _ in range(12)), len(text)})
    fix = encoding.JoinRepair(encoding.vocabulary_path())
    chunks = [(k == 0, brute(text[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert fix.whole(chunks) == brute(text)


def test_cuts_depend_on_content_only():
    passage = ("the quick brown fox jumps over the lazy dog and runs far away from home " * 9).encode()
    a, b = b"first start here " + passage, b"another, longer start of it " + passage
    ca = {len(a) - p for p in encoding.cut_places(np.frombuffer(a, np.uint8), np.array([0]))[0]}
    cb = {len(b) - p for p in encoding.cut_places(np.frombuffer(b, np.uint8), np.array([0]))[0]}
    inner = [x for x in ca if x < len(passage) - 40]
    assert inner and set(inner) <= cb


def test_corpus_agrees_with_encoding_whole_texts(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "   ", 0), (4, "x" * 20000, 1), (5, "日本" * 6000, 1), (6, "a b " * 5000, 1), (7, "<|endoftext|> it's", 1), (8, " " * 9000 + "end", 1)]
    rows += [(10 + i, random_text(i, 300), 1) for i in range(30)] + [(50, random_text(3, 300), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = {i: brute(t) for i, t, _ in rows}
    for frame in (encoding.encode_corpus(docs), encoding.encode_corpus_once(docs, work_dir(spark, "t"))):
        assert {r["doc_id"]: r["ids"] for r in frame.collect()} == want


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encoding.encode_corpus(docs).collect() == encoding.encode_corpus_once(docs, work_dir(spark, "t")).collect() == []
