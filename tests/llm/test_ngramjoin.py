import random

import numpy as np

from plumbline.llm import graph
from plumbline.llm.ngramjoin import near_duplicates, wide_parity
from plumbline.session import durable
from tests.llm import brute


def fixture():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    docs, passage = [], " ".join(rng.choices(vocabulary, k=60))
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.choice([1, 4, 5, 6, 30, 80, 200]))
        docs.append((10 * k + 1, " ".join(words)))
        for j in range(rng.choice([0, 0, 1, 4])):  # chains of edits: near, nearer and too far
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((10 * k + 2 + j, " \t".join(words).upper() if j % 2 else "\n".join(words)))
        if k % 4 == 0:
            docs.append((10 * k + 9, passage + " " + " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 15, 40])))))
    docs += [(2000 + k, docs[5][1]) for k in range(30)]
    docs += [(3000, None), (3001, ""), (3002, " \t "), (3003, "one"), (3004, "ONE"), (3005, "a b c d"), (3006, "a b c e"), (3007, "x " * 4000), (3008, "É é"), (3009, "é é")]
    return docs


def test_matches_all_pairs(spark):
    docs = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text as id", "doc_id", "text", "1 as n", "2 as token")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(d).collect()}
    expected = brute.jaccard_components(docs)
    assert got == expected
    assert len({c for _, c in expected.values()}) < len(docs) - 40


def test_empty_and_repeated(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (None, "a b c")], "doc_id long, text string")
    assert near_duplicates(d.limit(0)).count() == 0
    got = sorted((r["doc_id"] or 0, r["n_shingles"]) for r in near_duplicates(d).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 0)]


def test_a_common_passage_costs_no_square(spark, monkeypatch):
    """A pair that shares many crowded shingles is one row and not one for each of them; no link is lost."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(70)]
    docs = [(k, " ".join([*(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([12, 13, 14]))), *passage])) for k in range(90)]
    docs += [(100 + k, text + " " + " ".join(f"z{k}" for _ in range(3))) for k, (_, text) in enumerate(docs[:20])]
    rows, paired = [], graph.crowded
    monkeypatch.setattr(graph, "crowded", lambda *given: rows.append(durable(paired(*given))) or rows[-1])
    monkeypatch.setattr(graph, "CROWD", 8)
    monkeypatch.setattr(graph, "BLOCK", 30)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_components(docs)
    assert len({c for _, c in got.values()}) == 90
    pairs = [(r["a_id"], r["b_id"]) for r in rows[0].collect()]
    assert len(pairs) == len(set(pairs)) > 0


def test_wide_bitmaps_rule_out_no_link(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    docs = [(k, " ".join([*words, *(f"x{k}y{j}" for j in range(n))])) for k, n in enumerate([0, 300, 333, 600, 660, 700, 1500])]
    docs += [(10 + k, " ".join(words[k * 50 :])) for k in range(1, 30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_components(docs)


def test_wide_bitmaps_of_any_two_sizes_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m in ((257, 600), (1000, 1010), (5000, 400)):
        values = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        values[n : n + min(n, m) // 2] = values[: min(n, m) // 2]
        x, y = (np.frombuffer(w, np.uint64) for w in wide_parity(values, np.array([0, n, n + m])))
        x, y = sorted((x, y), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert 0 < np.bitwise_count(x ^ y).sum() <= n + m - 2 * (min(n, m) // 2)
