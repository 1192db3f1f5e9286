import random

import numpy as np

from plumbline.llm.quality import Model, fit, grade


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(n):
        g = k % 3
        words = rng.choices(plain, k=rng.choice([30, 80]))
        if g == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "foul"]))
        if g == 1:
            words = [w + rng.choice(["###", "$$"]) for w in words]
        rows.append((k, " ".join(words), g))
    return rows


def test_held_out_grades(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4] + [(9999, 1), (None, 1), (1, None)], "doc_id long, grade int")
    model = fit(docs, ratings)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in grade(docs, model, tail=2).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert np.mean([got[i]["selected"] == (g == 2) for i, _, g in held]) > 0.95
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in got.values())


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "vile " * 3000), (3, "vile " * 3000), (None, "x")], "doc_id long, text string").selectExpr("*", "1 as selected")
    none = fit(docs, spark.createDataFrame([], "doc_id long, grade int"))
    rows = grade(docs, none, tail=2).collect()
    assert len(rows) == 5 and all(abs(r["expected_grade"] - 1) < 1e-9 for r in rows)
    assert grade(docs.limit(0), Model(np.zeros(1 << 18), np.zeros(2)), tail=1).count() == 0
