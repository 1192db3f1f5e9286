import hashlib
import random
from collections import Counter

import numpy as np

from plumbline.llm.fingerprint import edited_pairs, fingerprints, sample, successors


def fixture():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["été", "🎉", "...", "A"]
    docs = [(int(k * k % 1009) * 7 - 300, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 40, 200])))) for k in range(150)]
    docs = list({d[0]: d for d in docs}.values())
    return docs + [(-5000, None), (9000, ""), (9001, "?! ?!"), (9002, "?! ?!"), (9003, "é" * 3000)]


def test_edits_and_likeness(spark):
    docs = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("1 as part", "doc_id", "text", "'x' as copied")
    got = {r["doc_id"]: r for r in edited_pairs(frame).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    assert len(got) == len(docs)
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc_id]["n_chars"] == len(text)
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc_id]["near_edited"] <= 1 and (edited != text or got[doc_id]["near_edited"] == 1)
    assert got[9001]["fingerprint"] == got[9002]["fingerprint"] and got[9001]["near_next"] == 0 and got[9002]["near_next"] == 1
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints(frame).collect()}
    assert plain == {k: r["fingerprint"] for k, r in got.items()}


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(3)
    words = [f"x{k}" for k in range(40)]
    errors = []
    for _ in range(30):
        a = rng.choices(words, weights=range(1, 41), k=200)
        b = a[: rng.randrange(40, 200)] + rng.choices(words, weights=range(40, 0, -1), k=rng.randrange(10, 120))
        ca, cb = Counter(a), Counter(b)
        true = sum((ca & cb).values()) / sum((ca | cb).values())
        x, y = sample([" ".join(a).encode(), " ".join(b).encode()], 1500)
        errors.append(float((x == y).mean()) - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.025


def test_small_tables(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (3, "d e f g")], "doc_id long, text string")
    assert edited_pairs(frame.limit(0)).count() == 0
    assert edited_pairs(frame).count() == 4
    only = edited_pairs(frame.where("doc_id = 3")).collect()
    assert only[0]["near_next"] == 1 and only[0]["edited_sha256"] == hashlib.sha256(b"d e d e"[:4] + b"d e").hexdigest()
    assert successors(frame, 2).where("not copied").count() == 4
