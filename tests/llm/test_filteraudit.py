import itertools
import random
import re
from collections import Counter

import numpy as np

from plumbline.llm import filteraudit

DOCS = "doc_id long, source string, text string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Runs the filters one after the other in every order."""
    fails = {}
    for k, (doc_id, _, text) in enumerate(docs):
        text, w = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        found += "D" * bool(re.search(r"[#$%&*|]", text))
        fails[k] = found + "E" * (doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, _, t in docs))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = {}, Counter()
    for part in {s or "" for _, s, _ in docs}:
        own = [k for k, d in enumerate(docs) if (d[1] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in fails[k]}
                redundant = sum(f in fails[k] for k in own if k not in left)
                left -= gone
                shapley[part, f] += len(gone)
                alone = sum(fails[k] == f for k in own)
                lost = [sum(docs[k][0] in s for k in gone) for s in (good, toxic)]
                out[part, "".join(order), step] = (len(left), len(gone), redundant, alone, *lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    given = spark.createDataFrame([(*d, "x", 9) for d in docs], DOCS)
    rows = filteraudit.audit(given, spark.createDataFrame(labels, LABELS)).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in filteraudit.MEASURES) for r in rows}, len(rows)


def test_equals_running_the_filters(spark):
    rng = random.Random(3)
    texts = [None, "", "a\0b c", "x " * 70, " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60)) + " #", "ÄÖ " + "Q" * 9]
    texts += [" ".join(rng.choice(["ab", "CD", f"k{rng.randrange(99)}", "|"]) for _ in range(rng.choice([20, 50, 80]))) for _ in range(12)]
    texts.append(" ".join(f"long{k}" for k in range(400_000)))
    docs = [(k, rng.choice(["s", "t", "", None]), rng.choice(texts)) for k in range(80)]
    docs += [(3, "s", "a\0b c"), (3, "s", "a\0b c"), (3, "t", "a\0b c"), (None, "s", ""), (None, None, "x " * 70), (500, "t", texts[-1]), (-5, "s", None)]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 80, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    got, n = audited(spark, docs, labels)
    assert n == len(got) == 3 * 600
    assert got == brute(docs, labels)


def test_no_rows(spark):
    assert audited(spark, [], [(1, 1, 1)]) == ({}, 0)
    assert audited(spark, [(1, "s", "x")], [])[1] == 600


def test_table_of_first_failures():
    for mask, order in itertools.product(range(32), range(120)):
        failed = [s for s, f in enumerate(filteraudit.ORDERS[order]) if mask >> "ABCDE".index(f) & 1]
        assert filteraudit.FIRST[mask, order] == (failed[0] if failed else 5)
    assert len(set(filteraudit.ORDERS)) == 120 and isinstance(filteraudit.FIRST, np.ndarray)
