import random

import pyarrow as pa

from plumbline.llm import decontaminate
from plumbline.llm.decontaminate import digest, find_contamination, remove_spans
from tests.llm import brute


def rows(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def fixture():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(12)] + ["Émile", "日本"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 14, 30])))) for k in range(12)] + [(12, None), (13, " .,- "), (3, "w1 W2 w3")]
    docs = [(k, ", ".join(rng.choices([*vocabulary, "zz"], k=rng.choice([0, 5, 60, 300])))) for k in range(60)]
    docs += [(100 + k, "zz " + (items[k][1] or "").upper() + " zz " + (items[k][1] or "")) for k in range(12)]
    docs += [(200, None), (201, ""), (202, "the " * 5000), (203, (items[5][1] + " ") * 40), (204, docs[3][1])]
    return docs, items


def test_matches_every_place(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "text", "doc_id as item_id", "'x' as hit_items")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.contamination(docs, items)
    assert rows(digest(find_contamination(d, b), "doc_id")) == expected
    in_blocks = digest(find_contamination(d, b, block_windows=60), "doc_id")
    assert rows(in_blocks) == expected


def test_removal_cuts_the_passages(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(d, b)
    cut = {r["doc_id"]: r["text"] for r in remove_spans(found).collect()}
    expected = brute.contamination(docs, items)
    for doc_id, text in docs:
        n_words, n_hit, *_ = expected[doc_id]
        assert len(brute.words(cut[doc_id])) == n_words - n_hit or n_hit == 0
        if not n_hit:
            assert cut[doc_id] == text


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(digest(find_contamination(d, b.limit(0)), "doc_id"))[1][4] is False
    assert digest(find_contamination(d.limit(0), b), "doc_id").count() == 0
    assert rows(digest(find_contamination(d, b), "doc_id"))[1][:3] == (3, 2, 1)


def test_a_task_indexes_a_block_at_a_time(monkeypatch):
    seen = []
    monkeypatch.setattr(decontaminate, "scan", lambda data, bounds, patterns: (seen.append(len(data)), [(0, [], [], [])] * (len(bounds) - 1))[1])
    column = pa.array(["x" * 700_000] * 5 + ["y" * 3_000_000])
    shared = type("Shared", (), {"value": None})
    names = ["__text", "n_words", "hit_spans", "removal_spans", "hit_items"]
    batch = pa.RecordBatch.from_arrays([column, *[pa.nulls(6)] * 4], names)
    out = list(decontaminate._pass(shared, 0, True)([batch]))
    assert sum(x.num_rows for x in out) == 6 and sorted(seen)[-1] == 3_000_000 and sorted(seen)[-2] <= 1 << 20
