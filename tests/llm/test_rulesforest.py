import random
import re

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import rulesforest
from plumbline.llm.queries import QUERIES


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    places = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(places), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)), "n_digits": len(re.findall("[0-9]", text)),
    }


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"wörd{rng.randrange(400)}" for _ in range(rng.choice([30, 90, 250]))]
        poor = k % 20 == 0
        if poor:
            words = [w + "###" for w in words] if k % 40 else [w.upper() for w in words]
        rows.append((k, " ".join(words), int(not poor)))
    return rows


def test_counts_equal_plain_ones(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "\n\nx\n\nx\n", "a\r\nb\na\r\nb\n a", "a\0b\na\0b", "é" * 40 + "\n|<>", "a b c d e f g h " * 3, "a a a a a a a a", "a a a a a a a a a"]
    texts += ["\n".join(" ".join(rng.choice(["ab", "Cü", "7", "#*"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in rulesforest.statistics(docs.selectExpr("*", "1 as kept")).collect():
        assert {c: r[c] for c in rulesforest.COUNTS} == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_held_out_rows(spark):
    rows = corpus(1600, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(None, 1), (5, None), (99999, 0)], "doc_id long, quality int")
    forest = rulesforest.fit(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in rulesforest.judge(docs, forest).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([got[i] for i, _, good in held if good]) > 0.97
    assert np.mean([got[i] for i, _, good in held if not good]) < 0.1


def test_edge_rows(spark):
    long = " ".join(f"word{k}" for k in range(300_000))
    rows = [(1, None), (1, None), (2, ""), (3, "a b"), (4, long), (None, "x " * 30), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'y' as kept_by", "2 as source")
    none = rulesforest.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = rulesforest.judge(docs, none).collect()
    assert len(got) == 7 and all(r["kept"] == (r["doc_id"] in (4, 5)) for r in got)
    assert {(r["base_failed"], r["n_repeat_words"]) for r in got if r["doc_id"] is None} == {(True, 30)}
    one = rulesforest.fit(docs, spark.createDataFrame([(4, 1), (4, 0)], "doc_id long, quality int"))
    assert rulesforest.judge(docs.limit(0), one).count() == 0
    same = {r["anomaly"] for r in rulesforest.judge(docs, one).collect() if r["doc_id"] in (4, 5)}
    assert len(same) == 1


def test_path_lengths_of_a_tree():
    x = np.array([[0.0], [0.0], [5.0], [9.0]])
    feature, value, lengths = rulesforest.grow(x, np.random.default_rng(0), depth=3)
    forest = rulesforest.Forest(feature[None], value[None], lengths[None], 4, np.full(4, np.inf))

    def length(v):
        own, node, level = np.arange(4), 0, 0
        while level < 3 and len(own) > 1 and len(set(x[own, 0])) > 1:
            right = x[own, 0] >= value[node]
            own, node, level = own[right if v >= value[node] else ~right], 2 * node + 1 + (v >= value[node]), level + 1
        return level + float(rulesforest.expected_length(len(own)))

    expected = float(rulesforest.expected_length(4))
    assert np.allclose(forest.score(x), [2 ** (-length(v) / expected) for v in x[:, 0]])


def test_query_over_the_whole_table(spark):
    got = QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert {c: r[c] for c in rulesforest.BASE} == {c: want[c] for c in rulesforest.BASE}
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_every_labelled_row_counts(spark):
    """Poor rows are among those that a draw of 8,000 of 9,000 by a hash leaves out; without them nothing is cut off."""
    ids = spark.range(9000).selectExpr("id as doc_id", "pmod(xxhash64(id), 1000003) >= 8000 / 9000 * 1000003 and id % 7 = 0 as poor")
    docs = ids.selectExpr("doc_id", "array_join(transform(sequence(1, 30), k -> concat('word', (doc_id * k) % 97, if(poor, '###', ''))), ' ') as text")
    labels = ids.selectExpr("doc_id", "if(poor, 0, 1) as quality")
    counted = rulesforest.statistics(docs)
    tree, node, n, _, _ = rulesforest._extents(counted, rulesforest.Growing(rulesforest.TREES), 0, 3)
    assert n.sum() == 27_000 and len(set(tree)) == rulesforest.TREES and not node.any()
    judged = rulesforest.judge_counted(counted, rulesforest.fit_counted(counted, labels)).where("not base_failed").join(labels, "doc_id")
    kept = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] >= 0.99 and kept[0] < 0.1


def test_rows_are_dealt_to_different_trees():
    row, tree = rulesforest.dealt(np.arange(-500, 500), 7)
    assert sorted(row) == sorted(list(range(1000)) * 7)
    assert len(set(zip(row, tree, strict=True))) == 7000 and set(tree) == set(range(rulesforest.TREES))
