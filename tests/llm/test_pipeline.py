import random
import re

import pytest

import corpus_pipeline
from plumbline.llm.queries import PIECES, vocabulary
from tests.llm import brute
from tests.llm.test_linededup import by_edits

PASSAGES = [" ".join(f"bench{k}{j}" for j in range(14)) for k in range(3)]


def corpus():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su", "no") for b in ("ka", "ve", "dri", "po", "shen", "gul", "fa")]
    docs = []
    for k in range(40):
        docs.append((k, "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(4))))
    docs += [(50, docs[3][1]), (51, docs[4][1].replace("\n", " ")), (52, docs[4][1].replace("\n", " ") + " loka"), (53, None), (54, "12 .. 3"), (55, "word " * 3)]
    docs += [(60, "loka mive " + PASSAGES[0] + " rapo"), (61, PASSAGES[1]), (62, docs[5][1] + "\n" + docs[6][1].split("\n")[0])]
    return docs


def plain(spark, docs):
    """The five stages, each the plain way."""
    docs = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    gone = by_edits(docs)
    cut = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in docs]
    docs = [(i, t) for i, t in cut if not gone[i] or brute.words(t)]
    groups = brute.jaccard_components(docs)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    items = list(enumerate(PASSAGES))
    found = brute.contamination(docs, items)
    out = []
    for i, t in docs:
        if found[i][1]:
            if found[i][1] == found[i][0]:
                continue
            for p in PASSAGES:
                t = t.replace(p, "")
        out.append((i, t))
    return out


def test_run_equals_the_plain_stages(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = corpus()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain(spark, docs)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in want}
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    assert all(got[i] == model.encode(t) for i, t in want)
    assert {53, 54, 50, 52, 61, 62}.isdisjoint(got) and 60 in got


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(1, "ra lo", "en", "s", 5), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_language_rejects_what_no_filter_knows(spark, tmp_path):
    rng = random.Random(4)
    junk = {200: "".join(rng.choices("qxzjkv#$%&*0123456789 ", k=400)), 201: "Ωψ ωφγ ξζθ λμν " * 9, 202: "### 12 q --- 44 %% 7 ** 1"}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus()] + [(i, t, None, "s", len(t)) for i, t in junk.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert left == {i for i, _ in corpus()} - {53, 54}


def test_edges_of_every_stage(spark, tmp_path):
    """Repeated rows, a very long text, null ids, ties and extra columns."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su", "no") for b in ("ka", "ve", "dri", "po", "shen", "gul", "fa")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    long, one, two = text(120_000), text(40), text(40)
    rows = [(1, long), (2, one), (2, one), (3, one), (4, two), (None, text(30)), (5, None), (6, ""), (7, text(30))]
    rows = [(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, low long, lang_pred string")
    given.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == {1, 2, 4, None, 7} and got[1] == long and got[2] == one
