import hashlib
import math
import random
from collections import Counter

import pytest

from plumbline.operators import embedding, retrieval
from plumbline.plans.queries import documents, rules

WORDS = [f"{a}{b}" for a in ("lo", "mi", "ra", "su", "te", "vo") for b in ("nek", "pol", "dar", "gis", "hut", "bem", "cax")]


def texts(n, rng, low=1, high=40):
    """Few words are common and most are rare, as in prose; lengths differ a lot."""
    weight = [1 / (k + 1) for k in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weight, k=rng.randint(low, high))) for _ in range(n)]


def brute(rules, chunks, k, decimals=6):
    """All pairs scored one by one, unrounded."""
    both = [Counter(t.split()) for _, t in [*rules, *chunks]]
    df = Counter(w for c in both for w in c)
    idf = {w: math.log((len(both) + 1) / (n + 1)) + 1 for w, n in df.items()}
    raw = [{w: (1 + math.log(n)) * idf[w] for w, n in c.items()} for c in both]
    unit = [{w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for v in raw]
    out = {}
    for (rule, _), v in zip(rules, unit, strict=False):
        scores = [(sum(x * u.get(w, 0) for w, x in v.items()), c) for (c, _), u in zip(chunks, unit[len(rules) :], strict=True)]
        out[rule] = sorted(((-round(s, decimals), c, s) for s, c in scores))[:k]
    return out


@pytest.mark.parametrize(("k", "seed"), [(1, 1), (3, 2), (7, 3)])
def test_bounded_top_k_equals_all_pairs(spark, k, seed):
    rng = random.Random(seed)
    asked = [(f"r{i}", t) for i, t in enumerate(texts(12, rng, 2, 9))] + [("r98", "nothing shared"), ("r99", WORDS[-1])]
    held = [(i, t) for i, t in enumerate(texts(220, rng))]
    held += [(1000 + i, held[i % 5][1]) for i in range(20)] + [(2000, ""), (2001, "other")]  # copies tie
    got = retrieval.top_chunks(spark.createDataFrame(asked, "rule_id string, text string"), spark.createDataFrame(held, "chunk_id long, text string").repartition(3), k)
    found = {}
    for r in got.collect():
        found.setdefault(r["rule_id"], {})[r["rank"]] = (r["chunk_id"], r["score"])
    for rule, want in brute(asked, held, k).items():
        assert sorted(found[rule]) == list(range(1, k + 1))
        for rank, (negative, chunk, score) in enumerate(want, 1):
            assert abs(found[rule][rank][1] - score) < 2e-6, (rule, rank)
            assert found[rule][rank][0] == chunk or abs(found[rule][rank][1] + negative) < 2e-6  # a tie that rounding decides


def test_groups_are_ranked_apart(spark):
    rng = random.Random(9)
    parts = {g: ([(f"r{i}", t) for i, t in enumerate(texts(4, rng, 2, 6))], [(f"c{i}", t) for i, t in enumerate(texts(30, rng))]) for g in ("a", "b")}
    asked = spark.createDataFrame([(g, *r) for g, (rs, _) in parts.items() for r in rs], "g string, rule_id string, text string")
    held = spark.createDataFrame([(g, *c) for g, (_, cs) in parts.items() for c in cs], "g string, chunk_id string, text string")
    got = {(r["g"], r["rule_id"], r["rank"]): r["score"] for r in retrieval.top_chunks(asked, held, 3, ["g"]).collect()}
    assert len(got) == 2 * 4 * 3
    for g, (rs, cs) in parts.items():
        for rule, want in brute(rs, cs, 3).items():
            assert all(abs(got[g, rule, n] - w[2]) < 2e-6 for n, w in enumerate(want, 1))


def test_few_pairs_are_candidates(spark):
    folder = "/root/testdata/sf0.01"
    chunks = documents(spark, folder).selectExpr("doc_id as chunk_id", "text")
    index = retrieval.postings(rules(spark, folder), chunks, [])
    tokens = retrieval.split_tokens(index, retrieval.thresholds(index, 3))
    meeting = index.asked.join(index.held, "token").select("rule_key", "chunk_key").distinct().count()
    joined = tokens.where("essential").join(index.held, ["band", "token"]).count()
    left = retrieval.candidates(index, tokens, 3).count()
    pairs = 40 * 1000
    assert left < 0.05 * pairs and left < 0.1 * meeting
    assert joined < 0.75 * index.asked.join(index.held, "token").count()


def test_groups_are_weighted_where_their_texts_are(spark, monkeypatch):
    """Vectors, peaks and hits equal those by joins, with empty texts and a group without rules; texts are the only rows dealt."""
    rng = random.Random(11)
    asked = [(f"g{g}", f"r{i}", t) for g in range(4) for i, t in enumerate(texts(3, rng, 2, 9))] + [("g1", "r9", "")]
    held = [(f"g{g}", i, t) for g in range(5) for i, t in enumerate(texts(12, rng))] + [("g2", 99, ""), ("g2", 98, None)]
    rules_, chunks = spark.createDataFrame(asked, "g string, rule_id string, text string"), spark.createDataFrame(held, "g string, chunk_id long, text string")

    def found():
        index = retrieval.postings(rules_, chunks, ["g"])
        tables = [sorted((*[round(v, 12) if isinstance(v, float) else v for v in r],) for r in t.collect()) for t in (index.asked, index.held, index.peaks)]
        return tables, sorted(tuple(r) for r in retrieval.top_chunks(rules_, chunks, 3, ["g"]).collect())

    within = found()
    monkeypatch.setattr(retrieval, "WITHIN", 0)
    assert found() == within
    docs = chunks.selectExpr("g", "false as rule", "cast(chunk_id as string) as doc", "text")
    totals = spark.createDataFrame([(f"g{g}", 15) for g in range(5)], "g string, total long").localCheckpoint()
    plan = retrieval.weighted_within(docs, totals, ["g", "rule", "doc"], ["g"], 15)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and not [x for x in plan.split("\n") if "Exchange" in x and "token" in x]


@pytest.mark.parametrize("group", [[], ["g"]])
def test_a_task_counts_few_documents(spark, monkeypatch, group):
    """Texts are dealt by their number, not by what a session joins into one partition."""
    monkeypatch.setattr(retrieval, "PART", 10)
    counted, counts = [], retrieval.term_counts
    monkeypatch.setattr(retrieval, "term_counts", lambda docs, keys: counted.append(docs.rdd.getNumPartitions()) or counts(docs, keys))
    chunks = spark.range(95).selectExpr("id as chunk_id", "'g' || id % 30 as g", "'lonek ' || id as text").coalesce(1)
    retrieval.postings(spark.createDataFrame([("r", "g1", "lonek")], "rule_id string, g string, text string"), chunks, group)
    assert counted == [10]


def test_hashed_buckets_deal_texts_only(spark):
    """One exchange, of texts; tokens and buckets are added up where they are."""
    from plumbline.plans.queries import QUERIES

    plan = QUERIES["q06_hash_bucket_norm"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1


@pytest.mark.parametrize("known", [0, embedding.VOCABULARY])
def test_hashed_vectors_leave_tokens_where_their_texts_are(spark, monkeypatch, known):
    monkeypatch.setattr(embedding, "VOCABULARY", known)
    rows = [(k, t) for k, t in enumerate(texts(60, random.Random(3)))] + [(60, ""), (61, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    fitted = embedding.HashingEmbedder(64, retrieval.md5_bucket).fit(docs.where("id < 50").select("text"))
    made = fitted.encode(docs)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark itself would broadcast so small a table
    try:
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ("hashpartitioning(token" in plan) == (known == 0)  # only a large vocabulary has them dealt
    got = {r["id"]: r["vector"] for r in made.collect()}
    fit = [Counter((t or "").split()) for _, t in rows[:50]]
    df = Counter(w for c in fit for w in c)
    for k, t in rows:
        want = [0.0] * 64
        for w, n in Counter((t or "").split()).items():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += (1 + math.log(n)) * (math.log(51 / (df[w] + 1)) + 1)
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert got[k] == pytest.approx([x / norm for x in want])
