import hashlib
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import detectors, embedding, retrieval
from plumbline.plans import queries as Q
from plumbline.sources import stores, versions

ROWS = "k long, v string"


def table_at(spark, path):
    return versions.VersionedTable(spark, str(path), ROWS)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, ROWS)


def content(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_versions_stay_whole(spark, tmp_path):
    t = table_at(spark, tmp_path / "t")
    assert t.version() == 0 and content(t) == []
    t.append(rows(spark, [(1, "a"), (2, "b")]))
    t.append(rows(spark, [(3, "c")]))
    assert content(t) == [(1, "a"), (2, "b"), (3, "c")] and content(t, 1) == [(1, "a"), (2, "b")]
    merged = t.merge(rows(spark, [(2, "B"), (4, "d")]), ["k"])
    assert sorted(tuple(r) for r in merged.collect()) == content(t) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    with pytest.raises(versions.Conflict):
        t.replace(rows(spark, []), 2)
    assert t.swept(keep=1, older_than_ms=0) >= 3 and content(t) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]


@pytest.mark.parametrize("step", ["written", "draft", "rename"])
def test_a_crash_at_any_step_leaves_the_old_rows(spark, tmp_path, step, monkeypatch):
    t = table_at(spark, tmp_path / "t")
    t.append(rows(spark, [(1, "a"), (2, "b")]))
    held = t.read()  # a reader that began before

    class Crash(Exception):
        pass

    def broken(*_):
        raise Crash

    whole = {name: getattr(versions.VersionedTable, name) for name in ("_written", "_commit")}
    if step == "written":  # half of the files are there

        def half(self, df):
            whole["_written"](self, df.limit(1))
            raise Crash

        monkeypatch.setattr(versions.VersionedTable, "_written", half)
    elif step == "draft":
        monkeypatch.setattr(versions.VersionedTable, "_commit", broken)
    else:  # the manifest has been written, but not named

        def draft(self, version, folders):
            (tmp_path / "t" / "log" / ".draft").write_text("{")
            raise Crash

        monkeypatch.setattr(versions.VersionedTable, "_commit", draft)
    for write in (lambda: t.append(rows(spark, [(9, "z")])), lambda: t.merge(rows(spark, [(1, "A")]), ["k"])):
        with pytest.raises(Crash):
            write()
    monkeypatch.undo()
    assert content(t) == [(1, "a"), (2, "b")] == sorted(tuple(r) for r in held.collect())
    t.merge(rows(spark, [(1, "A")]), ["k"])
    assert content(t) == [(1, "A"), (2, "b")]
    t.swept(older_than_ms=0, keep=1)
    assert content(t) == [(1, "A"), (2, "b")] and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    t = table_at(spark, tmp_path / "t")
    errors = []

    def write(k):
        try:
            for n in range(3):
                t.append(rows(spark, [(10 * k + n, "x")]))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not errors and content(t) == [(10 * k + n, "x") for k in range(4) for n in range(3)] and t.version() == 12


class Counting:
    """Answers by the length of the prompt, and notes each question in a file."""

    def __init__(self, log):
        self.log = log

    def complete(self, system, user):
        with open(self.log, "a", encoding="utf-8") as out:
            out.write(hashlib.sha256(user.encode()).hexdigest() + "\n")
        if "of all numbered" in system or "all numbered rules" in system:
            return '[{"rule_id": "R0", "verdict": "COMPLIANT", "confidence": 0.9}]'
        if "AUTHORISED" in system:
            return '{"verdict": "AUTHORISED", "confidence": 0.8}'
        return '{"verdict": "COMPLIANT", "confidence": 0.7}'


@pytest.mark.parametrize("name", ["ranked", "whole-project", "reverse"])
def test_a_second_check_asks_nothing(spark, tmp_path, name):
    folder = "/root/testdata/sf0.001"
    chunks = Q.detector_chunks(spark, folder).where("n < 3")
    rules = Q.detector_rules(spark, folder, chunks)
    log, path = tmp_path / "asked", str(tmp_path / "answers")
    log.touch()
    seen = []
    for _ in range(2):
        judge = detectors.Judge(lambda log=str(log): Counting(log), stores.answer_store(spark, path))
        said = detectors.detect(name, rules, chunks.drop("n"), judge).collect()
        seen.append((judge.counts, sorted((r["workspace"], r["rule_id"], r["verdict"], r["parse_error"]) for r in said)))
    asked = log.read_text().split()
    (first, verdicts), (second, again) = seen
    assert verdicts == again and len(asked) == len(set(asked)) == first["misses"] > 0
    assert second == {"hits": first["misses"], "misses": 0}
    assert any(v == "COMPLIANT" for _, _, v, _ in verdicts)


def test_failed_questions_are_asked_again(spark, tmp_path):
    store = stores.answer_store(spark, str(tmp_path / "a"))
    asked = spark.createDataFrame([("aa1", "s", "u"), ("ab2", "s", "v"), ("aa1", "s", "u")], "key string, system string, user string")
    make = lambda missing: missing.select("key", F.when(F.col("user") == "u", F.lit("yes")).alias("response"))
    found = stores.looked_up(store, asked, make)
    assert (found.hits, found.misses) == (0, 2) and {(r["key"], r["response"], r["hit"]) for r in found.rows.collect()} == {("aa1", "yes", False), ("ab2", None, False)}
    again = stores.looked_up(store, asked, make)
    assert (again.hits, again.misses) == (1, 1)
    store.add(spark.createDataFrame([("aa1", "yes")], "key string, response string"))
    store.compacted()
    assert store.table.read().where("key = 'aa1'").count() == 1 and len(store.table.folders(store.table.version())) == 1


class Letters:
    """A tiny model: counts of letters."""

    def __init__(self, log):
        self.log = log

    def encode(self, texts):
        with open(self.log, "a", encoding="utf-8") as out:
            out.write("".join(f"{len(texts)}\n"))
        return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)


def corpus(spark):
    words = ["alpha fee late", "beta cap limit", "gamma queue retry", "delta tax round", "omega lock seat"]
    chunks = spark.createDataFrame([(k, f"{w} {w.upper()} x{k}") for k, w in enumerate(words)] + [(9, ""), (10, "alpha fee late")], "chunk_id long, text string")
    rules = spark.createDataFrame([(f"R{k}", w) for k, w in enumerate(words)], "rule_id string, text string")
    gold = spark.createDataFrame([(f"R{k}", k) for k in range(5)], "rule_id string, chunk_id long")
    return rules, chunks, gold


def test_recall_with_both_embedders_and_nothing_encoded_twice(spark, tmp_path):
    rules, chunks, gold = corpus(spark)
    log = tmp_path / "encoded"
    model = lambda: embedding.ModelEmbedder("letters", lambda log=str(log): Letters(log), stores.vector_store(spark, str(tmp_path / "v")))
    for make in (embedding.HashingEmbedder, model):
        hits = embedding.embedded_top(make(), rules, chunks, 3).select("rule_id", "rank", "chunk_id")
        got = retrieval.recall_at(hits, gold).first()
        assert got["n"] == 5 and got["r3"] == 1.0
    encoded = sum(map(int, log.read_text().split()))
    second = model()
    embedding.embedded_top(second, rules, chunks, 3).collect()
    assert sum(map(int, log.read_text().split())) == encoded and second.counts["misses"] == 0 and second.counts["hits"] > 0


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_dense_ranking_equals_all_pairs(spark, limit):
    rng = np.random.default_rng(3)
    left, right = rng.integers(-2, 3, (7, 4)) / 2, rng.integers(-2, 3, (60, 4)) / 2
    frame = lambda x: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    got = embedding.dense_top(frame(left), frame(right), 4, rule_bytes=limit * 64).collect()
    want = {(r, n + 1): (c, s) for r in range(7) for n, (s, c) in enumerate(sorted((-float(left[r] @ right[c]), c) for c in range(60))[:4])}
    assert {(r["rule_id"], r["rank"]): (r["chunk_id"], -r["score"]) for r in got} == {k: (c, s) for k, (c, s) in want.items()}
    assert embedding.dense_top(frame(left[:0]), frame(right), 4).count() == 0 and embedding.dense_top(frame(left), frame(right[:0]), 4).count() == 0


def test_blake_buckets_of_the_vocabulary(spark):
    fitted = embedding.HashingEmbedder(dimensions=64).fit(spark.createDataFrame([("late fee",), ("late",)], "text string"))
    got = {r["id"]: r["vector"] for r in fitted.encode(spark.createDataFrame([(1, "late fee"), (2, "")], "id long, text string")).collect()}
    at = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % 64
    assert {k for k, x in enumerate(got[1]) if x} == {at("late"), at("fee")} and not any(got[2])
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6
