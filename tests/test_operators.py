import hashlib
import io
import json
import math
import random
import re
import time
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import replies as R
from plumbline.functions import text as X
from plumbline.operators import chunking, detectors, retrieval, scoring, stability
from plumbline.plans.queries import SOURCE
from plumbline.schemas import CASES, VERDICTS
from plumbline.sources import intake, sinks, specs, versions
from plumbline.streaming import checks

BASE = dict(case_id="c", project="p", category="D1", label="drift", target_rules=["R1"], gold_symbol="f", file="src/a.py", note="", status="valid", escapes_tests=None, oracle=None, error=None, workspace="w")


def case(case_id, **more):
    return tuple((BASE | dict(case_id=case_id) | more).values())


def verdict(case_id, rule_id, said="DRIFT", direction="forward", file="", chunks=(), confidence=0.5, pos=0):
    return (case_id, rule_id, "d", direction, said, confidence, "", (file, 0, 0), ("", "", ""), list(chunks), 1, 0, False, False, False, pos)


#: (case, verdicts, outcome, flagged, spurious, attribution)
TABLE = [
    (case("a"), [verdict("a", "R1", confidence=0.9), verdict("a", "R2", pos=1)], "TP", ["R1"], ["R2"], ""),
    (case("b"), [], "FN", [], [], "n/a"),
    (case("c"), [verdict("c", "R1", "UNCERTAIN", chunks=["x.py::g"])], "FN", [], [], "retrieval"),
    (case("d"), [verdict("d", "R1", "COMPLIANT", chunks=["x.py::f"])], "FN", [], [], "reasoning"),
    (case("e", gold_symbol=""), [verdict("e", "R1", "COMPLIANT", chunks=["x.py::g"])], "FN", [], [], "reasoning"),
    (case("f", label="no_drift", category="N1"), [verdict("f", "R5", direction="reverse")], "FP", ["R5"], [], ""),
    (case("g", label="no_drift", category="N1"), [verdict("g", "R5", "UNCERTAIN")], "TN", [], [], ""),
    (case("h", target_rules=[], category="D8"), [verdict("h", "CREEP:f", chunks=["src/a.py::f"]), verdict("h", "R9", chunks=["b.py::z"], pos=1)], "TP", ["CREEP:f"], ["R9"], ""),
    (case("i", target_rules=[], gold_symbol=""), [verdict("i", "R9", file="lib/a.py"), verdict("i", "R8", file="lib/b.py", pos=1)], "TP", ["R9"], ["R8"], ""),
    (case("j", target_rules=[]), [verdict("j", "R9")], "TP", ["R9"], [], ""),
    (case("k", category="D8"), [verdict("k", "CREEP:f", direction="reverse", chunks=["a.py::f"])], "TP", ["CREEP:f"], [], ""),
    (case("l"), [verdict("l", "CREEP:f", direction="reverse", chunks=["a.py::f"])], "FN", [], ["CREEP:f"], "n/a"),
    (case("m", target_rules=None), [verdict("m", "R9", "COMPLIANT", chunks=["a.py::q::f"])], "FN", [], [], "retrieval"),
]


def test_outcome_table(spark):
    cases = spark.createDataFrame([t[0] for t in TABLE] + [case("z", status="invalid")], CASES)
    verdicts = spark.createDataFrame([v for t in TABLE for v in t[1]], VERDICTS)
    got = {r["case_id"]: r for r in scoring.outcomes(cases, verdicts).collect()}
    assert set(got) == {t[0][0] for t in TABLE}
    for c, _, outcome, flagged, spurious, attribution in TABLE:
        r = got[c[0]]
        assert (r["outcome"], r["flagged_rules"], r["spurious_rules"], r["attribution"]) == (outcome, flagged, spurious, attribution), c[0]
    assert got["a"]["confidence"] == 0.9 and got["c"]["uncertain"] == 1


def test_rates_round_half_to_even(spark):
    counts = spark.createDataFrame([(5, 27, 10, 17), (0, 0, 0, 0)], "tp long, fn long, fp long, tn long")
    rows = scoring.rates(counts).collect()
    assert rows[0]["recall"] == 0.1562 and rows[0]["precision"] == 0.3333 and rows[0]["f1"] == round(2 * 0.3333 * 0.1562 / (0.3333 + 0.1562), 4)
    assert rows[1]["precision"] == rows[1]["f1"] == 0


def test_published_intervals():
    """The keyword detector's published counts: 5 hits of 59, 10 false alarms of 27; means and interval places."""
    outcomes = [(f"d{k}", "D1", ["TP" if k < 5 else "FN"]) for k in range(59)] + [(f"n{k}", "N1", ["FP" if k < 10 else "TN"]) for k in range(27)]
    rows = {(s, m): (mean, lo, hi) for s, m, mean, lo, hi in stability.exact_bootstrap(outcomes, 300)}
    assert rows["overall", "precision"][0] == 0.3333 and rows["overall", "recall"][0] == 0.0847 and rows["overall", "false_alarm_rate"][0] == 0.3704
    assert all(lo <= mean <= hi for mean, lo, hi in rows.values())
    assert stability.rank_places(2000) == (51, 1950)


def test_exact_intervals_follow_pythons_stream(spark, monkeypatch):
    """Equal to the plain form with the same seed, in arrays shorter than a draw as well; no case is drawn on the driver."""
    rng = random.Random(5)
    kinds = {"D1": ["TP", "FN"], "N1": ["FP", "TN"], "D2": ["TP", "FN"]}
    cases = [(f"c{k}", c, k, [rng.choice(kinds[c]) for _ in range(3)]) for k in range(700) for c in [rng.choice(list(kinds))]]
    rows = [(i, c, k, run, o) for i, c, k, outcomes in cases for run, o in enumerate(outcomes)]
    scored = spark.createDataFrame(rows, "case_id string, category string, case_pos long, run int, outcome string").repartition(3)
    want = stability.exact_bootstrap([(i, c, o) for i, c, _, o in cases], 30, seed=3)
    monkeypatch.setattr(stability, "exact_bootstrap", None)
    assert [tuple(r) for r in stability.exact_intervals(spark, scored, 30, seed=3).collect()] == want
    monkeypatch.setattr(stability, "PICKED", 100)
    assert [tuple(r) for r in stability.exact_intervals(spark, scored, 30, seed=3).collect()] == want
    assert stability.exact_intervals(spark, scored.limit(0), 30).count() == 0


def test_quotes_are_sought_in_lines_made_once(spark):
    """In a text of many lines, each line is squeezed once and not for each place anew."""
    text, quote = "\n".join(f"line  {k} of" for k in range(6000)), "line 5998 of\n  line 5999  of"
    rows = [(text, quote), (text, "5998 of"), ("a b\nc  d", "b c d"), ("a", "a\nb"), ("a", " "), ("a\nb", "A")]
    began = time.monotonic()
    got = spark.createDataFrame(rows, "t string, q string").select(X.locate_quote(F.col("t"), F.col("q")).alias("at")).collect()
    assert [r["at"] and tuple(r["at"]) for r in got] == [(5998, 5999), (5998, 5998), (0, 1), None, None, None]
    assert time.monotonic() - began < 15


def python_tokens(text):
    found = re.findall(X.TOKEN, text)
    return [t if t[0].isdigit() else t.lower() for t in found if t[0].isdigit() or (len(t) > 1 and t.lower() not in X.STOPWORDS)]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(st.characters(codec="ascii", exclude_characters="\x00"), max_size=60), min_size=30, max_size=40))
def test_tokens_equal_the_pattern(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", X.tokens(F.col("text")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in rows} == {k: python_tokens(t) for k, t in enumerate(texts)}


def test_patches_and_keys(spark):
    rows = [("aXb", "X", "Y"), ("aXbX", "X", "Y"), ("ab", "X", "Y"), ("ab", "", "Y"), ("aaa", "aa", "b")]
    got = spark.createDataFrame(rows, "s string, f string, n string").select(X.patched(F.col("s"), F.col("f"), F.col("n")).alias("p"), X.patch_error(F.col("s"), F.col("f")).alias("e")).collect()
    assert [r["p"] for r in got] == ["aYb", None, None, "ab", "ba"] and [bool(r["e"]) for r in got] == [False, True, True, False, False]
    import hashlib

    row = spark.range(1).select(X.content_key(F.lit("a"), F.lit("b"), run=F.lit(1)).alias("x"), X.content_key(F.lit("a"), F.lit("b"), run=F.lit(2)).alias("y"), X.slug(F.lit(" My App!! ")).alias("s")).first()
    assert row["x"] == hashlib.sha256(b"a\0b").hexdigest() and row["y"] == hashlib.sha256(b"a\0b\0run=2").hexdigest() and row["s"] == "my-app"


def test_ranking_equals_all_pairs(spark):
    rules = [("R1", "fee limit is charged"), ("R2", "zebra"), ("R3", "loan period for members")]
    chunks = [(f"c{k}", t) for k, t in enumerate(["def fee(limit)", "members loan", "period", "nothing here", "fee fee member", "limit"])]
    got = retrieval.top_chunks(spark.createDataFrame(rules, "rule_id string, text string"), spark.createDataFrame(chunks, "chunk_id string, text string"), 4).collect()
    docs = [python_tokens(t) for _, t in rules + chunks]
    df = {t: sum(t in d for d in docs) for d in docs for t in d}

    def vector(tokens):
        v = {t: (1 + math.log(tokens.count(t))) * (math.log((len(docs) + 1) / (df[t] + 1)) + 1) for t in set(tokens)}
        n = math.sqrt(sum(w * w for w in v.values())) or 1
        return {t: w / n for t, w in v.items()}

    for rule, text in rules:
        a = vector(python_tokens(text))
        scores = {c: round(sum(a.get(t, 0) * w for t, w in vector(python_tokens(s)).items()), 6) for c, s in chunks}
        want = sorted(scores, key=lambda c: (-scores[c], c))[:4]
        assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["rule_id"] == rule] == want


def test_detectors(spark):
    source = "LIMIT = 3\ndef renew(x):\n    # 7 days\n    raise LoanError\n"
    chunks = chunking.chunked(spark.createDataFrame([("w", "src/a.py", source)], "workspace string, path string, source string"))
    rules = spark.createDataFrame([("w", "R1", "At most 3 loans, else `LoanError`", ""), ("w", "R2", "Fines after 7 days", ""), ("w", "R3", "`OtherError` on failure", "")], "workspace string, rule_id string, text string, section string")
    whole = {r["rule_id"]: r["verdict"] for r in detectors.detect("whole-project", rules, chunks).collect()}
    assert whole == {"R1": "COMPLIANT", "R2": "DRIFT", "R3": "DRIFT"}  # a comment is no behaviour
    both = detectors.detect("ranked-reverse", rules, chunks).collect()
    assert {(r["rule_id"], r["verdict"]) for r in both if r["direction"] == "reverse"} == {("CREEP:renew", "DRIFT")}
    assert {r["detector"] for r in detectors.detect("keyword", rules, chunks).collect()} == {"keyword"}
    with pytest.raises(ValueError):
        detectors.detect("none", rules, chunks)


def chunk_frame(spark, rows):
    """(workspace, file, qualname, kind, source) to chunks."""
    rows = [(w, f"{f}::{q}", f, q, k, 1, 1 + s.count("\n"), s) for w, f, q, k, s in rows]
    return spark.createDataFrame(rows, "workspace string, chunk_id string, file string, qualname string, kind string, start_line int, end_line int, source string")


def test_constants_of_the_own_workspace_count(spark):
    """A limit that stands in the module's constants is met, but not by the equal path of another workspace."""
    rows = [(w, "src/a.py", "renew", "function", "def renew(loan):\n    return loan.count < LOAN_LIMIT + 9") for w in ("w1", "w2")]
    rows += [("w1", "src/a.py", "<module>", "module", "LOAN_LIMIT = 5"), ("w2", "src/a.py", "<module>", "module", "OTHER = 1"), ("w2", "src/b.py", "<module>", "module", "LOAN_LIMIT = 5")]
    rules = spark.createDataFrame([(w, "R1", "renew a loan at most 5 times", "") for w in ("w1", "w2")], "workspace string, rule_id string, text string, section string")
    got = {r["workspace"]: r for r in detectors.ranked(rules, chunk_frame(spark, rows), k=1).collect()}
    assert (got["w1"]["verdict"], got["w1"]["retrieved_chunks"]) == ("COMPLIANT", ["src/a.py::renew", "src/a.py::<module>"])
    assert (got["w2"]["verdict"], got["w2"]["retrieved_chunks"]) == ("DRIFT", ["src/a.py::renew"]) and got["w2"]["violated_clause"]


def test_stored_replies_and_gates(spark):
    """Stored answers are used by content; claims without evidence, quotes that are nowhere and missing rules are uncertain."""
    rules = spark.createDataFrame([("w", "R1", "fee is 5", ""), ("w", "R2", "fee is 6", ""), ("w", "R3", "fee is 7", "")], "workspace string, rule_id string, text string, section string")
    chunks = chunk_frame(spark, [("w", "a.py", "fee", "function", "def fee():\n    return 5"), ("w", "a.py", "grant_bonus", "function", "def grant_bonus():\n    return 1")])
    asked = {r["rule_id"]: r["key"] for r in detectors.questions(rules, chunks).collect()}
    replies = spark.createDataFrame([(asked["R1"], '{"verdict": "DRIFT", "confidence": 0.9}'), (asked["R2"], "no json"), ("other", "{}")], "key string, response string")
    got = {r["rule_id"]: r for r in detectors.ranked(rules, chunks, replies).collect()}
    assert (got["R1"]["verdict"], got["R1"]["downgraded"], got["R1"]["cache_hit"]) == ("UNCERTAIN", True, True)
    assert (got["R2"]["verdict"], got["R2"]["parse_error"], got["R2"]["violated_clause"]) == ("UNCERTAIN", True, detectors.NO_JSON)
    assert (got["R3"]["verdict"], got["R3"]["cache_hit"]) == ("DRIFT", False)
    whole = detectors.rules_block(rules, ["workspace"]).first()["rules_text"]
    key = hashlib.sha256("\0".join([whole, "def fee():\n    return 5", "def grant_bonus():\n    return 1", detectors.WHOLE_PROMPT]).encode()).hexdigest()
    stored = spark.createDataFrame([(key, '[{"rule_id": "R1", "verdict": "COMPLIANT", "confidence": 1}, {"rule_id": "R2", "verdict": "UNCERTAIN"}, {"rule_id": "R1", "verdict": "DRIFT"}]')], "key string, response string")
    got = {r["rule_id"]: r for r in detectors.whole_project(rules, chunks, stored).collect()}
    assert [got[k]["verdict"] for k in ("R1", "R2", "R3")] == ["UNCERTAIN"] * 3 and got["R1"]["downgraded"] and got["R3"]["violated_clause"] == detectors.NO_ENTRY
    back = {r["rule_id"]: r for r in detectors.reverse(rules, chunks).collect()}
    assert (back["CREEP:fee"]["verdict"], back["CREEP:grant_bonus"]["verdict"]) == ("COMPLIANT", "DRIFT")
    assert back["CREEP:grant_bonus"]["violated_clause"].startswith("No rule authorises")
    accepted = {r["rule_id"]: r for r in detectors.reverse(rules, chunks, pristine=chunks).collect()}
    assert accepted["CREEP:grant_bonus"]["verdict"] == "COMPLIANT" and accepted["CREEP:grant_bonus"]["violated_clause"].startswith("accepted")


def test_misses_and_recall_by_category(spark):
    ranks = spark.createDataFrame([("c1", "D1", 1), ("c2", "D1", 7), ("c3", "D2", None), ("c4", "D2", 3)], "case_id string, category string, rank int")
    assert [r["case_id"] for r in retrieval.misses(ranks, ["case_id"]).collect()] == ["c2", "c3"]
    assert [r["case_id"] for r in retrieval.misses(ranks, ["case_id"], most=1).collect()] == ["c2"]
    got = {r["category"]: (r["n"], r["r1"], r["r5"]) for r in retrieval.recall_by_category(ranks).collect()}
    assert got == {"D1": (2, 0.5, 0.5), "D2": (2, 0.0, 0.5), "all": (4, 0.25, 0.5)}


def test_merge_into_makes_a_version(spark, tmp_path):
    stored = versions.VersionedTable(spark, f"{tmp_path}/t", "k long, v string")
    stored.append(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    out = sinks.merge_into(stored, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_merge_verdicts_keeps_untouched_cases_in_order(spark, tmp_path):
    stored = versions.VersionedTable(spark, f"{tmp_path}/v", sinks.STORED_VERDICTS)
    frame = lambda rows: spark.createDataFrame(rows, VERDICTS).coalesce(1)
    cases = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "case_id string, ord int")
    first = sinks.merge_verdicts(stored, frame([verdict("c", "R1"), verdict("a", "R2"), verdict("b", "R1"), verdict("x", "R1")]), cases)
    assert [r["case_id"] for r in first.collect()] == ["c", "a", "b", "x"]  # nothing was kept, so as they came
    touched = spark.createDataFrame([("a",), ("c",)], "case_id string")
    got = sinks.merge_verdicts(stored, frame([verdict("a", "R9"), verdict("a", "R1")]), cases, touched).collect()
    assert [(r["case_id"], r["rule_id"]) for r in got] == [("b", "R1"), ("a", "R1"), ("a", "R9"), ("x", "R1")]


class Echo:
    def complete(self, system, user):
        if user == "bad":
            raise RuntimeError
        return user.upper()


def test_answers_are_asked_once(spark):
    questions = spark.createDataFrame([("a", "s", "x"), ("a", "s", "x"), ("b", "s", "y")], "key string, system string, user string")
    answers = spark.createDataFrame([("b", "known"), ("z", "other")], "key string, response string")
    got = {r["key"]: (r["response"], r["hit"]) for r in detectors.answered(questions, answers, Echo).collect()}
    assert got == {"a": ("X", False), "b": ("known", True)}
    assert detectors.with_retries(lambda: Echo().complete("", "bad"), pause=0) is None


def test_salvage_is_aware_of_strings():
    cut = '[{"a": "x } y"}, {"b": "q\\"{"}, {"c": {"d": 1}}, {"e": "cu'
    assert list(R.complete_objects(cut)) == [{"a": "x } y"}, {"b": 'q"{'}, {"c": {"d": 1}}]
    assert list(R.complete_objects('{"a": {"b": 1}, "c": [{"d": 2}')) == []  # nothing of an object without an end
    assert list(R.complete_objects('} {"a": 1} {"b": 2}')) == [] and list(R.complete_objects('{"a": 1} } { {"b": 2}')) == [{"a": 1}, {"b": 2}]
    assert list(R.complete_objects('{"a": "no end')) == [] and list(R.complete_objects('{"a": "x\\')) == []
    assert list(R.complete_objects("{" * 500_000)) == [] and len(list(R.complete_objects('{"a": 1} ' * 100_000))) == 100_000


def test_table_functions_over_large_and_broken_files(spark):
    large = "x = 1\n" + "".join(f"def f{k}(a):\n    return a + {k}\n" for k in range(30_000))
    rows = [("w", "a.py", large), ("w", "b.py", "def ("), ("w", "c.py", None), ("w", "d.py", "x = (" + "(" * 5000), ("w", "e.py", "a\0b")]
    got = chunking.chunked(spark.createDataFrame(rows, "workspace string, path string, source string")).groupBy("file").count().collect()
    assert len(large) > 1_000_000 and {r["file"]: r["count"] for r in got} == {"a.py": 30_001}
    replies = [("x", '[{"a": 1}, {"b": "}"}, {"c"'), ("x", '[{"a": 1}, {"b": "}"}, {"c"'), ("y", None), ("z", "[" + ", ".join('{"k": "%s"}' % ("v" * 90) for _ in range(12_000)) + ', {"k"')]
    found = R.salvage(spark.createDataFrame(replies, "key string, response string")).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in found} == {"x": 4, "z": 12_000}


def test_chunker(spark):
    rows = {c["qualname"]: c for c in chunking.chunk_rows("a.py", SOURCE)}
    assert list(rows) == ["<module>", "first", "Box", "Box.inner", "Box.__len__", "last"]
    assert rows["first"]["source"].startswith("@wrap") and rows["Box"]["source"].rstrip().endswith("size: int = 0") and rows["<module>"]["start_line"] == 1
    assert chunking.chunk_rows("b.py", "def (") == []


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_archives(spark):
    rows = [
        ("good", archive({"p/spec.md": "- **R1** x", "p/src/a.py": "x", "p/tests/t.py": "y", "p/.git/c.py": "z", "p/b.txt": "q"})), ("climb", archive({"../a.py": "x"})),
        ("none", b""), ("junk", b"not a zip"), ("large", archive({"a.py": "x" * 150_001})), ("many", archive({f"f{k}.py": "x" for k in range(31)})), ("bytes", archive({"a.py": b"\xff\xfe"})),
    ]
    got = intake.unpacked(spark.createDataFrame([(u, bytearray(c)) for u, c in rows], "upload string, content binary")).collect()
    assert {r["path"] for r in got if r["upload"] == "good" and r["path"]} == {"p/spec.md", "p/src/a.py"}
    assert {r["upload"] for r in got if r["error"]} == {"climb", "none", "junk", "large", "many", "bytes"}
    paths = spark.createDataFrame([("a/./b.py",), ("/x",), ("a/../b",), ("tests/a.py",), (" ",)], "p string").select(intake.safe_path(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in paths] == ["a/b.py", None, None, None, None]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.yaml").write_text("- {id: a, project: p, category: D1, label: drift, target_rules: null, file: src/a.py, find: [x, null], replace: y, gold_symbol: f, note: n}\n")
    cases = specs.read_manifests(spark, str(tmp_path / "m"))
    assert cases.first()["find"] == "x\n" and cases.first()["target_rules"] == []
    (tmp_path / "m" / "b.yaml").write_text("- {id: a}\n")
    with pytest.raises(ValueError):
        specs.read_manifests(spark, str(tmp_path / "m"))
    (tmp_path / "w" / "src" / "__pycache__").mkdir(parents=True)
    (tmp_path / "w" / "src" / "a.py").write_text("x\n")
    (tmp_path / "w" / "src" / "__pycache__" / "b.py").write_text("x\n")
    sources = specs.read_sources(spark, str(tmp_path / "w"), "p")
    assert [r["path"] for r in sources.collect()] == ["src/a.py"]
    patched = specs.patched_cases(cases, sources).first()
    assert patched["source"] == "y" and patched["error"] is None
    assert specs.read_cases(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "v" / "d").mkdir(parents=True)
    (tmp_path / "v" / "d" / "verdicts2.jsonl").write_text(json.dumps({"case_id": "a", "rule_id": "R1", "verdict": "DRIFT"}) + "\n\n")
    assert specs.read_verdicts(spark, str(tmp_path / "v"), "d", 2).count() == 1
    names = spark.createDataFrame([("verdicts.jsonl",), ("verdicts3.jsonl",), ("verdictsx.jsonl",)], "name string")
    assert [r["run"] for r in specs.run_numbers(names).collect()] == [1, 3]
    rules = specs.rule_rows(spark.createDataFrame([("p", "## A\n- **R1** one\ntext\n* **R2** two \r\n## B\n- **R1** three")], "project string, text string"))
    assert [(r["rule_pos"], r["rule_id"], r["text"], r["section"]) for r in rules.orderBy("rule_pos").collect()] == [(0, "R1", "one", "A"), (1, "R2", "two", "A"), (2, "R1", "three", "B")]
    with pytest.raises(ValueError):
        specs.checked_rules(rules)


def limiter(rows, limit):
    out, kept = [], {}
    for client, at in sorted(rows):
        times = [t for t in kept.get(client, []) if at - t <= 60]
        ok = len(times) < limit
        kept[client] = times + [at] * ok
        out.append((client, at, ok))
    return out


def test_limiter_in_batch_and_as_a_stream(spark, tmp_path):
    rows = [("a", float(t)) for t in (0, 1, 2, 60, 61, 62, 121, 122.5)] + [("b", 5.0), ("b", 65.0), ("b", 65.5)]
    batch = spark.createDataFrame(rows, "client string, at double")
    want = limiter(rows, 2)
    assert sorted(map(tuple, checks.rate_limited(batch, 2).collect())) == want
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, at double").parquet(str(tmp_path / "in"))
    said = checks.replayed(checks.rate_limited(stream, 2), f"limiter_{tmp_path.name}")
    assert sorted(map(tuple, said.collect())) == want


def test_frames(spark):
    sent = checks.frames(spark.createDataFrame([("verdict", (1,))], "event string, payload struct<a:int>"))
    got = checks.read_frames(sent.select(F.concat("frame", F.lit("event: cut")).alias("frame"))).collect()
    assert [tuple(r) for r in got] == [("verdict", '{"a":1}')]


def test_entry_without_the_other_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_tokens' in q and 'pipeline' not in q and not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
