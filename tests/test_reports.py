import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import merge, reports, scoring
from plumbline.plans import queries as Q
from plumbline.schemas import category_dimension
from plumbline.sources import rendered, specs


def frames(spark, folder="/root/testdata/sf0.001"):
    parts = {f"run{r}": (Q.scored(spark, folder, r), Q.verdicts(spark, folder, r)) for r in (1, 2)}
    union = lambda made: made[0].unionByName(made[1])
    named = lambda name, df: df.withColumn("detector", F.lit(name))
    overall = union([named(n, scoring.overall(s, v)).select("detector", F.lit(None).cast("string").alias("model"), "precision", "recall", "f1", "false_alarm_rate", "uncertain_rate", F.lit(None).cast("long").alias("asked")) for n, (s, v) in parts.items()])
    cases = Q.cases(spark, folder).select("case_id", "target_rules", F.col("note"))
    shown = lambda s, v: reports.examples(s.join(cases, "case_id"), v.select("case_id", "rule_id", "verdict", "verdict_pos", F.col("confidence").alias("c"), "violated_clause", "counterexample"), ["category", "note", "attribution", "c", "violated_clause", "counterexample"])
    return rendered.Frames(
        reports.dataset_summary(Q.cases(spark, folder)), category_dimension(spark), overall, union([named(n, scoring.per_category(s)) for n, (s, _) in parts.items()]),
        union([named(n, scoring.attribution(s)) for n, (s, _) in parts.items()]), union([named(n, shown(s, v).withColumnRenamed("c", "confidence")) for n, (s, v) in parts.items()]),
        spark.createDataFrame([("all", 3, 0.5, 1.0, 1.0), ("D1", 3, 0.5, 1.0, 1.0)], "category string, n long, r1 double, r3 double, r5 double"),
    )


def test_report_has_all_sections(spark, tmp_path):
    given = frames(spark)
    rendered.write_report(spark, given, str(tmp_path / "r"))
    text, page = (tmp_path / "r" / "report.md").read_text(), (tmp_path / "r" / "report.html").read_text()
    heads = ["Dataset", "Detector comparison", "Per category", "Retrieval", "Why drift was missed", "Example verdicts"]
    assert re.findall(r"^## (.*)$", text, re.M) == heads == re.findall(r"<h2>(.*?)</h2>", page)
    assert [n for n in re.findall(r"^### (run\d)", text, re.M)] == sorted(re.findall(r"^### (run\d)", text, re.M)) and "caught drift" in text
    for detector in ("run1", "run2"):
        row = given.overall.where(F.col("detector") == detector).first()
        assert f"| {detector} | n/a | {row['precision']:.2f} | {row['recall']:.2f} |" in text and f"<td>{row['f1']:.2f}</td>" in page
    valid = given.dataset.where("level = 'all'").first()["valid"]
    assert f"{valid} valid cases of" in text and text.count("| D1 |") == 3
    assert "| all | 3 | 50% | 100% | 100% |" in text
    rendered.write_report(spark, given, str(tmp_path / "r"), "Again <&>")
    assert "<h1>Again &lt;&amp;&gt;</h1>" in (tmp_path / "r" / "report.html").read_text()
    with pytest.raises(ValueError, match="rows"):
        rendered.collected(spark.range(2000))


def test_check_report(spark):
    checks = spark.createDataFrame([("a", "shop", "DRIFT", 1, 1, 0, "m"), ("b", "other", None, None, None, None, None)], "check_id string, name string, status string, DRIFT long, COMPLIANT long, UNCERTAIN long, model string")
    rules = spark.createDataFrame([("a", 1, "R2", "two"), ("a", 0, "R1", "one"), ("a", 2, "R3", "three"), ("b", 0, "R1", "x")], "check_id string, pos int, rule_id string, text string")
    said = [
        ("a", "R1", "DRIFT", "one", ("a.py", 2, 3), ("5", "6", "7"), False),
        ("a", "R2", "UNCERTAIN", "", ("none.py", 1, 1), ("", "", ""), True),
    ]
    verdicts = spark.createDataFrame(said, "check_id string, rule_id string, verdict string, violated_clause string, evidence struct<file:string,start_line:int,end_line:int>, counterexample struct<input:string,expected:string,actual:string>, downgraded boolean")
    flips = spark.createDataFrame([("a", "R1", "COMPLIANT", "DRIFT")], "check_id string, rule_id string, was string, now string")
    files = spark.createDataFrame([("a", "a.py", "l1\nl2\nl3\nl4")], "check_id string, path string, source string")
    got = {r["check_id"]: r["report"] for r in reports.check_report(checks, rules, verdicts, flips, files).collect()}
    a = got["a"]
    assert a.startswith("# Report of shop\n\nStatus: **DRIFT**, 1 drift, 1 compliant, 0 uncertain, model `m`.\n\n## Changed since the check before\n\n- **R1** COMPLIANT to DRIFT\n")
    assert [*re.findall(r"^### (.*)$", a, re.M)] == ["R1: DRIFT", "R2: UNCERTAIN", "R3: not checked"]
    assert "Quoted clause: one" in a and "input `5`, expected `6`, actual `7`" in a and "`a.py` from line 2:\n\n```python\nl2\nl3\n```" in a
    assert a.count("downgraded") == 1 and "none.py" not in a
    assert "The check did not finish." in got["b"] and "### R1: not checked\n\nx" in got["b"]


def test_waivers_decide_an_oracle_status(spark, tmp_path):
    (tmp_path / "w.yaml").write_text("c1: >\n  cannot be\n  seen  outside\nc2: 5\n")
    waivers = specs.read_waivers(spark, str(tmp_path / "w.yaml"))
    assert {r["case_id"]: r["reason"] for r in waivers.collect()} == {"c1": "cannot be seen outside", "c2": "5"}
    assert specs.read_waivers(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "e.yaml").write_text("")
    assert specs.read_waivers(spark, str(tmp_path / "e.yaml")).count() == 0
    cases = spark.createDataFrame([(c, "drift", "valid", True) for c in ("c1", "c3")], "case_id string, label string, status string, escapes_tests boolean")
    runs = spark.createDataFrame([("c3", True, False)], "case_id string, pristine_ok boolean, drifted_ok boolean")
    assert {r["case_id"]: r["status"] for r in merge.oracle_status(cases, waivers, runs).collect()} == {"c1": "waived", "c3": "confirmed"}
