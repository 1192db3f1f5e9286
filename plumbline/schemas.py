"""Schemas of the tables and the category dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULES = "project string, rule_pos int, rule_id string, text string, section string"
CHUNKS = "workspace string, chunk_id string, file string, qualname string, kind string, start_line int, end_line int, source string"
CASES = (
    "case_id string, project string, category string, label string, target_rules array<string>, gold_symbol string, file string, "
    "note string, status string, escapes_tests boolean, oracle string, error string, workspace string"
)
SPECS = "id string, project string, category string, label string, target_rules array<string>, file string, find string, replace string, gold_symbol string, note string"
VERDICTS = (
    "case_id string, rule_id string, detector string, direction string, verdict string, confidence double, violated_clause string, "
    "evidence struct<file:string,start_line:int,end_line:int>, counterexample struct<input:string,expected:string,actual:string>, "
    "retrieved_chunks array<string>, run int, latency_ms int, cache_hit boolean, parse_error boolean, downgraded boolean, verdict_pos int"
)

#: Categories in order, with name and whether they are drift.
CATEGORIES = [
    ("D1", "Boundary shift", True), ("D2", "Value / constant drift", True), ("D3", "Omitted check", True), ("D4", "Weakened condition", True),
    ("D5", "Sequence violation", True), ("D6", "Error-handling drift", True), ("D7", "Comment decoy", True), ("D8", "Unauthorised scope creep", True),
    ("D9", "Output contract drift", True), ("N1", "Unchanged code", False), ("N2", "Semantics-preserving refactor", False), ("N3", "Benign decoy", False),
]
VERDICT_VALUES = ("COMPLIANT", "DRIFT", "UNCERTAIN")


def category_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, k, n, d) for k, (c, n, d) in enumerate(CATEGORIES)], "category string, ord int, name string, is_drift boolean")
