"""Specifications, manifests, source trees and stored results as DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.schemas import CASES, SPECS, VERDICTS

SKIPPED = ("__pycache__", ".venv", ".pytest_cache")


def rule_rows(specs: DataFrame, key: str = "project", text: str = "text") -> DataFrame:
    """(key, rule_pos, rule_id, text, section): the numbered rules of each specification, each under its last heading."""
    lines = specs.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?|[\f\x0b\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n")).alias("pos", "line"))
    heading = F.nullif(F.regexp_extract("line", X.HEADING, 1), F.lit(""))
    above = F.last(heading, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    found = lines.withColumn("section", F.coalesce(above, F.lit(""))).withColumn("rule_id", F.regexp_extract("line", X.RULE_LINE, 1)).where("rule_id <> ''")
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return found.select(key, place.alias("rule_pos"), "rule_id", F.regexp_extract("line", X.RULE_LINE, 2).alias("text"), "section")


def duplicate_rules(rules: DataFrame, key: str = "project") -> DataFrame:
    return rules.groupBy(key, "rule_id").agg(F.count("*").alias("n")).where("n > 1")


def checked_rules(rules: DataFrame, key: str = "project") -> DataFrame:
    """``rules``, or an error that names a rule id which a specification has twice."""
    twice = duplicate_rules(rules, key).first()
    if twice is not None:
        raise ValueError(f"rule {twice['rule_id']} is defined more than once in {twice[key]}")
    return rules


def read_specs(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, project, text) of specification files; the project is the folder."""
    read = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return read.withColumn("project", F.element_at(F.split("path", "/"), -2))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Case specifications of all YAML manifests of a folder, in file order; ids must not repeat. Manifests are small."""
    import yaml

    rows = []
    for path in sorted(Path(folder).glob("*.yaml")):
        listed = yaml.safe_load(path.read_text(encoding="utf-8"))
        if not isinstance(listed, list):
            raise ValueError(f"{path} does not hold a list of cases")
        rows += listed
    names = [c.split()[0] for c in SPECS.split(", ")]
    text = lambda v: "\n".join("" if x is None else str(x) for x in v) if isinstance(v, list) else v
    tuples = [tuple(list(r.get(n) or []) if n == "target_rules" else text(r.get(n)) if n in ("find", "replace") else r.get(n) for n in names) for r in rows]
    seen: set[str] = set()
    for row in tuples:
        if row[0] in seen:
            raise ValueError(f"case {row[0]} is defined more than once")
        seen.add(row[0])
    return spark.createDataFrame(tuples, SPECS)


def read_waivers(spark: SparkSession, pattern: str) -> DataFrame:
    """(case_id, reason) of YAML maps of waived cases, white space squeezed; no file, no waivers."""
    import yaml
    from pyspark.errors import AnalysisException

    try:
        texts = [r["value"] for r in spark.read.text(pattern, wholetext=True).collect()]  # a few small files
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        texts = []
    rows = [(str(k), " ".join(str(v).split())) for text in texts for k, v in (yaml.safe_load(text) or {}).items()]
    return spark.createDataFrame(rows, "case_id string, reason string")


def read_sources(spark: SparkSession, folder: str, workspace: str) -> DataFrame:
    """(workspace, path, source) of a project's Python files: those under ``src`` if there is such a folder."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").text(folder, wholetext=True)
    full = F.regexp_replace(F.input_file_name(), "^[a-z]+:/+", "/")
    path = F.regexp_replace(F.substring(full, len(folder.rstrip("/")) + 2, 1 << 20), "%20", " ")
    rows = read.select(F.lit(workspace).alias("workspace"), path.alias("path"), F.col("value").alias("source"))
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), X.strings(SKIPPED)))
    under = rows.where(F.col("path").startswith("src/"))
    return rows if under.isEmpty() else under


def joined_sources(sources: DataFrame) -> DataFrame:
    """(workspace, text): all sources in path order, line feeds between."""
    listed = F.array_sort(F.collect_list(F.struct("path", "source")))
    return sources.groupBy("workspace").agg(F.array_join(F.transform(listed, lambda x: x["source"]), "\n").alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Built cases of a JSON-lines file; a missing file is empty."""
    return _lines(spark, path, CASES)


def read_verdicts(spark: SparkSession, root: str, detector: str, run: int = 1) -> DataFrame:
    return _lines(spark, f"{root}/{detector}/verdicts{'' if run == 1 else run}.jsonl", VERDICTS)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def run_numbers(files: DataFrame, name: str = "name") -> DataFrame:
    """The runs that stored verdict files stand for, ascending; names without a plain number do not count."""
    number = F.regexp_extract(name, r"^verdicts([0-9]*)\.jsonl$", 1)
    matched = files.where(F.col(name).rlike(r"^verdicts[0-9]*\.jsonl$"))
    return matched.select(F.when(number == "", 1).otherwise(number.try_cast("int")).alias("run")).distinct().orderBy("run")


def retained(rows: DataFrame, at: str, now: str, ttl_seconds: int) -> DataFrame:
    """Rows not older than their time to live; 0 or less keeps all."""
    if ttl_seconds <= 0:
        return rows
    return rows.where(F.col(at).cast("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))


def patched_cases(specs: DataFrame, sources: DataFrame) -> DataFrame:
    """(case_id, project, path, before, source, error): each case's file with its patch, in place of a copied project."""
    given = sources.select(F.col("workspace").alias("project"), F.col("path").alias("file"), F.col("source").alias("before"))
    joined = specs.join(given, ["project", "file"], "left")
    find, new = (F.coalesce(F.col(c), F.lit("")) for c in ("find", "replace"))
    error = F.when(F.col("before").isNull() & (find != ""), "file not found").otherwise(X.patch_error(F.col("before"), find))
    return joined.select(F.col("id").alias("case_id"), "project", F.col("file").alias("path"), "before", X.patched(F.col("before"), find, new).alias("source"), error.alias("error"))
