"""Summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.scoring import ratio


def dataset_summary(cases: DataFrame) -> DataFrame:
    """Counts by category, by project and in all, from one pass: (level, category, project, n, valid, escaped)."""
    sets = cases.select("category", "project", (F.col("status") == "valid").alias("ok"), F.coalesce(F.col("escapes_tests"), F.lit(False)).alias("esc"))
    grouped = sets.groupingSets([["category"], ["project"], []], "category", "project").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("ok").alias("valid"), F.count_if(F.col("ok") & F.col("esc")).alias("escaped")
    )
    level = F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "project").otherwise("all")
    return grouped.select(level.alias("level"), "category", "project", "n", "valid", "escaped")


def comparison(categories: DataFrame, detectors: list[str]) -> DataFrame:
    """Each category's value by detector, side by side; null where a detector has none."""
    return categories.groupBy("category").pivot("detector", detectors).agg(F.first("value"))


def examples(scored: DataFrame, verdicts: DataFrame, more: list[str] | None = None) -> DataFrame:
    """For TP, FN and FP the first case, with the verdict that tells most: the first drift, else the first on a rule of the
    case, else the first. ``more`` names further columns of either side to keep."""
    first = scored.where("outcome in ('TP','FN','FP')").withColumn("__n", F.row_number().over(Window.partitionBy("outcome").orderBy("case_id"))).where("__n = 1").drop("__n")
    joined = first.join(verdicts, "case_id", "left")
    rank = F.when(F.col("verdict") == "DRIFT", 0).when(F.coalesce(F.array_contains("target_rules", F.col("rule_id")), F.lit(False)), 1).otherwise(2)
    picked = joined.withColumn("__n", F.row_number().over(Window.partitionBy("outcome").orderBy(rank, "verdict_pos"))).where("__n = 1")
    return picked.select("outcome", "case_id", "rule_id", "verdict", *(more or []))


def representatives(cases: DataFrame) -> DataFrame:
    """One valid drift case a category: the first by id."""
    row = F.struct("project", "label")
    return cases.where("status = 'valid' and label = 'drift'").groupBy("category").agg(F.min("case_id").alias("case_id"), F.min_by(row, "case_id").alias("r")).select("category", "case_id", "r.project")


def project_counts(projects: DataFrame, cases: DataFrame) -> DataFrame:
    counted = cases.groupBy("project").agg(F.count("*").alias("n"))
    return projects.join(counted, "project", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def cache_statistics(answers: DataFrame) -> DataFrame:
    return answers.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), ratio(F.count_if("hit"), F.count("*")).alias("hit_rate"))


def check_report(checks: DataFrame, rules: DataFrame, verdicts: DataFrame, flips: DataFrame, files: DataFrame) -> DataFrame:
    """(check_id, report): a check's report in Markdown: its status and counts, what changed since the check before, and each rule
    in its order with its verdict, clause, counterexample and the lines that the verdict cites.

    ``checks`` has (check_id, name, status, DRIFT, COMPLIANT, UNCERTAIN, model), ``rules`` (check_id, pos, rule_id, text), ``verdicts``
    (check_id, rule_id, verdict, violated_clause, evidence, counterexample, downgraded), ``flips`` (check_id, rule_id, was, now),
    ``files`` (check_id, path, source). A check without a status did not finish."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    line = lambda when, *parts: F.when(when, F.concat(say(*parts), F.lit("\n\n"))).otherwise("")
    example = F.col("counterexample")
    cited = verdicts.join(files.select("check_id", F.col("path").alias("__path"), F.col("source").alias("__source")), (verdicts["check_id"] == files["check_id"]) & (F.col("evidence.file") == F.col("__path")), "left").drop(files["check_id"])
    first = F.greatest(F.lit(1), F.coalesce("evidence.start_line", F.lit(1)))
    code = excerpt(F.col("__source"), first, F.greatest(first, F.coalesce("evidence.end_line", first)))
    body = say(
        line(full(F.col("violated_clause")), "Quoted clause: ", F.col("violated_clause")),
        line(full(example["input"]) | full(example["expected"]) | full(example["actual"]), "Counterexample: input `", F.coalesce(example["input"], F.lit("")), "`, expected `", F.coalesce(example["expected"], F.lit("")), "`, actual `", F.coalesce(example["actual"], F.lit("")), "`."),
        line(F.col("__source").isNotNull(), "`", F.col("__path"), "` from line ", first.cast("string"), ":\n\n```python\n", F.coalesce(code, F.lit("")), "\n```"),
        line(F.coalesce("downgraded", F.lit(False)), "This claim was downgraded for want of a quoted clause and a counterexample."),
    )
    said = cited.select("check_id", "rule_id", F.col("verdict").alias("__verdict"), body.alias("__body"))
    every = rules.join(said, ["check_id", "rule_id"], "left")
    text = say("### ", F.col("rule_id"), ": ", F.coalesce("__verdict", F.lit("not checked")), "\n\n", F.col("text"), "\n\n", F.coalesce("__body", F.lit("")))
    ordered = lambda rows, place, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, what.alias("__t")))), lambda r: r["__t"]), "")
    listed = every.groupBy("check_id").agg(ordered(every, ["pos", "rule_id"], text).alias("__rules"))
    changed = flips.groupBy("check_id").agg(ordered(flips, ["rule_id"], say("- **", F.col("rule_id"), "** ", F.col("was"), " to ", F.col("now"), "\n")).alias("__flips"))
    counts = say("Status: **", F.col("status"), "**, ", F.col("DRIFT").cast("string"), " drift, ", F.col("COMPLIANT").cast("string"), " compliant, ", F.col("UNCERTAIN").cast("string"), " uncertain, model `", F.coalesce("model", F.lit("")), "`.")
    head = say("# Report of ", F.col("name"), "\n\n", F.coalesce(counts, F.lit("The check did not finish.")), "\n\n")
    middle = F.when(F.col("__flips").isNotNull(), say("## Changed since the check before\n\n", F.col("__flips"), "\n")).otherwise("")
    whole = checks.join(listed, "check_id", "left").join(changed, "check_id", "left")
    return whole.select("check_id", say(head, middle, "## Rules\n\n", F.coalesce("__rules", F.lit(""))).alias("report"))


def excerpt(source, first, last, most: int = 25):
    """At most ``most`` lines of a source from its line ``first``, within it."""
    lines = F.split(source, "\n")
    start = F.greatest(F.lit(1), F.least(first, F.size(lines)))
    length = F.least(F.lit(most), F.greatest(F.lit(1), last - start + 1), F.size(lines) - start + 1)
    return F.array_join(F.slice(lines, start, length), "\n")


def diff_window(lines, at, around: int = 8):
    """The lines within ``around`` of a place."""
    start = F.greatest(F.lit(1), at - around)
    return F.slice(lines, start, F.greatest(F.lit(0), F.least(F.size(lines), at + around) - start + 1))
