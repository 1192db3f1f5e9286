"""What a check and a sweep tell while they run, as tables of events in the order in which a reader gets them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import scoring

#: The stages of a check, in their order.
STAGES = ["setup", "spec", "chunk", "rank", "verify", "gate"]
#: Rules are told while the fifth stage runs.
VERIFY = STAGES.index("verify")


def event(keys: list[str], place: list[Column], name: str, *payload: Column) -> list[Column]:
    return [*keys, F.struct(*[c.alias(f"p{k}") for k, c in enumerate(place)]).alias("place"), F.lit(name).alias("event"), F.to_json(F.struct(*payload)).alias("payload")]


def source_counts(sources: DataFrame) -> DataFrame:
    """(workspace, files, lines) of sources (workspace, path, source): what a check tells of what it has read."""
    lines = F.length("source") - F.length(F.replace("source", F.lit("\n"))) + 1
    return sources.groupBy("workspace").agg(F.count_distinct("path").alias("files"), F.sum(F.coalesce(lines, F.lit(0)).cast("long")).alias("lines"))


def check_events(rules: DataFrame, chunks: DataFrame, verdicts: DataFrame, model: str = "stand-in", k: int = 3) -> DataFrame:
    """(workspace, place, event, payload) of a check: each stage running and done, for each rule its start, its verdict and how
    much of what was shown had been retrieved, and a summary. ``place`` orders a workspace's events.

    ``rules`` has (workspace, rule_id, text), ``chunks`` (workspace, file, ...), ``verdicts`` what a forward detector says."""
    keys, no = ["workspace"], F.lit("")
    sized = rules.groupBy("workspace").agg(F.count("*").alias("rules")).join(chunks.groupBy("workspace").agg(F.count("*").alias("chunks"), F.count_distinct("file").alias("files")), "workspace", "left")
    count = lambda v: F.count_if(F.col("verdict") == v)
    told = verdicts.groupBy("workspace").agg(*[count(v).alias(v) for v in ("DRIFT", "COMPLIANT", "UNCERTAIN")], F.count_if("downgraded").alias("downgraded"))
    one = sized.join(told, "workspace", "left").na.fill(0)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    of = lambda c: F.col(c).cast("string")
    details = {
        "setup": say(model), "spec": say(of("rules"), " numbered rules"), "chunk": say(of("chunks"), " chunks from ", of("files"), " files"), "rank": say(f"top {k} of ", of("chunks"), " chunks per rule"),
        "verify": say(of("rules"), " of ", of("rules"), " checked"), "gate": say(of("DRIFT"), " drift accepted, ", of("downgraded"), " downgraded for want of proof"),
    }
    parts = []
    for n, stage in enumerate(STAGES):
        named = F.lit(stage).alias("stage")
        parts.append(one.select(*event(keys, [F.lit(n), F.lit(0), no, F.lit(0)], "stage", named, F.lit("running").alias("state"))))
        parts.append(one.select(*event(keys, [F.lit(n), F.lit(2), no, F.lit(0)], "stage", named, F.lit("done").alias("state"), details[stage].alias("detail"))))
    at = lambda step: [F.lit(VERIFY), F.lit(1), F.col("rule_id"), F.lit(step)]
    context = F.greatest(F.lit(0), F.size("retrieved_chunks") - k)
    parts.append(rules.select(*event(keys, at(0), "rule_start", F.col("rule_id"), F.col("text"))))
    parts.append(verdicts.select(*event(keys, at(1), "verdict", F.col("rule_id"), F.col("verdict"), F.col("confidence"), F.col("violated_clause"), F.col("downgraded"))))
    parts.append(verdicts.select(*event(keys, at(2), "rule_detail", F.col("rule_id"), (F.size("retrieved_chunks") - context).alias("retrieved"), context.alias("constant_context"))))
    status = F.when(F.col("DRIFT") > 0, "DRIFT").when(F.col("UNCERTAIN") > 0, "NEEDS_HUMAN").otherwise("PASS")
    counts = F.struct("DRIFT", "COMPLIANT", "UNCERTAIN")
    parts.append(one.select(*event(keys, [F.lit(len(STAGES)), F.lit(0), no, F.lit(0)], "summary", status.alias("status"), counts.alias("counts"), F.col("rules"), F.col("chunks"), F.lit(model).alias("model"))))
    return reduce(DataFrame.unionByName, parts)


def sweep_events(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(place, event, payload) of a sweep over cases: a start and a result for each, and how many were caught by category.

    Of ``verdicts`` (case_id, rule_id, verdict) those on a case's target rules count, or all where it has none."""
    counted = (F.size("target_rules") == 0) | F.array_contains("target_rules", F.col("rule_id"))
    joined = cases.select("case_id", "category", "project", "target_rules", "escapes_tests").join(verdicts.select("case_id", "rule_id", "verdict"), "case_id", "left")
    flagged = F.sort_array(F.collect_set(F.when(counted & (F.col("verdict") == "DRIFT"), F.col("rule_id"))))
    result = joined.groupBy("case_id", "category", "project", "target_rules", "escapes_tests").agg(flagged.alias("flagged_rules"), F.count_if(F.coalesce(counted, F.lit(False)) & F.col("rule_id").isNotNull()).alias("rules_checked"))
    result = result.withColumn("caught", F.size("flagged_rules") > 0)
    at = lambda step: [F.lit(0), F.col("category"), F.col("case_id"), F.lit(step)]
    fields = [F.col(c) for c in ("case_id", "category", "project", "caught", "flagged_rules", "target_rules", "rules_checked", "escapes_tests")]
    told = result.groupBy("category").agg(F.count("*").alias("n"), F.count_if("caught").alias("caught"))
    summary = told.withColumn("rate", scoring.ratio(F.col("caught"), F.col("n"))).select(*event([], [F.lit(1), F.col("category"), F.lit(""), F.lit(0)], "sweep_summary", F.col("category"), F.col("n"), F.col("caught"), F.col("rate")))
    starts = cases.select(*event([], at(0), "case_start", F.col("case_id"), F.col("category")))
    return starts.unionByName(result.select(*event([], at(1), "case_result", *fields))).unionByName(summary)
