"""Scoring verdicts against labels: outcomes, rates, per category, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.schemas import category_dimension


def ratio(numerator: Column, denominator: Column, decimals: int | None = 4) -> Column:
    """A quotient, 0 over 0; rounded half to even."""
    value = F.coalesce(numerator / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0))
    return value if decimals is None else F.bround(value, decimals)


def outcomes(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row a valid case: TP, FN, FP or TN, what was flagged, and why a miss happened.

    A control is FP with any flag. A drift case is TP with a flag on target: on one of its rules, or, if it names none, at
    the planted place; for category D8 a flag of the other direction at the planted place counts as well. A flag's place is
    judged by its retrieved chunks, else by its file's name, else it is believed. One pass: the verdicts of a case are one
    list in their own order, and everything else is an expression over it.
    """
    item = F.struct("verdict_pos", "rule_id", "verdict", "direction", "confidence", "evidence", "retrieved_chunks", "counterexample", "violated_clause")
    listed = verdicts.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("v"))
    joined = cases.where("status = 'valid'").join(listed, "case_id", "left").withColumn("v", F.coalesce("v", F.array().cast(listed.schema["v"].dataType)))
    drift = F.col("label") == "drift"
    targets = F.coalesce("target_rules", F.array().cast("array<string>"))
    gold, file = F.coalesce("gold_symbol", F.lit("")), F.coalesce("file", F.lit(""))

    def shown(v: Column) -> Column:
        return F.coalesce(F.size(v["retrieved_chunks"]) > 0, F.lit(False))

    def saw_gold(v: Column) -> Column:
        return F.coalesce(F.exists(v["retrieved_chunks"], lambda c: X.gold_match(c, gold)), F.lit(False))

    def localised(v: Column) -> Column:
        cited = F.coalesce(v["evidence"]["file"], F.lit(""))
        same_file = F.when((cited != "") & (file != ""), X.base_name(file) == X.base_name(cited)).otherwise(True)
        return F.when(shown(v) & (gold != ""), saw_gold(v)).otherwise(same_file)

    def is_target(v: Column) -> Column:
        return F.coalesce(F.array_contains(targets, v["rule_id"]), F.lit(False))

    def backwards(v: Column) -> Column:
        return (F.col("category") == "D8") & F.coalesce(v["direction"] == "reverse", F.lit(False))

    flagged = F.filter("v", lambda v: v["verdict"] == "DRIFT")
    hit = F.filter(flagged, lambda v: F.when(F.size(targets) > 0, is_target(v)).otherwise(localised(v)))
    more = F.filter(flagged, lambda v: (F.size(targets) > 0) & ~is_target(v) & backwards(v) & localised(v))
    on_target = F.concat(hit, more)
    named = joined.select("*", flagged.alias("flagged"), on_target.alias("on_target"))
    relevant = F.filter("v", lambda v: (F.size(targets) == 0) | is_target(v) | backwards(v))
    missed = (
        F.when(~F.coalesce(F.exists(relevant, shown), F.lit(False)), "n/a").when(gold == "", "reasoning")
        .when(F.exists(relevant, saw_gold), "reasoning").otherwise("retrieval")
    )
    outcome = F.when(drift, F.when(F.size("on_target") > 0, "TP").otherwise("FN")).otherwise(F.when(F.size("flagged") > 0, "FP").otherwise("TN"))
    rules = lambda a: F.transform(a, lambda v: v["rule_id"])
    counted = F.when(drift, F.col("on_target")).otherwise(F.col("flagged"))
    nothing = F.array().cast("array<string>")
    return named.select(
        "case_id", "project", "category", "label", outcome.alias("outcome"), rules(counted).alias("flagged_rules"),
        F.when(drift, rules(F.filter("flagged", lambda v: ~F.array_contains(F.col("on_target"), v)))).otherwise(nothing).alias("spurious_rules"),
        F.when(outcome == "FN", missed).otherwise("").alias("attribution"),
        F.size(F.filter("v", lambda v: v["verdict"] == "UNCERTAIN")).cast("long").alias("uncertain"),
        F.coalesce(F.array_max(F.transform(counted, lambda v: v["confidence"])), F.lit(0.0)).alias("confidence"),
    )


def tally(*extra: Column) -> list[Column]:
    return [*extra, *(F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "FN", "FP", "TN"))]


def rates(counts: DataFrame, decimals: int | None = 4) -> DataFrame:
    """Precision, recall, F1 (from the rounded two) and the false-alarm rate of counts tp, fn, fp and tn."""
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    out = counts.withColumn("precision", ratio(tp, tp + fp, decimals)).withColumn("recall", ratio(tp, tp + fn, decimals)).withColumn("false_alarm_rate", ratio(fp, fp + tn, decimals))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r, decimals))


def overall(scored: DataFrame, verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The report's one row (a row for each value of ``by``): rates, strict precision, spurious flags, share of uncertain
    verdicts among all of them."""
    by = by or []
    counts = rates(scored.groupBy(*by).agg(*tally(F.count("*").alias("cases"), F.sum(F.size("spurious_rules")).cast("long").alias("spurious_rule_flags"))))
    said = verdicts.groupBy(*by).agg(F.count("*").alias("__n"))
    unsure = scored.groupBy(*by).agg(F.sum("uncertain").alias("__u"))
    joined = counts.join(said, by, "left").join(unsure, by) if by else counts.crossJoin(F.broadcast(said)).crossJoin(F.broadcast(unsure))  # one row each
    strict = ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("spurious_rule_flags"))
    return joined.withColumn("strict_precision", strict).withColumn("uncertain_rate", ratio(F.col("__u"), F.coalesce("__n", F.lit(0)))).drop("__n", "__u")


def per_category(scored: DataFrame) -> DataFrame:
    """Recall of drift categories, false-alarm rate of the others; categories without cases are left out."""
    dimension = F.broadcast(category_dimension(scored.sparkSession))
    counts = scored.groupBy("category").agg(*tally(F.count("*").alias("n"), F.sum("uncertain").cast("long").alias("uncertain")))
    value = F.when(F.col("is_drift"), ratio(F.col("tp"), F.col("tp") + F.col("fn"))).otherwise(ratio(F.col("fp"), F.col("fp") + F.col("tn")))
    metric = F.when(F.col("is_drift"), "recall").otherwise("false_alarm_rate")
    return counts.join(dimension, "category").select("category", "ord", "name", "n", metric.alias("metric"), value.alias("value"), "uncertain")


def attribution(scored: DataFrame) -> DataFrame:
    return scored.where("outcome = 'FN' and attribution <> ''").groupBy("attribution").agg(F.count("*").alias("n"))


def collapsed(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict of several: drift wins, else the first."""
    return verdicts.groupBy(*keys).agg(F.when(F.max(F.col("verdict") == "DRIFT"), "DRIFT").otherwise(F.min_by("verdict", "verdict_pos")).alias("verdict"))


def live_status(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each verdict and the worst of them as a status."""
    counts = verdicts.groupBy(*keys).agg(*(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("COMPLIANT", "DRIFT", "UNCERTAIN")))
    return counts.withColumn("status", F.when(F.col("drift") > 0, "DRIFT").when(F.col("uncertain") > 0, "NEEDS_HUMAN").otherwise("PASS"))


def sweep_caught(verdicts: DataFrame) -> DataFrame:
    """Any flag on a case counts: looser than a scored TP."""
    return verdicts.groupBy("case_id").agg(F.max(F.col("verdict") == "DRIFT").alias("caught"))


def shown_caught(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Only a flag on one of the case's rules counts, so a case without rules is never caught."""
    flags = verdicts.where("verdict = 'DRIFT'").groupBy("case_id").agg(F.collect_set("rule_id").alias("__flags"))
    hit = F.coalesce(F.arrays_overlap("target_rules", "__flags"), F.lit(False))
    return cases.join(flags, "case_id", "left").select("case_id", hit.alias("caught"))
