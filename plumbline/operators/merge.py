"""Merging fresh rows into stored ones, comparing runs, filters and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAST = 1 << 30


def merged(stored: DataFrame, fresh: DataFrame, keys: list[str], order: DataFrame | None = None) -> DataFrame:
    """Stored rows whose keys are not fresh, and all fresh rows. With ``order`` (keys, ord) each row gets its place, unknown
    keys the last."""
    out = stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
    return out if order is None else out.join(order, keys, "left").withColumn("ord", F.coalesce(F.col("ord"), F.lit(LAST)))


def flips(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose verdict changed."""
    old = before.select(*keys, F.col("verdict").alias("was"))
    return old.join(after.select(*keys, F.col("verdict").alias("now")), keys).where("was <> now")


def latest(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last value of each key, as a consumer of progress events keeps it."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def explored(cases: DataFrame, *, project: str | None = None, category: str | None = None, label: str | None = None, escapes: bool | None = None, q: str = "") -> DataFrame:
    """The explorer's filters; unknown escapes count as false; ``q`` is looked for without case in id, note, symbol and
    rules."""
    chosen: Column = F.lit(True)
    for name, value in (("project", project), ("category", category), ("label", label)):
        if value is not None:
            chosen = chosen & (F.col(name) == value)
    if escapes is not None:
        chosen = chosen & (F.coalesce("escapes_tests", F.lit(False)) == escapes)
    if q:
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.lower()))
        anywhere = has(F.col("case_id")) | has(F.col("note")) | has(F.col("gold_symbol"))
        chosen = chosen & (anywhere | F.coalesce(F.exists("target_rules", has), F.lit(False)))
    return cases.where(chosen)


def page(rows: DataFrame, order: list, number: int = 1, size: int = 200) -> DataFrame:
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("page numbers start at 1, sizes lie within 1 and 1000")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def counted_page(rows: DataFrame, order: list, number: int = 1, size: int = 200) -> DataFrame:
    """A page with ``total``, the number of rows of all pages."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, order, number, size).crossJoin(F.broadcast(total))  # one row


def case_rows(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A list's rows: each case with ``verdicts``, a map from detector to its collapsed verdict: drift if one of its verdicts is,
    else the first. ``verdicts`` has (case_id, detector, verdict, verdict_pos)."""
    drift = F.max(F.col("verdict") == "DRIFT")
    one = verdicts.groupBy("case_id", "detector").agg(F.when(drift, "DRIFT").otherwise(F.min_by("verdict", "verdict_pos")).alias("said"))
    mapped = one.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector", "said")))).alias("verdicts"))
    return cases.join(mapped, "case_id", "left").withColumn("verdicts", F.coalesce("verdicts", F.create_map().cast("map<string,string>")))


def case_detail(cases: DataFrame, rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(case_id, ..., targets, by_detector): a case's page with the texts of its target rules, and its verdicts by detector in
    their order. ``rules`` has (project, rule_id, text)."""
    targets = cases.select("case_id", "project", F.explode("target_rules").alias("rule_id")).join(rules, ["project", "rule_id"])
    texts = targets.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "text"))).alias("targets"))
    row = F.struct("verdict_pos", "rule_id", "verdict", "confidence")
    listed = verdicts.groupBy("case_id", "detector").agg(F.array_sort(F.collect_list(row)).alias("v")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("detector", "v"))).alias("by_detector"))
    return cases.join(texts, "case_id", "left").join(listed, "case_id", "left")


def first_per(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def shown_verdicts(verdicts: DataFrame, most: int = 4) -> DataFrame:
    """Per case: verdicts of drift or on target, at most ``most``; if there are none, the first verdict."""
    rank = F.when((F.col("verdict") == "DRIFT") | F.col("on_target"), 0).otherwise(1)
    any_ = F.max(rank == 0).over(Window.partitionBy("case_id"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(rank, "verdict_pos"))
    picked = verdicts.withColumn("__any", any_).withColumn("__rank", rank).withColumn("__place", place)
    return picked.where(F.when(F.col("__any"), (F.col("__rank") == 0) & (F.col("__place") <= most)).otherwise(F.col("__place") == 1)).drop("__any", "__rank", "__place")


def oracle_status(cases: DataFrame, waivers: DataFrame, runs: DataFrame) -> DataFrame:
    """(case_id, status): for valid drift cases that escape their tests. ``waivers`` has (case_id, reason), ``runs``
    (case_id, pristine_ok, drifted_ok)."""
    needed = cases.where("label = 'drift' and status = 'valid' and escapes_tests <=> true")
    joined = needed.join(waivers, "case_id", "left").join(runs, "case_id", "left")
    status = (
        F.when(F.col("reason").isNotNull(), "waived").when(F.col("pristine_ok").isNull(), "missing").when(~F.col("pristine_ok"), "broken")
        .when(F.col("drifted_ok"), "blind").otherwise("confirmed")
    )
    return joined.select("case_id", status.alias("status"))


def narrowed(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks of changed files; all of them when none of the files is known."""
    kept = chunks.join(changed.select("file").distinct(), "file", "left_semi")
    return chunks if kept.isEmpty() else kept


def oracle_tally(statuses: DataFrame) -> DataFrame:
    """(status, n): how many cases have each oracle status."""
    return statuses.groupBy("status").agg(F.count("*").alias("n"))
