"""Sinks: incremental tables and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.merge import LAST
from plumbline.schemas import VERDICTS
from plumbline.sources.versions import Conflict, VersionedTable


def write_verdicts(verdicts: DataFrame, root: str) -> None:
    """Parquet by detector and run; only the partitions at hand are replaced."""
    verdicts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("detector", "run").parquet(root)


def merge_into(stored: VersionedTable, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without the fresh keys, and the fresh rows, as the table's next version; a crash leaves the last one."""
    return stored.merge(fresh, keys)


#: The verdicts of one detector and run, and their place: the number of their case, null where they stay as they came.
STORED_VERDICTS = f"{VERDICTS}, ord int"


def merge_verdicts(stored: VersionedTable, fresh: DataFrame, cases: DataFrame, touched: DataFrame | None = None, attempts: int = 5) -> DataFrame:
    """Fresh verdicts beside the stored ones of untouched cases, read in order.

    ``cases`` has (case_id, ord), ``touched`` (case_id): the cases that were checked, also those without a verdict; by default the cases
    of ``fresh``. If any were kept, all get their case's place (unknown cases the last) and are read by place, case and rule;
    otherwise the fresh ones stay as they came."""
    touched = (fresh if touched is None else touched).select("case_id").distinct()
    for k in range(attempts):
        base = stored.version()
        kept = stored.read(base).drop("ord").join(touched, "case_id", "left_anti")
        if kept.isEmpty():
            made = fresh.withColumn("ord", F.lit(None).cast("int"))
        else:
            order = cases.select("case_id", F.col("ord").cast("int").alias("ord"))
            made = kept.unionByName(fresh).join(order, "case_id", "left").withColumn("ord", F.coalesce("ord", F.lit(LAST)))
        try:
            return ordered_verdicts(stored.read(stored.replace(made, base)))
        except Conflict:
            if k + 1 == attempts:
                raise
    raise AssertionError


def ordered_verdicts(rows: DataFrame) -> DataFrame:
    """Stored verdicts in their order."""
    came = F.when(F.col("ord").isNull(), F.monotonically_increasing_id())
    return rows.orderBy(came.asc_nulls_first(), "ord", "case_id", "rule_id", "verdict_pos")


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)  # one row


def category_rows(categories: DataFrame) -> DataFrame:
    """The rows of the CSV report, in category order."""
    return categories.orderBy("ord").select("category", "name", "n", "metric", "value", "uncertain")


def write_categories(categories: DataFrame, path: str) -> None:
    category_rows(categories).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)  # at most twelve rows


def write_metrics(overall: DataFrame, categories: DataFrame, path: str) -> None:
    """One JSON object a detector: its rates, and its categories in their order."""
    row = F.struct("ord", "category", "name", "n", "metric", "value", "uncertain")
    listed = categories.groupBy("detector").agg(F.array_sort(F.collect_list(row)).alias("per_category"))  # at most twelve rows
    overall.join(listed, "detector", "left").coalesce(1).write.mode("overwrite").json(path)  # a row a detector
