"""Checks and sweeps as streams of events: made from verdicts as these arrive, stored once each, reduced for a display.

A stream's micro-batches go to folders of their own under a table's path, named by query and batch. A batch that is run
again after a crash replaces its own folder, and rows that a source repeats have the place of the first ones, so both are
told once. Readers take the row of the latest batch for each place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import progress

EVENTS = "check_id string, place long, event string, key string, payload string, at timestamp"
#: Events of a rule, in their order.
RULE_EVENTS = ["rule_start", "verdict", "rule_detail"]
#: How far behind the newest event a repeated one may come and still be known.
LATE = "10 minutes"
#: Events of a batch for a task.
PART = 250_000


def rule_events(verdicts: DataFrame) -> DataFrame:
    """``EVENTS`` from a stream or table of verdicts: a start, a verdict and a detail for each rule.

    ``verdicts`` has (check_id, pos, rule_id, text, verdict, confidence, retrieved, constant_context, at), ``pos`` being the
    rule's place in its check."""
    payloads: list[Column] = [
        F.to_json(F.struct("rule_id", "text")),
        F.to_json(F.struct("rule_id", "verdict", "confidence")),
        F.to_json(F.struct("rule_id", "retrieved", "constant_context")),
    ]
    steps = [F.struct(F.lit(k).alias("step"), F.lit(name).alias("event"), body.alias("payload")) for k, (name, body) in enumerate(zip(RULE_EVENTS, payloads, strict=True))]
    rows = verdicts.select("check_id", "pos", F.col("rule_id").alias("key"), "at", F.explode(F.array(*steps)).alias("s"))
    place = F.col("pos") * len(RULE_EVENTS) + F.col("s.step")
    return rows.select(F.col("check_id").cast("string").alias("check_id"), place.cast("long").alias("place"), "s.event", "key", "s.payload", "at")


def parts_of(spark: SparkSession, rows: int) -> int:
    """How many tasks hold ``rows`` events of a batch, ``PART`` each or what the session's settings say if that is less."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART))


def keyed_session(spark: SparkSession, rows: int) -> SparkSession:
    """A session beside ``spark`` whose streams deal batches of about ``rows`` events over ``parts_of`` tasks: how many is fixed
    when a stream first runs, and what a task holds of a batch would else grow with it."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.shuffle.partitions", str(parts_of(spark, rows)))
    return own


def told_once(events: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of events without those that it has told before; state goes with the watermark, and so do rows behind it."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["check_id", "place"])


def batch_writer(path: str, make: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the batch, or what ``make`` makes of it, in the batch's folder under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        (batch if make is None else make(batch)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return write


def stored(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None, name: str | None = None) -> StreamingQuery:
    """Start a query that stores what there is now, and ends; started again with the same ``checkpoint`` it goes on."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch_writer(path, make))
    return (writer.queryName(name) if name else writer).start()


def upserted(spark: SparkSession, path: str, schema: str, keys: list[str], parts: int | None = None) -> DataFrame:
    """The rows of a table of batches: for each key the one of its latest batch. With ``parts`` the keys are dealt over so many
    tasks, whatever the session's settings."""
    batches = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(f"{path}/batch=*")
    row = F.struct(*[c for c in batches.columns if c != "batch"])
    batches = batches if parts is None else batches.repartition(parts, *keys)
    return batches.groupBy(*keys).agg(F.max_by(row, "batch").alias("r")).select("r.*")


def last_of_batch(events: DataFrame) -> DataFrame:
    """What a display keeps of a batch: the last payload of each check, event and key."""
    return events.groupBy("check_id", "event", "key").agg(F.max("place").alias("place"), F.max_by("payload", "place").alias("payload"))


LAST = "check_id string, event string, key string, place long, payload string"


def reduced(spark: SparkSession, path: str) -> DataFrame:
    """(check_id, event, key, payload): the last state of each stage, the last verdict and the last detail of each rule, over all
    batches that ``last_of_batch`` has written."""
    batches = spark.read.schema(f"{LAST}, batch long").option("basePath", path).parquet(f"{path}/batch=*")
    return batches.groupBy("check_id", "event", "key").agg(F.max_by("payload", F.struct("place", "batch")).alias("payload"))


def statuses(last: DataFrame) -> DataFrame:
    """(check_id, rules, DRIFT, COMPLIANT, UNCERTAIN, status) of reduced events: where each check stands."""
    said = F.get_json_object("payload", "$.verdict")
    count = lambda v: F.count_if(F.coalesce((F.col("event") == "verdict") & (said == v), F.lit(False))).alias(v)
    told = last.groupBy("check_id").agg(F.count_if(F.col("event") == "verdict").alias("rules"), *map(count, ("DRIFT", "COMPLIANT", "UNCERTAIN")))
    status = F.when(F.col("DRIFT") > 0, "DRIFT").when(F.col("UNCERTAIN") > 0, "NEEDS_HUMAN").otherwise("PASS")
    return told.withColumn("status", status)


SWEEP = "place struct<p0: int, p1: string, p2: string, p3: int>, event string, payload string"


def swept(verdicts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For a stream of cases: the starts and results of a batch's cases against ``verdicts``. Summaries follow from the results
    (``sweep_summary``), as no batch knows a category's others."""
    return lambda cases: progress.sweep_events(cases, verdicts).where("event <> 'sweep_summary'")


def sweep_summary(events: DataFrame) -> DataFrame:
    """(category, n, caught, rate) of a sweep's results so far."""
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    results = events.where("event = 'case_result'").select(field("category").alias("category"), (field("caught") == "true").alias("caught"))
    told = results.groupBy("category").agg(F.count("*").alias("n"), F.count_if("caught").alias("caught"))
    return told.withColumn("rate", F.bround(F.col("caught") / F.col("n"), 4))
