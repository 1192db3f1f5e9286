import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import checks, limiter, listen, live


def limited(hits, limit, window):
    """One client after the other, all earlier admitted times looked at."""
    out, kept = [], {}
    for client, at in sorted(hits, key=lambda r: (r[1], r[0])):
        recent = [t for t in kept.get(client, []) if at - t <= window]
        out.append((client, at, len(recent) < limit))
        kept[client] = [*recent, at] if len(recent) < limit else recent
    return sorted(out)


def test_limiter_goes_on_after_a_restart_and_lets_idle_clients_go(spark, tmp_path):
    rng = random.Random(4)
    hits = [(f"c{rng.randrange(4)}", 1.0 + k + rng.choice([0, 0.5])) for k in range(90)] + [("old", 2.0), ("old", 3.0)]
    late = [("c1", 4000.0 + k) for k in range(8)]
    session, rows = limiter.state_session(spark), spark.createDataFrame(hits + late, "client string, at double")
    assert spark.conf.get(limiter.STORE) != limiter.ROCKS  # the caller's session stays as it is
    held = []

    def step(stream):
        query = limiter.limited(stream, 3, window=20.0, idle=2).writeStream.option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/rows")
        query.format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        held.append({r["client"] for r in limiter.clients_held(session, f"{tmp_path}/state").collect()})

    at = F.col("at")
    checks.fed(rows, [at < 31, (at >= 31) & (at < 1000), at >= 1000], f"{tmp_path}/in", step, session)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert got == limited(hits + late, 3, 20.0)
    assert "old" in held[0] and "old" not in held[1] and held[2] == {"c1"}
    assert (tmp_path / "state" / "offsets" / "2").exists()  # several batches in one life of the state


VERDICTS = "check_id string, pos long, rule_id string, text string, verdict string, confidence double, retrieved long, constant_context long, at timestamp"


def verdict(check, pos, rule, said):
    return (check, pos, rule, f"text of {rule}", said, 0.5, 3, 1, f"2024-01-01 00:{pos:02d}:00")


def verdicts(spark, rows):
    return spark.createDataFrame(rows, VERDICTS.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp"))


def rule_rows():
    rows = [verdict("a", k, f"R{k % 3}", ["DRIFT", "COMPLIANT", "UNCERTAIN"][k % 3]) for k in range(9)]
    return rows + [verdict("a", 9, "R0", "COMPLIANT"), verdict("b", 1, "R1", "UNCERTAIN"), verdict("b", 2, "R1", "COMPLIANT")]


def test_live_events_are_told_once(spark, tmp_path):
    events, path = verdicts(spark, rule_rows()), str(tmp_path)

    def step(stream):
        live.stored(live.told_once(live.rule_events(stream)), f"{path}/events", f"{path}/state").awaitTermination()

    half = F.col("pos") < 5
    checks.fed(events, [half, half, ~half], f"{path}/in", step)
    batches = sorted(p.name for p in (tmp_path / "events").glob("batch=*"))
    stored = spark.read.option("basePath", f"{path}/events").parquet(f"{path}/events/batch=*")
    assert len(batches) >= 3 and stored.count() == 3 * 12  # the repeated rows are in no batch
    told = live.upserted(spark, f"{path}/events", live.EVENTS, ["check_id", "place"])
    assert told.count() == 36 and {r["event"] for r in told.collect()} == set(live.RULE_EVENTS)
    got = {r["check_id"]: r.asDict() for r in live.statuses(live.last_of_batch(told).drop("place")).collect()}
    assert (got["a"]["status"], got["a"]["rules"], got["a"]["UNCERTAIN"]) == ("NEEDS_HUMAN", 3, 1)
    assert (got["b"]["status"], got["b"]["COMPLIANT"]) == ("PASS", 1)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    events, path = live.rule_events(verdicts(spark, rule_rows())), str(tmp_path)

    def run(stream, name):
        live.stored(stream, f"{path}/{name}", f"{path}/{name}-state", live.last_of_batch if name == "last" else None).awaitTermination()

    def step(stream):
        run(stream, "all")
        run(stream, "last")

    checks.fed(events, [F.col("place") < 12, F.col("place") >= 12], f"{path}/in", step)
    before = live.upserted(spark, f"{path}/all", live.EVENTS, ["check_id", "place"]).orderBy("check_id", "place").collect()
    reduced = sorted(map(tuple, live.reduced(spark, f"{path}/last").collect()))
    for name in ("all", "last"):  # as after a crash between a batch's write and its commit
        (tmp_path / f"{name}-state" / "commits" / "1").unlink()
        (tmp_path / f"{name}-state" / "commits" / ".1.crc").unlink(missing_ok=True)
        run(spark.readStream.schema(events.schema).parquet(f"{path}/in"), name)
    assert live.upserted(spark, f"{path}/all", live.EVENTS, ["check_id", "place"]).orderBy("check_id", "place").collect() == before
    assert sorted(map(tuple, live.reduced(spark, f"{path}/last").collect())) == reduced
    by_key = {(r[0], r[1], r[2]): json.loads(r[3]) for r in reduced}
    assert by_key["a", "verdict", "R0"]["verdict"] == "COMPLIANT" and len(by_key) == 3 * 3 + 3


def test_progress_reaches_a_callback_once_a_batch(spark, tmp_path):
    heard = []

    def callback(event, payload):
        heard.append((event, payload))
        if payload.get("batch") == 0:
            raise RuntimeError("a display that fails")

    rows = spark.range(30).withColumn("k", F.col("id") % 3)
    with listen.reported(spark, callback, {"watched"}) as reporter:

        def step(stream):
            seen = stream.observe("seen", F.count("*").alias("n"))
            for name in ("watched", "other"):
                live.stored(seen if name == "watched" else stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", name=name).awaitTermination()

        checks.fed(rows, [F.col("k") == k for k in range(3)], f"{tmp_path}/in", step)
    batches = [p for e, p in heard if e == "batch"]
    assert [(p["batch"], p["rows"], p["observed"]["seen"]["n"]) for p in batches] == [(0, 10, 10), (1, 10, 10), (2, 10, 10)]
    assert [e for e, _ in heard if e != "batch"] == ["query_start", "query_end"] * 3
    assert all(p["query"] == "watched" for p in batches) and len(reporter.errors) == 1
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/in")
    n = len(heard)
    live.stored(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/watched", f"{tmp_path}/watched-state", name="watched").awaitTermination()
    assert len(heard) == n  # nothing is told once the listener is gone


@pytest.mark.parametrize("cases", [0, 7])
def test_sweep_in_batches_equals_the_table(spark, tmp_path, cases):
    from plumbline.operators import progress

    fields = "case_id string, category string, project string, target_rules array<string>, escapes_tests boolean"
    rows = [(f"c{k}", f"D{k % 2}", "p", ["R1"] if k % 3 else [], None) for k in range(cases)]
    given = spark.createDataFrame(rows, fields)
    said = spark.createDataFrame([(f"c{k}", f"R{k % 2}", "DRIFT" if k < 5 else "COMPLIANT") for k in range(7)], "case_id string, rule_id string, verdict string")
    early = F.col("case_id") < "c3"
    checks.fed(given, [early, early, ~early], f"{tmp_path}/in", lambda s: live.stored(s, f"{tmp_path}/e", f"{tmp_path}/s", live.swept(said)).awaitTermination())
    if not cases:
        assert not list(Path(tmp_path / "e").glob("batch=*/*.parquet")) or spark.read.parquet(f"{tmp_path}/e").count() == 0
        return
    got = sorted(map(tuple, live.sweep_summary(live.upserted(spark, f"{tmp_path}/e", live.SWEEP, ["place"])).collect()))
    whole = progress.sweep_events(given, said).where("event = 'sweep_summary'").select("payload").collect()
    assert got == sorted((p["category"], p["n"], p["caught"], round(p["rate"], 4)) for p in (json.loads(r["payload"]) for r in whole))


def test_a_batch_is_dealt_over_more_tasks_the_larger_it_is(spark, tmp_path):
    settings = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert live.parts_of(spark, 10) == settings and live.parts_of(spark, 100 * live.PART + 1) == max(settings, 101)
    session = live.keyed_session(spark, 100 * live.PART)
    assert int(session.conf.get("spark.sql.shuffle.partitions")) == max(settings, 100) and int(spark.conf.get("spark.sql.shuffle.partitions")) == settings
    live.batch_writer(str(tmp_path))(live.rule_events(verdicts(spark, rule_rows())), 0)
    told = live.upserted(spark, str(tmp_path), live.EVENTS, ["check_id", "place"], 37)
    assert told.rdd.getNumPartitions() == 37 and told.count() == live.rule_events(verdicts(spark, rule_rows())).count()
