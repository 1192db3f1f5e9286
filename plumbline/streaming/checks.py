"""Structured Streaming: progress of live checks, and a sliding-minute limiter with state per client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.session import durable_folder, ship

WINDOW_SECONDS = 60.0
#: A client's state goes when it has been idle for so many windows.
IDLE_WINDOWS = 10


def admit(times: list[float], at: float, limit: int, window: float = WINDOW_SECONDS) -> tuple[list[float], bool]:
    """The times kept, and whether a request is admitted. A time aged exactly the window still counts; rejected requests
    leave no time."""
    kept = [t for t in times if at - t <= window]
    if len(kept) >= limit:
        return kept, False
    return [*kept, at], True


def rate_limited(hits: DataFrame, limit: int, window: float = WINDOW_SECONDS, expire: bool = False) -> DataFrame:
    """(client, at, admitted) for a stream or table of (client, at). State is the admitted times of the last minute, so at
    most ``limit`` numbers a client. With ``expire`` a client's state goes after some idle windows; that is for streams that
    run on, as a replay of what is there (``availableNow``) would never be done with waiting for it."""
    ship(hits.sparkSession)
    hits = hits.select(F.col("client").cast("string").alias("client"), F.col("at").cast("double").alias("at"))

    if not hits.isStreaming:
        # Sorted by time within the client; mapInPandas walks the rows in batches, so no client has to fit in memory.
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client, kept = None, []
            for frame in frames:
                said = []
                for c, at in zip(frame["client"], frame["at"], strict=True):
                    client, kept = (client, kept) if c == client else (c, [])
                    kept, ok = admit(kept, at, limit, window)
                    said.append(ok)
                yield frame.assign(admitted=said)[["client", "at", "admitted"]]

        return hits.repartition("client").sortWithinPartitions("client", "at").mapInPandas(run, "client string, at double, admitted boolean")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # idle for longer than the window: nothing that it holds counts any more
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        said = []
        for at in rows["at"]:
            kept, ok = admit(kept, at, limit, window)
            said.append(ok)
        state.update((kept,))
        if expire:
            state.setTimeoutDuration(int(IDLE_WINDOWS * window * 1000))
        yield pd.DataFrame({"client": key[0], "at": rows["at"].to_numpy(), "admitted": said})

    return hits.groupBy("client").applyInPandasWithState(step, "client string, at double, admitted boolean", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def verdict_counts(events: DataFrame) -> DataFrame:
    """Running counts of verdicts by check, for progress displays."""
    return events.groupBy("check_id", "verdict").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("__at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("__at", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def replayed(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and return what it said. Append results go to files in the shared folder;
    running totals to a memory table of their keys."""
    folder = f"{durable_folder(stream.sparkSession)}/{name}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
    writer.format("memory").queryName(name).start().awaitTermination()
    return stream.sparkSession.table(name)


def frames(events: DataFrame, event: str = "event", payload: str = "payload") -> DataFrame:
    """Server-sent event frames."""
    return events.withColumn("frame", F.concat(F.lit("event: "), F.col(event), F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n")))


def read_frames(stream: DataFrame, text: str = "frame") -> DataFrame:
    """(event, data) of concatenated frames; what is not ended by a blank line is left out."""
    whole = F.slice(F.split(text, "\n\n"), 1, F.greatest(F.size(F.split(text, "\n\n")) - 1, F.lit(1)))
    one = stream.where(F.contains(F.col(text), F.lit("\n\n"))).select(F.explode(whole).alias("f"))
    return one.select(F.regexp_extract("f", r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract("f", r"(?m)^data: (.*)$", 1).alias("data"))


def fed(rows: DataFrame, parts: list[Column], folder: str, step: Callable[[DataFrame], None], session: SparkSession | None = None) -> None:
    """Feed a stream bit by bit: the rows of each condition of ``parts`` are added to ``folder``, and ``step`` gets a stream over
    all of it, to run over what is new there. Each call starts its query anew, as after a crash."""
    for part in parts:
        rows.where(part).write.mode("append").parquet(folder)
        step((session or rows.sparkSession).readStream.schema(rows.schema).parquet(folder))
