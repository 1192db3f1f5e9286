"""A sliding-minute limiter on a stream, with list state and timers by client."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.session import ship
from plumbline.streaming.checks import IDLE_WINDOWS, WINDOW_SECONDS, admit

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of an output frame.
FRAME_ROWS = 50_000


def state_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings, whose streams keep state where lists and timers can be kept; ``spark``
    itself stays as it is."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(STORE, ROCKS)
    return own


class SlidingWindow(StatefulProcessor):
    """Admits up to ``limit`` requests a client within a window. State is the admitted times of the last window, at most
    ``limit`` numbers, and one timer, at which an idle client's state goes."""

    def __init__(self, limit: int, window: float, idle: int):
        self.limit, self.window, self.idle = limit, window, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = np.sort(np.concatenate([frame["at"].to_numpy() for frame in rows]))  # 8 bytes a request of the micro-batch
        kept = sorted(row[0] for row in self.times.get()) if self.times.exists() else []
        for low in range(0, len(given), FRAME_ROWS):
            part, said = given[low : low + FRAME_ROWS], []
            for at in part.tolist():
                kept, ok = admit(kept, at, self.limit, self.window)
                said.append(ok)
            yield pd.DataFrame({"client": key[0], "at": part, "admitted": said})
        self.times.put([(at,) for at in kept])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((float(given[-1]) + self.idle * self.window) * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()  # nothing that it holds counts any more
        return iter(())

    def close(self) -> None:
        pass


def limited(hits: DataFrame, limit: int, window: float = WINDOW_SECONDS, idle: int = IDLE_WINDOWS, late: str = "0 seconds") -> DataFrame:
    """(client, at, admitted) for a stream of (client, at), ``at`` in seconds; the stream has to belong to a ``state_session``.

    Requests of a micro-batch are looked at in the order of their times; batches have to come in that order too, as an
    answer once given stays. A request that is ``late`` behind the newest one of earlier batches is left out. A client that
    is idle for ``idle`` windows of the stream's time leaves the state store.
    """
    ship(hits.sparkSession)
    timed = hits.select(F.col("client").cast("string").alias("client"), F.col("at").cast("double").alias("at"))
    timed = timed.withColumn("moment", F.timestamp_seconds("at")).withWatermark("moment", late)
    return timed.groupBy("client").transformWithStateInPandas(SlidingWindow(limit, window, idle), "client string, at double, admitted boolean", "Append", "EventTime")


def clients_held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(client, at): the admitted times that a stopped stream still holds."""
    held = spark.read.format("statestore").option("stateVarName", "times").load(checkpoint)
    return held.select("key.client", "list_element.at")
