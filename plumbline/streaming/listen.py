"""Progress of running queries as calls of a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: (event, payload), as a check's own events.
Callback = Callable[[str, dict[str, Any]], None]


class Reporter(StreamingQueryListener):
    """Tells ``callback`` of a query's start, of each of its batches once, and of its end.

    A batch is told with its rows, its seconds, the rows of its state and the query's observed metrics (``df.observe``).
    Spark may report a batch again while it waits for data; of each run the last batch told is remembered. A callback that
    raises is told of later events all the same."""

    def __init__(self, callback: Callback, names: set[str] | None = None):
        self.callback, self.names, self.last = callback, names, {}
        self.errors: list[Exception] = []

    def tell(self, event: str, **payload: Any) -> None:
        try:
            self.callback(event, payload)
        except Exception as error:  # noqa: BLE001  whatever a display raises must not stop the listener
            self.errors.append(error)

    def wanted(self, name: str | None) -> bool:
        return self.names is None or name in self.names

    def onQueryStarted(self, event) -> None:
        if self.wanted(event.name):
            self.last[str(event.runId)] = -1
            self.tell("query_start", query=event.name, run=str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        if run not in self.last or p.batchId <= self.last[run] or "addBatch" not in p.durationMs:
            return
        self.last[run] = p.batchId
        observed = {name: row.asDict() for name, row in p.observedMetrics.items()}
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self.tell("batch", query=p.name, run=run, batch=p.batchId, rows=p.numInputRows, seconds=p.batchDuration / 1000, state_rows=state, observed=observed)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if self.last.pop(run, None) is not None:
            self.tell("query_end", run=run, error=event.exception)


@contextmanager
def reported(spark: SparkSession, callback: Callback, names: set[str] | None = None) -> Iterator[Reporter]:
    """Within it ``callback`` hears of the streaming queries of ``spark``, or of those of the given names."""
    reporter = Reporter(callback, names)
    spark.streams.addListener(reporter)
    try:
        yield reporter
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)  # what has ended is told before the listener goes
        spark.streams.removeListener(reporter)
