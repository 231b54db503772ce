"""Live listeners on a crawl stream.

``observed`` counts what a micro-batch holds, by event; ``Listeners`` hears of every batch, calls whoever subscribed to an event and
keeps the events as rows, which ``save`` appends to a table.  The counts come with the batch's own tasks: no second pass.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# Names of the events, by the kind of a crawl event.  Fixed values.
PAGE_EVENTS = {"success": "page:crawled", "failure": "page:failed", "skip": "page:skipped", "challenge": "block:detected"}
STARTED, PROGRESS, COMPLETED, ERROR = "crawl:started", "crawl:progress", "crawl:completed", "crawl:error"
EVENT_ROWS = "run string, batch long, event string, rows long, detail string"
OBSERVED = "crawl_events"

Callback = Callable[[dict], None]


def observed(events: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """The stream itself, with its rows counted by event; ``more`` adds conditions to count under names of their own."""
    counts = {name: F.col("kind") == kind for kind, name in PAGE_EVENTS.items()} | (more or {})
    return events.observe(OBSERVED, F.count(F.lit(1)).alias(PROGRESS), *[F.count_if(c).alias(name) for name, c in counts.items()])


class Listeners(StreamingQueryListener):
    """Subscriptions to the events of the streams of a session.

    A callback gets an event's row as a dict.  One that raises is noted in ``failures`` and neither stops the stream nor the others.
    A batch that is run again after a failure is reported again, under the run that did it.
    """

    def __init__(self):
        self._called: dict[str, list[Callback]] = defaultdict(list)
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)
        self._batches: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.failures: list[tuple[str, Exception]] = []

    def on(self, event: str, callback: Callback) -> Listeners:
        """Subscribe to an event, or to all with ``*``."""
        self._called[event].append(callback)
        return self

    def off(self, event: str, callback: Callback) -> None:
        if callback in self._called[event]:
            self._called[event].remove(callback)

    def emit(self, run: str, batch: int | None, event: str, rows: int | None = None, detail: str | None = None) -> None:
        self.rows.append((run, batch, event, rows, detail))
        told = {"run": run, "batch": batch, "event": event, "rows": rows, "detail": detail}
        for callback in [*self._called[event], *self._called["*"]]:
            try:
                callback(told)
            except Exception as error:  # noqa: BLE001 - a listener's own trouble
                self.failures.append((event, error))

    # What Spark calls.

    def onQueryStarted(self, event) -> None:
        self.emit(str(event.runId), None, STARTED, None, event.name)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics = progress.observedMetrics.get(OBSERVED)
        if metrics is None or not progress.numInputRows:
            return
        run = str(progress.runId)
        self._batches[run] = self._batches.get(run, 0) + 1
        for name, rows in metrics.asDict().items():
            self.emit(run, progress.batchId, name, rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if event.exception:
            self.emit(run, None, ERROR, None, event.exception[:1000])
        else:
            self.emit(run, None, COMPLETED, self._batches.get(run, 0))
        self._ended[run].set()

    def wait(self, run: str, seconds: float = 60.0) -> bool:
        """Until the last event of a run is here: Spark hands events over on a thread of its own."""
        return self._ended[run].wait(seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        """The events so far: some rows for each batch."""
        return spark.createDataFrame(self.rows, EVENT_ROWS)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append the events so far to a table and forget them."""
        rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, EVENT_ROWS).coalesce(1).write.mode("append").parquet(path)


def run_listened(events: DataFrame, path: str, listeners: Listeners, write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a crawl stream until its input is used up, with ``listeners`` on it; its events are appended to ``path``/events.

    ``write(batch, number)`` gets the batches; without it they are appended to ``path``/rows.  A stream that fails still saves its
    events, then raises.
    """
    spark = events.sparkSession
    spark.streams.addListener(listeners)
    writer = observed(events).writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    try:
        if write:
            query = writer.foreachBatch(write).start()
        else:
            query = writer.format("parquet").option("path", f"{path}/rows").start()
        try:
            query.awaitTermination()
        finally:
            listeners.wait(str(query.runId))
            listeners.save(spark, f"{path}/events")
    finally:
        spark.streams.removeListener(listeners)

