"""A live session over segment files: paced, paused, resumed and fast-forwarded, each row through its sink once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

Sink = Callable[[DataFrame, int], None]


class LiveSession:
    """One file a beat of the clock; the place in the stream is the query's checkpoint, so that pausing loses nothing.

    `generation` counts starts: a sink may drop what an older start still hands on.
    """

    def __init__(self, spark: SparkSession, schema: str, source: str, sink: Sink, state: str, seconds: float = 10.0, speed: float = 1.0):
        if seconds <= 0 or speed <= 0:
            raise ValueError("the step and the speed must be positive")
        self.spark, self.schema, self.source, self.sink, self.state = spark, schema, source, sink, state
        self.seconds, self.speed, self.generation = seconds, speed, 0
        self.query: StreamingQuery | None = None

    def _start(self, **trigger: object) -> StreamingQuery:
        self.generation += 1
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.source)
        self.query = stream.writeStream.foreachBatch(self.sink).option("checkpointLocation", self.state).trigger(**trigger).start()
        return self.query

    def start(self) -> None:
        """Runs at the session's speed until it is paused."""
        self.pause()
        self._start(processingTime=f"{max(1, round(1000 * self.seconds / self.speed))} milliseconds")

    def pause(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()

    resume = start

    def set_speed(self, speed: float) -> None:
        if speed <= 0:
            raise ValueError("the speed must be positive")
        running = self.query is not None and self.query.isActive
        self.speed = speed
        if running:
            self.start()

    def fast_forward(self) -> None:
        """All that there is, without pacing."""
        self.pause()
        self._start(availableNow=True).awaitTermination()

    def snapshot(self) -> dict:
        """Where the session stands: running, batch, rows of the last batch, and whether batches take longer than their step."""
        last = None if self.query is None else self.query.lastProgress
        took = 0.0 if last is None else last["batchDuration"] / 1000
        return {"running": self.query is not None and self.query.isActive, "generation": self.generation, "batch": None if last is None else last["batchId"], "rows": 0 if last is None else last["numInputRows"], "lagging": took > self.seconds / self.speed}

    def wait_for(self, batches: int, timeout: float = 60.0) -> None:
        """Until so many batches of this start have been seen."""
        end = time.time() + timeout
        while time.time() < end and self.query is not None and len([p for p in self.query.recentProgress if p["numInputRows"]]) < batches:
            time.sleep(0.05)
