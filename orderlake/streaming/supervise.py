"""Many queries under one supervisor: one for each topic, watched by a listener, and started again from its checkpoint where it
failed."""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Watch(StreamingQueryListener):
    """What the queries report: rows read and rows dropped behind a watermark, by query name; what they ended with."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = defaultdict(int)
        self.dropped: dict[str, int] = defaultdict(int)
        self.state_rows: dict[str, list[int]] = defaultdict(list)
        self.ended: list[str | None] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows[p.name] += p.numInputRows
        self.dropped[p.name] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if p.stateOperators:
            self.state_rows[p.name].append(sum(s.numRowsTotal for s in p.stateOperators))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append(event.exception)


def watched(spark: SparkSession, run: Callable[[], None]) -> Watch:
    """What a listener saw while ``run`` did its queries."""
    watch = Watch()
    spark.streams.addListener(watch)
    try:
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(watch)
    return watch


@dataclass
class Supervisor:
    """Starts a query for each topic and waits until all have ended by themselves. One that fails is started again, and goes on
    from its checkpoint, up to ``restarts`` times; then the others are stopped and its error is raised."""

    spark: SparkSession
    topics: dict[str, Callable[[], StreamingQuery]]
    restarts: int = 3
    poll_seconds: int = 1
    report: Callable[[str], None] = print
    failures: dict[str, int] = field(default_factory=lambda: defaultdict(int))

    def run(self) -> None:
        running = {topic: begin() for topic, begin in self.topics.items()}
        try:
            while running:
                with contextlib.suppress(StreamingQueryException):  # told by the query itself
                    self.spark.streams.awaitAnyTermination(self.poll_seconds)
                self.spark.streams.resetTerminated()
                for topic, q in list(running.items()):
                    if q.isActive:
                        continue
                    del running[topic]
                    if (error := q.exception()) is None:
                        self.report(f"{topic}: ended")
                        continue
                    self.failures[topic] += 1
                    self.report(f"{topic}: failed {self.failures[topic]} times: {str(error)[:200]}")
                    if self.failures[topic] > self.restarts:
                        raise error
                    running[topic] = self.topics[topic]()
        finally:
            for q in running.values():
                q.stop()
            self.spark.streams.resetTerminated()
