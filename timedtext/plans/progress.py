"""Progress of running jobs: (stage, done, total), told at most ten times a second but at every change of stage and at its end."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from .tables import Table

SCHEMA = "job string, stage string, step int, done double, total double"
LEAST_S = 0.1


def progress_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, SCHEMA, ["job", "stage", "step"])


class Progress:
    """Passes on what it is told, as ``say(stage, done, total)``, but not too often."""

    def __init__(self, say: Callable[[str, float, float], None], least_s: float = LEAST_S, clock: Callable[[], float] = time.monotonic):
        self.say, self.least_s, self.clock = say, least_s, clock
        self.stage: str | None = None
        self.at = 0.0

    def __call__(self, stage: str, done: float, total: float) -> None:
        now = self.clock()
        if stage != self.stage or done >= total or now - self.at >= self.least_s:
            self.stage, self.at = stage, now
            self.say(stage, done, total)


def into(table: Table, job: str) -> Callable[[str, float, float], None]:
    """Says progress into a table, which others may read while the job runs."""
    steps: dict[str, int] = {}

    def say(stage: str, done: float, total: float) -> None:
        steps[stage] = steps.get(stage, -1) + 1
        table.put(table.spark.createDataFrame([(job, stage, steps[stage], float(done), float(total))], SCHEMA))

    return say


class Observed(StreamingQueryListener):
    """Progress of streams from what they observe: ``stream.observe(stage, count(...).alias("done"))``; ``totals`` by stage.

    The session's listener thread calls it, batch by batch. ``ended`` is set when a stream that was heard of ends.
    """

    def __init__(self, progress: Progress, totals: dict[str, float]):
        self.progress, self.totals, self.done = progress, totals, dict.fromkeys(totals, 0.0)
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for stage, row in event.progress.observedMetrics.items():
            if stage in self.totals:
                self.done[stage] += row["done"]
                self.progress(stage, self.done[stage], self.totals[stage])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()
