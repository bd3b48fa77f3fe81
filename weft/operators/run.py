"""Running a merge beside the caller: progress, cancelling and the outcome. Jobs carry a tag, so that one run alone is stopped."""

from __future__ import annotations

import inspect
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Outcome:
    """state: finished, cancelled or failed. result: what the sink returned."""

    state: str
    result: object = None
    error: str = ""


class Run:
    """A merge, or any work on a frame such as its checks, in the background. sink(df) writes it whole or not at all (as workbook.write does); a sink of two
    parameters gets a function to tell (rows written, rows in all), which rows() then gives."""

    def __init__(self, df: DataFrame, sink: Callable[..., object], done: Callable[[Outcome], None] | None = None):
        self.spark, self.tag = df.sparkSession, f"weft-{uuid.uuid4().hex}"
        self._cancelled, self._outcome, self._rows = threading.Event(), None, (0, None)
        tells = len(inspect.signature(sink).parameters) > 1

        def work() -> None:
            self.spark.addTag(self.tag)
            self.spark.sparkContext.setJobGroup(self.tag, "merge")
            try:
                result = sink(df, self._told) if tells else sink(df)
                out = Outcome("cancelled") if self._cancelled.is_set() else Outcome("finished", result)
            except Exception as e:  # reported, not raised in a thread that nobody watches
                out = Outcome("cancelled") if self._cancelled.is_set() else Outcome("failed", error=str(e))
            finally:
                self.spark.removeTag(self.tag)
            self._outcome = out
            if done:
                done(out)

        self._thread = InheritableThread(target=work, daemon=True)
        self._thread.start()

    def progress(self) -> tuple[int, int]:
        """(tasks done, tasks in all) of the run's jobs so far."""
        tracker, done, total = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.tag):
            info = tracker.getJobInfo(job)
            for stage in (tracker.getStageInfo(s) for s in (info.stageIds if info else ())):
                if stage:
                    done, total = done + stage.numCompletedTasks, total + stage.numTasks
        return done, total

    def _told(self, written: int, total: int) -> None:
        if self._cancelled.is_set():
            raise InterruptedError("cancelled")
        self._rows = (written, total)

    def rows(self) -> tuple[int, int | None]:
        """(rows written, rows in all); the second is None until the rows have been computed."""
        return self._rows

    def cancel(self) -> None:
        self._cancelled.set()
        self.spark.interruptTag(self.tag)

    def wait(self, seconds: float | None = None) -> Outcome | None:
        """The outcome, or None while it runs."""
        self._thread.join(seconds)
        return self._outcome
