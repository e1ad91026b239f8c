"""A watchdog over running streams: a stream is stalled if nothing gets on, however long it takes; slow ones aren't."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Watched:
    name: str | None
    rows: int
    moved: float
    state: str


class Watchdog(StreamingQueryListener):
    """What each query has done: ``rows`` so far, when that last grew, and whether it works, waits for input or has ended.

    ``spark.streams.addListener(Watchdog())`` starts it. Only growth of rows counts as getting on: a batch that fails and
    is tried again reports itself, but no rows.
    """

    def __init__(self, clock=time.monotonic):
        self.clock, self.lock, self.seen = clock, threading.Lock(), {}

    def _told(self, run: str, name: str | None, rows: int, state: str) -> None:
        with self.lock:
            w = self.seen.setdefault(run, Watched(name, 0, self.clock(), state))
            if rows or state != "working":
                w.rows, w.moved = w.rows + rows, self.clock()
            w.name, w.state = name or w.name, state

    def onQueryStarted(self, event) -> None:
        self._told(str(event.runId), event.name, 0, "working")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._told(str(p.runId), p.name, p.numInputRows, "working")

    def onQueryIdle(self, event) -> None:
        self._told(str(event.runId), None, 0, "idle")

    def onQueryTerminated(self, event) -> None:
        self._told(str(event.runId), None, 0, "failed" if event.exception else "ended")

    def states(self, after: float) -> dict[str, str]:
        """idle, moving, stalled, ended or failed of each query by its name, or its run where it has none.

        A working query is stalled if no rows have passed for ``after`` seconds.
        """
        now = self.clock()
        with self.lock:
            return {w.name or run: ("stalled" if now - w.moved > after else "moving") if w.state == "working" else w.state for run, w in self.seen.items()}


def stop_stalled(spark: SparkSession, dog: Watchdog, after: float) -> list[str]:
    """Stops stalled queries, so that whoever supervises them starts them again from their checkpoints; their names."""
    states = dog.states(after)
    out = []
    for q in spark.streams.active:
        name = q.name or str(q.runId)
        if states.get(name) == "stalled":
            q.stop()
            out.append(name)
    return sorted(out)
