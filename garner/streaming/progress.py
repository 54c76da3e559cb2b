"""Progress of streams: one line per micro-batch, heard from the engine itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


@dataclass(frozen=True)
class Beat:
    """What a stream does: started, progress (with the rows of the batch), idle, ended, or failed."""

    stream: str
    state: str
    batch: int = -1
    rows: int = 0


class Heartbeat(StreamingQueryListener):
    """Gives every event of the session's streams to ``tell``; events may come late and from another thread."""

    def __init__(self, tell: Callable[[Beat], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.tell(Beat(str(event.id), "started"))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.tell(Beat(str(p.id), "progress" if p.numInputRows else "idle", p.batchId, p.numInputRows))

    def onQueryIdle(self, event: object) -> None:
        self.tell(Beat(str(event.id), "idle"))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.tell(Beat(str(event.id), "failed" if event.exception else "ended"))


def listen(spark: SparkSession, tell: Callable[[Beat], None]) -> Heartbeat:
    """Add a heartbeat to the session and give it back, to be removed with ``spark.streams.removeListener``."""
    heart = Heartbeat(tell)
    spark.streams.addListener(heart)
    return heart
