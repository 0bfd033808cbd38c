"""Keeps a streaming query running: restarts by back-off, pause and resume, and a check for lost messages before each start."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .cdc import backoff


class _Progress(StreamingQueryListener):
    def __init__(self, seen: Callable[[str, int], None]):
        self.seen = seen

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.seen(str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


class Supervisor:
    """Runs *start* until its query ends by itself or *stop* is called; a failed query is started again from its checkpoint.

    Waits 1, 2, 4, ... up to 30 seconds between failures without progress; a batch that succeeds sets that back. *lost* tells before a start
    whether messages are gone that were not taken yet; then *reload*, if there is one, brings the tables up to date first.
    """

    def __init__(
        self, spark: SparkSession, start: Callable[[], StreamingQuery], lost: Callable[[], bool] | None = None, reload: Callable[[], None] | None = None,
        failures: int | None = None, sleep: Callable[[float], None] = time.sleep,
    ):
        self.spark, self.start, self.lost, self.reload, self.failures, self.sleep = spark, start, lost, reload, failures, sleep
        self.delays: list[int] = []
        self.rows = self.gaps = self._attempt = 0
        self._query: StreamingQuery | None = None
        self._ended, self._run = threading.Event(), threading.Event()
        self._run.set()

    def _seen(self, query: str, rows: int) -> None:
        if self._query is not None and query == str(self._query.id):
            self.rows += rows
            self._attempt = 0

    def run(self) -> None:
        listener = _Progress(self._seen)
        self.spark.streams.addListener(listener)
        try:
            while not self._ended.is_set():
                self._run.wait()
                if self._ended.is_set():
                    return
                if self.lost is not None and self.lost():
                    self.gaps += 1
                    if self.reload is not None:
                        self.reload()
                try:
                    self._query = self.start()
                    self._query.awaitTermination()
                    if self._run.is_set():
                        return
                except PySparkException:
                    if self.failures is not None and len(self.delays) >= self.failures:
                        raise
                    self.delays.append(backoff(self._attempt))
                    self._attempt += 1
                    self.sleep(self.delays[-1])
        finally:
            self.spark.streams.removeListener(listener)

    def pause(self) -> None:
        """Stop the query; what it has taken stays in its checkpoint."""
        self._run.clear()
        if self._query is not None:
            self._query.stop()

    def resume(self) -> None:
        self._run.set()

    def stop(self) -> None:
        self._ended.set()
        self._run.set()
        if self._query is not None:
            self._query.stop()

    @property
    def state(self) -> str:
        return "stopped" if self._ended.is_set() else "paused" if not self._run.is_set() else "running" if self._query is not None and self._query.isActive else "waiting"
