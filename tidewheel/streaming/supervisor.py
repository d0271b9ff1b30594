"""Keeps a streaming job running across savepoints."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

from .checkpoint import Savepoints


class Supervisor:
    """Starts a job, and starts it again after each savepoint: the savepoint is
    taken between two batches, and the job goes on from its own checkpoint."""

    def __init__(self, start: Callable[[bool], StreamingQuery], savepoints: Savepoints):
        """start gets whether it is the first start (only that one resumes)."""
        self._start, self._savepoints, self._lock = start, savepoints, threading.Lock()
        self.query = start(True)

    def savepoint(self, name: str) -> dict:
        with self._lock:
            meta = self._savepoints.trigger(self.query, name)
            self.query = self._start(False)
            return meta

    def wait(self) -> None:
        """Until the job ends by itself or fails; a savepoint does not end it."""
        while True:
            query = self.query
            query.awaitTermination()
            with self._lock:
                if self.query is query:
                    return

    def stop(self) -> None:
        with self._lock:
            self.query.stop()
