"""Aborting operations of an index from another thread."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Aborted(RuntimeError):
    """The operation was aborted before it took effect."""


class Abort:
    """Handed to an operation, ends it when asked: one that waits for its turn at once, a running one by cancelling its jobs."""

    def __init__(self) -> None:
        self.tag = f"quarrix-{uuid.uuid4().hex}"
        self._asked, self._idle = threading.Event(), threading.Event()
        self._idle.set()
        self._spark: SparkSession | None = None

    def ask(self) -> None:
        """Returns when the operation has ended; jobs that it starts meanwhile are cancelled as well."""
        self._asked.set()
        while not self._idle.wait(0.1):
            self._spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self._asked.is_set():
            raise Aborted("aborted")

    @contextmanager
    def turn(self, spark: SparkSession, lock: threading.RLock) -> Iterator[None]:
        """Holds the lock and tags this thread's jobs."""
        self.check()
        while not lock.acquire(timeout=0.05):
            self.check()
        try:
            self._spark = spark
            self._idle.clear()
            spark.sparkContext.addJobTag(self.tag)
            try:
                self.check()
                yield
            except Exception as e:
                # What a cancelled job raises is the abort.
                if self._asked.is_set() and not isinstance(e, Aborted):
                    raise Aborted("aborted") from e
                raise
            finally:
                spark.sparkContext.removeJobTag(self.tag)
                self._idle.set()
        finally:
            lock.release()
