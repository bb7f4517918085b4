"""Watching a workspace: filtered events, debounced to sessions, or a polled listing compared with the last one."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def relevant(events: DataFrame, exclude: tuple[str, ...], path: str = "path") -> DataFrame:
    """Drops absolute names and names with an excluded segment at any depth."""
    names = F.array(*[F.lit(x) for x in exclude]) if exclude else F.array().cast("array<string>")
    return events.where(~F.col(path).startswith("/") & ~F.arrays_overlap(F.split(path, "/"), names))


def debounced(events: DataFrame, gap: str = "300 milliseconds", ts: str = "ts", keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """``keys, start, end, n``: one row for each run of events with pauses under the gap; works on batches and streams."""
    timed = events.withWatermark(ts, late) if late else events
    # A stream's sessions need a key: without any, one that is 0 for all events, which the optimizer does not see.
    every = () if keys else (F.pmod(F.xxhash64(ts), F.lit(1)).alias("__every"),)
    return timed.groupBy(*keys, *every, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bursts(events: DataFrame, gap_ms: int = 300, ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, start, end, n`` of a stream: a burst of a key ends when nothing of it has arrived for the gap.

    The pause is measured by the clock, so the last burst is handed on without
    a later event; ``start`` and ``end`` are the least and greatest event time,
    ``n`` counts the events, those without a time too (a burst of only these
    has null ends).  Null keys are a key.  State is one row a key with an open
    burst, and goes when it ends.  While any is open, Spark runs batches
    without data to look at the clock.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    key_of = {k: f"key_{i}" for i, k in enumerate(keys)}  # no clash with the columns below
    columns = ", ".join([*(f"{key_of[k]} {types[k]}" for k in keys), "start timestamp", "end timestamp", "n long"])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            low, high, n = state.get
            state.remove()
            times = [None if x is None else pd.Timestamp(x, unit="us", tz="UTC") for x in (low, high)]
            cells = [*key[: len(keys)], *times, n]
            yield pd.DataFrame({name.strip().split(" ")[0]: pd.Series([c], dtype="datetime64[us, UTC]" if name.strip().endswith("timestamp") else None) for name, c in zip(columns.split(", "), cells, strict=True)})
            return
        low, high, n = state.get if state.exists else (None, None, 0)
        for frame in frames:
            seen = frame["us"].dropna()
            n += len(frame)
            if len(seen):
                least, most = int(seen.min()), int(seen.max())
                low, high = min(least, least if low is None else low), max(most, most if high is None else high)
        state.update((low, high, n))
        state.setTimeoutDuration(gap_ms)

    rows = events.select(*[F.col(k).alias(key_of[k]) for k in keys], F.unix_micros(ts).alias("us"), F.lit(0).alias("every"))
    found = rows.groupBy(*(key_of.values() or ["every"])).applyInPandasWithState(step, columns, "low long, high long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return found.select(*[F.col(v).alias(k) for k, v in key_of.items()], "start", "end", "n")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``rel, change`` between two listings ``rel, size, mtime_ms``."""
    a = before.select("rel", F.struct("size", "mtime_ms").alias("a"))
    b = after.select("rel", F.struct("size", "mtime_ms").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("updated")
    return a.join(b, "rel", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("rel", change.alias("change"))


def on_sessions(sessions: DataFrame, act: Callable[[], None], checkpoint: str) -> StreamingQuery:
    """Calls ``act`` once for each micro-batch that closes at least one session; pending ones are coalesced."""

    def run(batch: DataFrame, _: int) -> None:
        # A full pass: every partition of the state must be run.
        if batch.count():
            act()

    return sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run).start()


def excluded(name: str, exclude: tuple[str, ...]) -> bool:
    """As ``relevant``, for one name."""
    return name.startswith("/") or not set(exclude).isdisjoint(name.replace("\\", "/").split("/"))


def snapshot(root: str, exclude: tuple[str, ...] = ()) -> dict[str, tuple]:
    """Size and times of the regular files under ``root``; files that vanish meanwhile are left out."""
    found, stack = {}, [""]
    while stack:
        folder = stack.pop()
        for entry in os.scandir(os.path.join(root, folder)):
            name = f"{folder}/{entry.name}" if folder else entry.name
            if excluded(name, exclude):
                continue
            try:
                if entry.is_dir(follow_symlinks=False):
                    stack.append(name)
                elif entry.is_file():
                    stat = entry.stat()
                    found[name] = (stat.st_size, stat.st_mtime_ns, stat.st_ctime_ns)
            except OSError:
                continue
    return found


class DirWatcher:
    """Polls a folder's metadata from a thread and calls ``on_change`` once changes have paused for the debounce time.

    The first look only remembers what is there.  A failed look counts as no
    change.  Nothing is called after ``close``.
    """

    def __init__(self, root: str, on_change: Callable[[], object], exclude: tuple[str, ...] = (), debounce_ms: float = 300, polling_ms: float = 1500):
        self.root, self.on_change, self.exclude = root, on_change, tuple(exclude)
        self.debounce, self.polling = max(0.0, debounce_ms) / 1000, max(250.0, polling_ms) / 1000
        self._last: dict[str, tuple] | None = None
        self._due: float | None = None
        self._closed = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> DirWatcher:
        self.poll()
        self._thread.start()
        return self

    def close(self) -> None:
        self._closed.set()
        if self._thread.is_alive() and self._thread is not threading.current_thread():
            self._thread.join(self.polling + 1)

    def fire(self, name: str | None = None) -> None:
        """An event from elsewhere (None: of an unknown file); it starts the pause anew."""
        if not self._closed.is_set() and not (name and excluded(name, self.exclude)):
            self._due = time.monotonic() + self.debounce

    def poll(self) -> bool:
        """Looks once; whether anything changed since the last look."""
        try:
            now = snapshot(self.root, self.exclude)
        except OSError:
            return False
        changed = self._last is not None and now != self._last
        self._last = now
        if changed:
            self.fire()
        return changed

    def _run(self) -> None:
        looked = time.monotonic()
        while not self._closed.wait(min(0.05, self.polling)):
            if time.monotonic() - looked >= self.polling:
                self.poll()
                looked = time.monotonic()
            if self._due is not None and time.monotonic() >= self._due:
                self._due = None
                self.on_change()


class Refresher:
    """Coalesces refreshes: those asked for before ``ready``, or while one runs, become a single one afterwards."""

    def __init__(self, act: Callable[[], object], on_error: Callable[[Exception], object] = lambda e: None):
        self.act, self.on_error = act, on_error
        self._lock, self._running, self._pending, self._booted, self._closed = threading.Lock(), False, False, False, False

    def ready(self) -> None:
        self._booted = True
        if self._pending:
            self.ask()

    def close(self) -> None:
        self._closed = True

    def ask(self) -> None:
        with self._lock:
            self._pending = True
            if self._running or not self._booted or self._closed:
                return
            self._running = True
        try:
            while self._pending and not self._closed:
                self._pending = False
                try:
                    self.act()
                except Exception as e:  # a failed refresh must not end the watching; the next change tries again
                    self.on_error(e)
        finally:
            self._running = False
