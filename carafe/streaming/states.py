"""Keyed state that ends: job states, remembered matches and results in order, with event-time timers.

Each of these keeps a small state by key and a timer at the time when it ends; when the watermark passes that time, Spark calls the processor, which clears
the state. Spark drops what comes later than the watermark. An event that comes after its key's state has ended, and isn't late, begins anew, as
after the end of a stored key. Use ``spark.sql.streaming.stateStore.providerClass`` = RocksDB's, as Spark asks for these operators.

Scale. A key's rows of one batch are read as an iterator in order of arrival and never gathered, except by ``in_order``, which keeps what came early.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.jobs import TERMINAL

#: How long a job's state and a remembered match hold.
JOB_HOURS = 24
MEMORY_DAYS = 30


def _ms(time: datetime) -> int:
    return int((time if time.tzinfo else time.replace(tzinfo=timezone.utc)).timestamp() * 1000)


class _Ending(StatefulProcessor):
    """A processor whose state ends ``hold_ms`` after the last thing that was written."""

    def __init__(self, hold_ms: int) -> None:
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def forget(self) -> None: ...

    def hold(self, written_ms: int) -> None:
        """The state holds from now on until after ``written_ms``; it never ends earlier than it did."""
        end = written_ms + self.hold_ms
        known = self.until.get()[0] if self.until.exists() else None
        if known is None or end > known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(end)
            self.until.update((end,))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.forget()
        self.until.clear()
        return iter(())

    def close(self) -> None: ...


class JobStatus(_Ending):
    """The first terminal status by seq, else the latest, and how many events; a row a batch and job."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "terminal string, terminal_seq long, latest string, latest_seq long, n long")

    def forget(self) -> None:
        self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        terminal, terminal_seq, latest, latest_seq, n = self.state.get() if self.state.exists() else (None, None, None, None, 0)
        newest = 0
        for row in rows:
            n, newest = n + 1, max(newest, _ms(row.at))
            if row.status in TERMINAL and row.seq is not None and (terminal_seq is None or row.seq < terminal_seq):
                terminal, terminal_seq = row.status, row.seq
            if row.seq is not None and (latest_seq is None or row.seq > latest_seq):
                latest, latest_seq = row.status, row.seq
        self.state.update((terminal, terminal_seq, latest, latest_seq, n))
        self.hold(newest)
        yield Row(job_id=key[0], status=terminal or latest, n_events=n)


def expiring_job_status(events: DataFrame, late: str = "10 minutes", hours: int = JOB_HOURS) -> DataFrame:
    """job_id, status, n_events whenever a job has new events, as ``job_status``; a job's state goes ``hours`` after its last event.

    ``events`` has job_id (string), seq (long), status and the event time ``at``. Events without a time are left out: they could never be late.
    """
    timed = events.where(F.col("at").isNotNull()).select(F.col("job_id").cast("string").alias("job_id"), F.col("seq").cast("long").alias("seq"), F.col("status").cast("string").alias("status"), "at").withWatermark("at", late)
    return timed.groupBy("job_id").transformWithState(JobStatus(hours * 3_600_000), "job_id string, status string, n_events long", "Update", "EventTime")


class Memory(_Ending):
    """A remembered value by key: written by a hit, read by what follows, and never by a miss."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("value", "value string")

    def forget(self) -> None:
        self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for row in rows:
            # within a batch the timers haven't fired yet
            if self.until.exists() and self.until.get()[0] <= _ms(row.at):
                self.handle.deleteTimer(self.until.get()[0])
                self.forget()
                self.until.clear()
            if self.state.exists():
                yield Row(key=key[0], id=row.id, value=self.state.get()[0], remembered=True)
                continue
            if row.value is not None:
                self.state.update((row.value,))
                self.hold(_ms(row.at))
            yield Row(key=key[0], id=row.id, value=row.value, remembered=False)


def remembered_matches(lookups: DataFrame, late: str = "1 hour", days: int = MEMORY_DAYS) -> DataFrame:
    """key, id, value, remembered: each lookup with the value that its key remembers, else its own, which is remembered for ``days`` if there is one.

    ``lookups`` has key, id, value (null: a miss) and the event time ``at``; a key's lookups of one batch are taken in the order in which they come.
    """
    timed = lookups.where(F.col("at").isNotNull()).select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("value").cast("string").alias("value"), "at").withWatermark("at", late)
    return timed.groupBy("key").transformWithState(Memory(days * 86_400_000), "key string, id long, value string, remembered boolean", "Append", "EventTime")


class InOrder(_Ending):
    """Results by place, given out from the first on without a gap; what comes early waits."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "place long")
        self.waiting = handle.getMapState("waiting", "place long", "result string")

    def forget(self) -> None:
        self.next.clear()
        self.waiting.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        at = self.next.get()[0] if self.next.exists() else 0
        newest = 0
        for row in rows:
            newest = max(newest, _ms(row.at))
            if row.place is not None and row.place >= at and not self.waiting.containsKey((row.place,)):
                self.waiting.updateValue((row.place,), (row.result,))
        while self.waiting.containsKey((at,)):
            yield Row(job_id=key[0], place=at, result=self.waiting.getValue((at,))[0], completed=at + 1)
            self.waiting.removeKey((at,))
            at += 1
        self.next.update((at,))
        self.hold(newest)


def in_order(results: DataFrame, late: str = "10 minutes", hours: int = JOB_HOURS) -> DataFrame:
    """job_id, place, result, completed: each job's results in order of place (from 0), so that what has been given out is always a prefix.

    ``results`` has job_id, place, result and the event time ``at``. The first result of a place counts; repeats are dropped. What waits for a
    place that never comes goes with the job's state, ``hours`` after its last result.
    """
    timed = results.where(F.col("at").isNotNull()).select(F.col("job_id").cast("string").alias("job_id"), F.col("place").cast("long").alias("place"), F.col("result").cast("string").alias("result"), "at").withWatermark("at", late)
    return timed.groupBy("job_id").transformWithState(InOrder(hours * 3_600_000), "job_id string, place long, result string, completed long", "Append", "EventTime")
