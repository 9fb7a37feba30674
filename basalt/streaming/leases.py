"""Jobs whose leases end by time: a stream with timers, and the same over a table of events.

A job is queued, processing, completed or failed. A claim takes a queued job from its next run on and locks it; a job that
is still locked when its lease is over is queued again, without any event of its own; a failure queues it after a
growing delay, until its attempts are used up. Events that don't apply change nothing. Times are milliseconds.

The stream keeps one value and the events that the watermark hasn't passed for each job; timers at these events and at the
end of a lease move it on, so what it gives doesn't depend on the order in which events come within the watermark's delay.
A job that has ended is forgotten after ``RETENTION_MS``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.operations import LEASE_SECONDS, MAX_ATTEMPTS, STALE
from ..session import ship

LEASE_MS = LEASE_SECONDS * 1000
RETENTION_MS = 3 * 86_400_000
#: Where state with timers is kept; a session's setting.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGE = "job_id long, status string, attempts int, at long, code string"


@dataclass
class Job:
    """locked: when it was claimed, or -1; of a job that has ended, the stream keeps since when."""

    status: str = "queued"
    attempts: int = 0
    next_run: int = 0
    locked: int = -1

    def ended(self) -> bool:
        return self.status in ("completed", "failed")

    def expire(self, now: int, lease: int) -> Iterator[tuple[str, int, int, str | None]]:
        """Queues the job again if its lease was over before ``now``; attempts stay as they are."""
        if self.status == "processing" and now > self.locked + lease:
            at, self.status, self.locked = self.locked + lease, "queued", -1
            yield self.status, self.attempts, at, STALE

    def apply(self, name: str, at: int, max_attempts: int) -> Iterator[tuple[str, int, int, str | None]]:
        """One event; gives (status, attempts, at, code) if it changes the job."""
        if name == "claim" and self.status == "queued" and at >= self.next_run:
            self.status, self.attempts, self.locked = "processing", self.attempts + 1, at
        elif name == "complete" and self.status == "processing":
            self.status, self.locked = "completed", -1
        elif name == "fail" and self.status == "processing":
            self.status, self.locked = ("failed" if self.attempts >= max_attempts else "queued"), -1
            if self.status == "queued":
                self.next_run = at + 1000 * min(300, max(5, 5 * 2 ** (self.attempts - 1)))
        else:
            return
        yield self.status, self.attempts, at, None

    def advance(self, events: Iterable[tuple[str, int]], now: int, lease: int, max_attempts: int) -> Iterator[tuple[str, int, int, str | None]]:
        """Events in the order of time, with the ends of leases between them, up to ``now``."""
        for name, at in events:
            yield from self.expire(at, lease)
            yield from self.apply(name, at, max_attempts)
        yield from self.expire(now, lease)


class Leases(StatefulProcessor):
    """A job's value, the events that wait for the watermark, and a timer for whatever comes next."""

    def __init__(self, lease: int = LEASE_MS, max_attempts: int = MAX_ATTEMPTS, retention: int = RETENTION_MS):
        self.lease, self.max_attempts, self.retention = lease, max_attempts, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, next_run long, locked long")
        self.waiting = handle.getListState("waiting", "name string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = set(self.handle.listTimers())
        for row in rows:
            self.waiting.appendValue((row["name"], row["at"]))
            if row["at"] not in known:
                self.handle.registerTimer(row["at"])
                known.add(row["at"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Nothing before the watermark comes any more, so the job goes on to it at once.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        job = Job(*self.job.get()) if self.job.exists() else Job()
        waiting = [(name, at) for name, at in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((e for e in waiting if e[1] <= now), key=lambda e: (e[1], e[0]))
        later = [e for e in waiting if e[1] > now]
        changes = list(job.advance(due, now, self.lease, self.max_attempts))
        if later and due:
            self.waiting.put(later)
        elif not later:
            self.waiting.clear()
        if changes and job.ended():
            job.locked = changes[-1][2]  # since when it has ended
            self.handle.registerTimer(job.locked + self.retention)
        elif changes and job.status == "processing":
            self.handle.registerTimer(job.locked + self.lease + 1)
        if job.ended() and not later and now >= job.locked + self.retention:
            self.job.clear()
        elif changes or not self.job.exists():
            self.job.update((job.status, job.attempts, job.next_run, job.locked))
        return iter([Row(job_id=key[0], status=s, attempts=n, at=at, code=code) for s, n, at, code in changes])


def job_changes(events: DataFrame, delay: str = "1 minute", lease: int = LEASE_MS, max_attempts: int = MAX_ATTEMPTS, retention: int = RETENTION_MS, at: str = "ts") -> DataFrame:
    """job_id, name and a timestamp -> a row (job_id, status, attempts, at, code) at every change of a job's state.

    Needs the state store of ``with_timers``. Events later than ``delay`` are dropped, as are those without id, name or time.
    """
    ship(events.sparkSession)
    rows = events.where(F.col("job_id").isNotNull() & F.col("name").isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    rows = rows.select(F.col("job_id").cast("long").alias("job_id"), "name", F.unix_millis(at).alias("at"), F.col(at).alias("_event_time"))
    return rows.groupBy("job_id").transformWithState(Leases(lease, max_attempts, retention), CHANGE, "append", "EventTime")


def with_timers(spark: SparkSession) -> SparkSession:
    """Puts the state store that keeps timers into a session, before a stream starts."""
    spark.conf.set(*PROVIDER)
    return spark


def leased_states(events: DataFrame, as_of: int, lease: int = LEASE_MS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """job_id, name, at -> job_id, status, attempts, next_run, n_stale of every job as it stands at ``as_of``.

    Rows are sorted by job and time and folded as they pass, so a task holds one job's state, however many events it has.
    Events without id, name or time are left out, as are those after ``as_of``.
    """
    ship(events.sparkSession)
    rows = events.select(F.col("job_id").cast("long").alias("job_id"), "name", F.col("at").cast("long").alias("at")).where(f"job_id is not null and name is not null and at <= {int(as_of)}")

    def fold(batches):
        import pyarrow as pa

        key, job, stale = None, Job(), 0

        def closed():
            n = stale + sum(1 for _ in job.expire(as_of, lease))
            return key, job.status, job.attempts, job.next_run, n

        def batch_of(out):
            types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["job_id", "status", "attempts", "next_run", "n_stale"])

        for batch in batches:
            out = []
            for job_id, name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if job_id != key:
                    if key is not None:
                        out.append(closed())
                    key, job, stale = job_id, Job(), 0
                stale += sum(1 for _ in job.expire(at, lease))
                for _ in job.apply(name, at, max_attempts):
                    pass
            if out:
                yield batch_of(out)
        if key is not None:
            yield batch_of([closed()])

    return rows.repartition("job_id").sortWithinPartitions("job_id", "at", "name").mapInArrow(fold, "job_id long, status string, attempts int, next_run long, n_stale long")
