"""Streams: normalised ingest, idempotent enqueue, debouncing, job state machine, counted triggers. Timed leases and projections
have modules of their own.

State is bounded by watermarks; where an unbounded horizon is asked for (a source's event ids), the target table's keys
are the guarantee and the stream's state only spares work. Micro-batches write in foreachBatch, keyed by batch, so that a
batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import operations as O
from . import admission

EVENT = "source string, event_id string, event_type string, team string, channel string, thread string, page string, version int, text string, subtype string, bot string, ts timestamp"


def read_json(spark: SparkSession, path: str, schema: str = EVENT, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def admitted(events: DataFrame) -> DataFrame:
    """Messages with text and no bot, plain or shared files."""
    return events.where((F.coalesce("subtype", F.lit("")).isin("", "file_share")) & F.col("bot").isNull() & (T.strip(F.coalesce("text", F.lit(""))) != ""))


def normalised(events: DataFrame) -> DataFrame:
    """Adds source_event_id (page:event:version for pages, the id or a hash otherwise) and conversation_key."""
    page_id = F.concat_ws(":", "page", "event_type", F.coalesce(F.col("version").cast("string"), F.lit("0")))
    other = F.coalesce(T.blank_to_null(F.col("event_id")), F.sha2(F.to_json(F.struct("channel", "event_type", "page", "source", "team", "text", "thread", "ts")), 256))
    key = F.when(F.col("page").isNotNull(), page_id).otherwise(other)
    return events.withColumn("source_event_id", key).withColumn("conversation_key", T.conversation_key(F.col("team"), F.col("channel"), F.col("thread")))


def unique(events: DataFrame, delay: str = "1 hour", at: str = "ts") -> DataFrame:
    """Drops repeats of (source, source_event_id) that come within the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["source", "source_event_id"])


def enqueue(events: DataFrame, path: str, checkpoint: str, buckets: int = admission.BUCKETS, bits: int = admission.BITS, seen: Callable[[dict], None] | None = None):
    """Appends new jobs to a table: the stream drops near repeats, the table's keys all others. Gives the started query.

    Of the rows of a key the first by time stays. Keys are kept beside the table, in buckets behind filters, so a batch reads
    those that it may repeat and not the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = admission.admit(batch, path, number, buckets=buckets, bits=bits, seen=seen)
        rows = rows.withColumn("status", F.lit("queued")).withColumn("attempt_count", F.lit(0)).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return unique(normalised(events)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(events: DataFrame, key: str = "page", seconds: int = O.DEBOUNCE_SECONDS, delay: str = "1 minute", at: str = "ts") -> DataFrame:
    """One row for each burst of a key, when it has been quiet: the last event's type counts."""
    late = events.withWatermark(at, delay)
    return late.groupBy(key, F.session_window(at, f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", at).alias("event_type"), F.max(at).alias("last_at")).select(key, F.col("session_window.start").alias("first_at"), "last_at", "n", "event_type")


def job_states(events: DataFrame, max_attempts: int = O.MAX_ATTEMPTS) -> DataFrame:
    """job_id, name, at -> a row at every change of a job's state; the state is four numbers a job."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ("queued", "processing", "completed", "failed")
        status, attempts, next_run, locked = state.get if state.exists else ("queued", 0, 0.0, -1.0)
        rows = pd.concat(list(batches)).sort_values(["at", "name"])
        out = []
        for name, at in zip(rows["name"], rows["at"], strict=True):
            before = status
            if name == "claim" and status == "queued" and at >= next_run:
                status, attempts, locked = "processing", attempts + 1, at
            elif name == "complete" and status == "processing":
                status, locked = "completed", -1.0
            elif name == "fail" and status == "processing":
                status, locked = ("failed", -1.0) if attempts >= max_attempts else ("queued", -1.0)
                next_run = at + min(300, max(5, 5 * 2 ** (attempts - 1))) if status == "queued" else next_run
            elif name == "timeout" and status == "processing" and at - locked > O.LEASE_SECONDS:
                status, locked = "queued", -1.0
            if status != before and status in names:
                out.append({"job_id": key[0], "status": status, "attempts": attempts, "at": at})
        state.update((status, attempts, float(next_run), float(locked)))
        yield pd.DataFrame(out, columns=["job_id", "status", "attempts", "at"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, attempts int, at double", "status string, attempts int, next_run double, locked double", "append", GroupStateTimeout.NoTimeout)


def counted(messages: DataFrame, every: int, key: str = "session") -> DataFrame:
    """A row at every n-th user message of a session; the state is one count a session."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        m = n + sum(int((b["role"] == "user").sum()) for b in batches)
        state.update((m,))
        yield pd.DataFrame([{key: k[0], "turns": t} for t in range((n // every + 1) * every, m + 1, every)], columns=[key, "turns"])

    return messages.groupBy(key).applyInPandasWithState(step, f"{key} string, turns int", "n int", "append", GroupStateTimeout.NoTimeout)


def drain(query) -> None:
    """Runs a started query to the end of what is available."""
    query.awaitTermination()


def in_memory(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """All results of a stream over what is available, as a table of the session; for tests and small reports."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    drain((writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start())
    return stream.sparkSession.table(name)


Handler = Callable[[DataFrame], None]


def dispatched(jobs: DataFrame, handlers: dict[tuple[str, str], Handler], checkpoint: str, every: str = "1 second", others: Handler | None = None):
    """Routes each micro-batch's jobs by (source, event_type) to handlers that write by key.

    Jobs that no handler is for go to ``others``; without it they stop the stream, as they would be lost.
    """

    def route(batch: DataFrame, number: int) -> None:
        batch.persist()
        mine = F.lit(False)
        for (source, kind), handle in handlers.items():
            one = F.col("source").eqNullSafe(source) & F.col("event_type").eqNullSafe(kind)
            handle(batch.where(one))
            mine = mine | one
        rest = batch.where(~mine)
        if others:
            others(rest)
        elif some := rest.select("source", "event_type").first():
            raise ValueError(f"no handler for {some['source']}, {some['event_type']}")
        batch.unpersist()

    return jobs.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
