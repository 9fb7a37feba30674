"""Batches in time: a batch starts with a row and takes all later ones of its key for some seconds, up to a number of rows.

Where a batch starts depends on where the one before started, so a key's rows form one chain. It is followed in parts: rows
are dealt to ranges of (key, time), and each range tells, for every row at which a batch that began before it could end, what
state the chain leaves the range in (pointers to the next start, followed from the end of the range). These answers, one row a
range, are then read in order, which gives the state that each range is entered with; and all ranges fold their rows at once.
So one key may have any number of rows, over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..storage import stored


def next_starts(t: np.ndarray, seconds: float, most: int | None) -> np.ndarray:
    """For each row as the start of a batch, the row that starts the next one; the number of rows if none does."""
    n = len(t)
    j = np.maximum(np.searchsorted(t, t + seconds, "left"), np.arange(1, n + 1))
    while True:  # sums and differences may round apart by a place
        back = (j > np.arange(1, n + 1)) & (t[np.maximum(j - 1, 0)] - t >= seconds)
        on = (j < n) & (t[np.minimum(j, n - 1)] - t < seconds)
        if not (back.any() or on.any()):
            break
        j = j - back + (on & ~back)
    return np.minimum(j, np.arange(n) + most) if most else j


def leaving(t: np.ndarray, seconds: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each row as a start: the last start that follows from it, and how many starts there are."""
    n = len(t)
    after = next_starts(t, seconds, most).tolist()
    last, many = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if after[i] >= n:
            last[i], many[i] = i, 1
        else:
            last[i], many[i] = last[after[i]], many[after[i]] + 1
    return np.array(last, np.int64), np.array(many, np.int64)


def entered(t: np.ndarray, start: float, count: int, seconds: float, most: int | None) -> int:
    """The first row that isn't in a batch that began at ``start`` and has ``count`` rows so far."""
    e = int(np.searchsorted(t - start, seconds, "left"))
    return min(e, max(0, most - count)) if most else e


_ANSWER = "part int, first {kind}, last {kind}, n long, single boolean, times array<double>, start array<double>, count array<long>, many array<long>, end_start double, end_count long, end_many long"


def _answers(parts: DataFrame, kind: str, seconds: float, most: int | None) -> DataFrame:
    """One row for each range: what it does with a batch that reaches into it, and the state that its last key ends in."""

    def of(part: int, keys: list, times: np.ndarray) -> dict:
        first = next((i for i, k in enumerate(keys) if k != keys[0]), len(keys))
        t = times[:first]
        last, many = leaving(t, seconds, most)
        reach = min(first, entered(t, t[0], 1, seconds, most) + 1)
        at = last[:reach]
        row = {"part": part, "first": keys[0], "last": keys[-1], "n": first, "single": first == len(keys), "times": t[:reach].tolist(), "start": t[at].tolist(), "count": (first - at).tolist(), "many": many[:reach].tolist()}
        if first < len(keys):
            begin = next(i for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]) + 1
            own = times[begin:]
            end, starts = leaving(own, seconds, most)
            row |= {"end_start": float(own[end[0]]), "end_count": len(own) - int(end[0]), "end_many": int(starts[0])}
        else:
            row |= {"end_start": None, "end_count": None, "end_many": None}
        return row

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, keys, times, schema = None, [], [], None

        def one():
            return pa.RecordBatch.from_pylist([of(part, keys, np.concatenate(times))], schema=schema)

        for batch in batches:
            if schema is None:
                kind = batch.schema.field(1).type
                real, whole = pa.list_(pa.float64()), pa.list_(pa.int64())
                schema = pa.schema([("part", pa.int32()), ("first", kind), ("last", kind), ("n", pa.int64()), ("single", pa.bool_()), ("times", real), ("start", real), ("count", whole), ("many", whole), ("end_start", pa.float64()), ("end_count", pa.int64()), ("end_many", pa.int64())])
            found = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(found[1:] != found[:-1]) + 1, len(found)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if part is not None and found[a] != part:
                    yield one()
                    keys, times = [], []
                part = int(found[a])
                keys += batch.column(1).slice(a, b - a).to_pylist()
                times.append(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False))
        if part is not None:
            yield one()

    return parts.mapInArrow(work, _ANSWER.format(kind=kind))


def _entries(answers: DataFrame, seconds: float, most: int | None) -> DataFrame:
    """part, goes_on, start, count, batch: the state that each range is entered with. One row a range is read, in order."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, key, start, count, batch = False, None, 0.0, 0, 0
        for some in batches:
            out = []
            for r in some.to_pylist():
                goes_on = known and r["first"] == key
                out.append((r["part"], goes_on, start, count, batch))
                if goes_on:
                    e = entered(np.array(r["times"]), start, count, seconds, most)
                    e = min(e, r["n"])
                else:
                    e, batch = 0, -1
                if e >= r["n"]:
                    count += r["n"]
                else:
                    start, count, batch = r["start"][e], r["count"][e], batch + r["many"][e]
                if not r["single"]:
                    start, count, batch = r["end_start"], r["end_count"], r["end_many"] - 1
                known, key = True, r["last"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["part", "goes_on", "start", "count", "batch"])

    return answers.repartition(1).sortWithinPartitions("part").mapInArrow(work, "part int, goes_on boolean, start double, count long, batch long")


def windows(rows: DataFrame, key: str, at: str, seconds: float, most: int | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``batch``, from 0 for each key. Rows of one time go in the order of their other columns; null keys are one key.

    ``at`` is a number of seconds and isn't null.
    """
    ship(rows.sparkSession)
    names = rows.columns
    order = [F.col(key).asc_nulls_first(), F.col(at).asc(), *[F.col(c).asc_nulls_first() for c in names if c not in (key, at)]]
    ranges = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    held = stored(ranges.withColumn("_part", F.spark_partition_id()), "ranges")
    sorted_ = held.select("_part", F.col(key), F.col(at).cast("double").alias("_at"), *[c for c in names if c not in (key, at)]).repartition("_part").sortWithinPartitions("_part", F.col(key).asc_nulls_first(), "_at")
    kind = rows.schema[key].dataType.simpleString()
    entries = stored(_entries(_answers(sorted_.select("_part", key, "_at"), kind, seconds, most), seconds, most), "entries")
    state = entries.select(F.col("part").alias("_p"), F.struct("goes_on", "start", "count", "batch").alias("_s"))
    ready = held.join(state, F.col("_part") == F.col("_p")).select(*names, "_part", "_s").repartition("_part").sortWithinPartitions("_part", *order)

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, of, start, count, number = None, object(), 0.0, 0, -1
        for some in batches:
            out = []
            i_key, i_at = some.schema.get_field_index(key), some.schema.get_field_index(at)
            states = some.column(len(names) + 1)
            for i, (k, t, p) in enumerate(zip(some.column(i_key).to_pylist(), some.column(i_at).cast(pa.float64()).to_pylist(), some.column(len(names)).to_pylist(), strict=True)):
                if p != part:
                    s = states[i].as_py()
                    part, of = p, k if s["goes_on"] else object()
                    start, count, number = s["start"], s["count"], s["batch"]
                if k != of:
                    of, number, count, start = k, 0, 0, t
                elif t - start >= seconds or (most and count >= most):
                    number, count, start = number + 1, 0, t
                count += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], pa.array(out, pa.int64())], names=[*names, "batch"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch long"
    return ready.mapInArrow(fold, schema)


def throttled(deltas: DataFrame, key: str, at: str, seconds: float, delta: str = "delta", parts: int | None = None) -> DataFrame:
    """key, at, n_chars, text: what a buffer holds whenever it is shown, at its first piece and then once every ``seconds`` at most.

    A key's text is put together once; what is shown at a time is its beginning, by a sum of lengths.
    """
    cut = stored(windows(deltas, key, at, seconds, parts=parts), "pieces")
    spot = F.struct(at, *[c for c in deltas.columns if c not in (key, at)])
    whole = cut.groupBy(F.col(key).alias("_k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(spot.alias("p"), F.coalesce(delta, F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("_whole"))
    # The first piece of each batch is shown with all pieces of the batches before it, and itself.
    batches = cut.groupBy(key, "batch").agg(F.min(F.struct(spot.alias("p"), F.length(F.coalesce(delta, F.lit(""))).alias("n"))).alias("f"), F.sum(F.length(F.coalesce(delta, F.lit("")))).alias("all"))
    return _shown(batches, whole, key, at)


def _shown(batches: DataFrame, whole: DataFrame, key: str, at: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.coalesce(F.sum("all").over(Window.partitionBy(key).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = batches.withColumn("n_chars", before + F.col("f.n"))
    out = rows.join(whole, F.col(key).eqNullSafe(F.col("_k")))
    return out.select(key, F.col(f"f.p.{at}").alias(at), "n_chars", F.left("_whole", F.col("n_chars").cast("int")).alias("text"))
