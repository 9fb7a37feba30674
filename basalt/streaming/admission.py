"""Jobs that are admitted once for ever, by keys without a horizon.

Keys lie in buckets by a hash. Each bucket has a Bloom filter over all keys that it was ever given and files of the keys
themselves, one for each batch that added any. A batch of events asks the filters of the buckets that its keys fall in; a key
that its filter lacks is new, and of the key files only those of buckets with a key that the filter may know are opened. The
filters are a table of ``projection``, so a batch rewrites those of its own buckets only, and a batch that runs again sees the
filters and keys from before it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import stored
from . import projection
from .projection import _folders

BUCKETS = 256
#: Bits of a bucket's filter and those that a key sets: one wrong answer in 100 at 10 bits a key.
BITS = 1 << 20
SET = 7
KEYS = ("source", "source_event_id")


def positions(hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The bits of each key: a row of ``SET`` numbers for each hash."""
    h = hashes.astype(np.uint64) // np.uint64(buckets)
    step = (h >> np.uint64(20)) | np.uint64(1)
    return (h[:, None] + np.arange(SET, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)


def _filters(spark: SparkSession, path: str, batch: int, buckets: list[int], bits: int) -> DataFrame:
    """bucket, bits before a batch, of those buckets that have a filter."""
    wanted = spark.createDataFrame([(b,) for b in buckets], "bucket int")
    where = [r["_b"] for r in wanted.select(projection.bucket("bucket").alias("_b")).distinct().collect()]
    known = projection.read(spark, f"{path}/_filters", before=batch, only=where)
    return known.select("bucket", "bits").join(wanted, "bucket", "left_semi") if known is not None else spark.createDataFrame([], "bucket int, bits binary")


def _asked(keys: DataFrame, filters: DataFrame, buckets: int, bits: int) -> DataFrame:
    """bucket, hash, maybe: whether the filter of its bucket may know a key."""

    def ask(left, right):
        import pyarrow as pa

        hashes = left.column("hash").to_numpy()
        known = np.frombuffer(right.column("bits")[0].as_py(), np.uint8) if right.num_rows else np.zeros(bits >> 3, np.uint8)
        at = positions(hashes, buckets, bits)
        maybe = ((known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
        return pa.table({"bucket": left.column("bucket"), "hash": left.column("hash"), "maybe": pa.array(maybe)})

    return keys.select("bucket", "hash").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(ask, "bucket int, hash long, maybe boolean")


def _added(keys: DataFrame, filters: DataFrame, buckets: int, bits: int) -> DataFrame:
    """bucket, bits with the keys added."""

    def add(left, right):
        import pyarrow as pa

        known = np.frombuffer(right.column("bits")[0].as_py(), np.uint8).copy() if right.num_rows else np.zeros(bits >> 3, np.uint8)
        at = positions(left.column("hash").to_numpy(), buckets, bits).ravel()
        np.bitwise_or.at(known, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        return pa.table({"bucket": left.column("bucket").slice(0, 1), "bits": pa.array([known.tobytes()], pa.binary())})

    return keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(add, "bucket int, bits binary")


def admit(rows: DataFrame, path: str, batch: int, order: str = "ts", keys: tuple[str, ...] = KEYS, buckets: int = BUCKETS, bits: int = BITS, seen: Callable[[dict], None] | None = None) -> DataFrame:
    """Rows whose key no earlier batch had, the first by ``order`` of each; notes their keys. Rows without a key are left out.

    ``seen`` gets what the batch did: keys, buckets they fall in, keys that a filter may know, buckets whose keys were read.
    """
    spark = rows.sparkSession
    ship(spark)
    names = [c for c in rows.columns if c not in (*keys, order)]
    whole = rows.where(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0)
    first = whole.groupBy(*keys).agg(F.min(F.struct(F.col(order).isNull().alias("_late"), order, *names)).alias("_f")).select(*keys, "_f.*").drop("_late")
    first = stored(first.withColumn("hash", F.xxhash64(*keys)).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int")), "batch")
    mine = sorted(r["bucket"] for r in first.select("bucket").distinct().collect())  # at most ``buckets``
    if not mine:
        return first.select(*rows.columns)
    filters = stored(_filters(spark, path, batch, mine, bits), "filters")
    maybe = stored(_asked(first, filters, buckets, bits).where("maybe").select("bucket", "hash").distinct(), "maybe")
    open_ = sorted(r["bucket"] for r in maybe.select("bucket").distinct().collect())
    files = [f"{path}/_keys/bucket={b}/{f}" for b in open_ for f in _folders(spark, f"{path}/_keys/bucket={b}") if f.startswith("batch=") and int(f.removeprefix("batch=")) < batch]
    new = first
    if files:
        known = spark.read.schema(first.select("hash", *keys).schema).parquet(*files).join(maybe.select("hash"), "hash", "left_semi")
        new = stored(first.join(known, ["hash", *keys], "left_anti"), "new")
    new.select("hash", *keys, "bucket", F.lit(batch).alias("batch")).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{path}/_keys")
    added = _added(first.select("bucket", "hash"), filters, buckets, bits).withColumns({"batch": F.lit(batch), "deleted": F.lit(False)})
    projection.apply(added, f"{path}/_filters", batch, "bucket", "batch")
    projection.vacuum(spark, f"{path}/_filters")
    if seen:
        seen({"keys": first.count(), "buckets": len(mine), "maybe": maybe.count(), "read": len({f.split("/bucket=")[1].split("/")[0] for f in files})})
    return new.select(*rows.columns)
