"""A table that takes changes by key: what a batch doesn't touch isn't written again.

Rows lie in buckets by a hash of their key. A batch rewrites the buckets that its changes fall in, below a folder of its own
number, and then writes its manifest: for each bucket, the version whose files hold it now. A reader takes the newest manifest,
so it sees all of a batch or nothing of it, and a batch that runs again writes the same files and the same manifest. Batch n
is version 2 n; version 2 n + 1 is what ``compact`` makes of it.

A change counts if it isn't older than what the table has of its key; a deletion stays as a mark, so that an older change that
comes after it doesn't bring the row back. ``compact`` drops marks that are old enough; ``vacuum`` removes what no kept
manifest names. Manifests have at most ``buckets`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove

BUCKETS = 256
#: A bucket's folder; tables have no column of this name.
FOLDER = "basalt_bucket"


def _folders(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is whole, in order."""
    done = [n for n in _folders(spark, f"{path}/manifest") if n.startswith("version=") and "_SUCCESS" in _folders(spark, f"{path}/manifest/{n}")]
    return sorted(int(n.removeprefix("version=")) for n in done)


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """bucket -> the version that wrote it."""
    return {r["bucket"]: r["written"] for r in spark.read.parquet(f"{path}/manifest/version={version}").collect()}


def _rows(spark: SparkSession, path: str, held: dict[int, int], schema) -> DataFrame:
    """All rows and marks of these buckets."""
    some = [f"{path}/data/version={written}/{FOLDER}={bucket}" for bucket, written in sorted(held.items())]
    return spark.read.schema(schema).parquet(*some) if some else spark.createDataFrame([], schema)


def _schema(spark: SparkSession, path: str, held: dict[int, int]):
    bucket, written = min(held.items())
    return spark.read.parquet(f"{path}/data/version={written}/{FOLDER}={bucket}").schema


def read(spark: SparkSession, path: str, gone: str = "deleted", before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The table's rows, or those ``before`` a batch, or of some buckets ``only``; None if nothing was written."""
    known = [v for v in versions(spark, path) if before is None or v < 2 * before]
    held = manifest(spark, path, known[-1]) if known else {}
    held = {b: v for b, v in held.items() if only is None or b in only}
    return _rows(spark, path, held, _schema(spark, path, held)).where(~F.col(gone)).drop(gone) if held else None


def bucket(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def apply(changes: DataFrame, path: str, number: int, key: str, order: str, gone: str = "deleted", buckets: int = BUCKETS) -> int:
    """Applies a batch of changes (key, order, gone and other columns); gives the number of buckets that it wrote.

    Of several changes of a key the one with the largest ``order`` counts; null ``gone`` is false; rows without a key are
    left out. Batches are numbered upwards; one that has been applied is applied again to what was there before it.
    """
    spark, version = changes.sparkSession, 2 * number
    before = [v for v in versions(spark, path) if v < version]
    held = manifest(spark, path, before[-1]) if before else {}
    new = changes.where(F.col(key).isNotNull()).withColumn(gone, F.coalesce(F.col(gone), F.lit(False)))
    touched = sorted(r["_b"] for r in new.select(bucket(key, buckets).alias("_b")).distinct().collect())  # at most ``buckets``
    if touched:
        rows = new.withColumn("_new", F.lit(1))
        if old := {b: held[b] for b in touched if b in held}:
            rows = _rows(spark, path, old, new.schema).withColumn("_new", F.lit(0)).unionByName(rows)
        others = [c for c in new.columns if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(order), F.col("_new"))).alias("c")).select(key, "c.*")
        _write(last, path, version, key, buckets)
    _commit(spark, path, version, held | dict.fromkeys(touched, version))
    return len(touched)


def _write(rows: DataFrame, path: str, version: int, key: str, buckets: int) -> None:
    rows.withColumn(FOLDER, bucket(key, buckets)).repartition(FOLDER).write.mode("overwrite").partitionBy(FOLDER).parquet(f"{path}/data/version={version}")


def _commit(spark: SparkSession, path: str, version: int, held: dict[int, int]) -> None:
    spark.createDataFrame(sorted(held.items()), "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def compact(spark: SparkSession, path: str, key: str, order: str, before, gone: str = "deleted", buckets: int = BUCKETS) -> int:
    """Drops marks of deletions older than ``before`` from the buckets that have any; gives their number. Once after a batch."""
    known = versions(spark, path)
    held = manifest(spark, path, known[-1]) if known and known[-1] % 2 == 0 else {}
    if not held:
        return 0
    rows = _rows(spark, path, held, _schema(spark, path, held))
    old = F.col(gone) & (F.col(order) < before)
    touched = sorted(r["_b"] for r in rows.where(old).select(bucket(key, buckets).alias("_b")).distinct().collect())
    if touched:
        version = known[-1] + 1
        kept = _rows(spark, path, {b: held[b] for b in touched}, rows.schema).where(~old)
        left = sorted(r["_b"] for r in kept.select(bucket(key, buckets).alias("_b")).distinct().collect())
        _write(kept, path, version, key, buckets)
        _commit(spark, path, version, {b: w for b, w in held.items() if b not in touched} | dict.fromkeys(left, version))
    return len(touched)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes manifests but the newest ``keep``, and files that these don't name; gives the number of folders removed."""
    known = versions(spark, path)
    kept = known[-keep:]
    named = {(w, b) for v in kept for b, w in manifest(spark, path, v).items()}
    removed = 0
    for v in known[:-keep] if keep else []:
        remove(spark, f"{path}/manifest/version={v}")
        removed += 1
    for folder in _folders(spark, f"{path}/data"):
        written = int(folder.removeprefix("version="))
        if kept and written > kept[-1]:  # a version that isn't committed yet
            continue
        inside = [b for b in _folders(spark, f"{path}/data/{folder}") if b.startswith(f"{FOLDER}=")]
        unused = [b for b in inside if (written, int(b.removeprefix(f"{FOLDER}="))) not in named]
        for path_ in [f"{path}/data/{folder}"] if len(unused) == len(inside) else [f"{path}/data/{folder}/{b}" for b in unused]:
            remove(spark, path_)
            removed += 1
    return removed


def project(changes: DataFrame, path: str, checkpoint: str, key: str = "event_id", order: str = "changed_at", gone: str = "deleted", buckets: int = BUCKETS, keep: int = 2, then: Callable[[int, int], None] | None = None):
    """A stream of changes applied batch by batch, over what is available; gives the started query.

    ``then`` gets each batch's number and the number of buckets that it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        wrote = apply(batch.persist(), path, number, key, order, gone, buckets)
        batch.unpersist()
        vacuum(batch.sparkSession, path, keep)
        if then:
            then(number, wrote)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(changes: list[DataFrame], path: str, key: str, order: str, gone: str = "deleted", buckets: int = BUCKETS) -> DataFrame:
    """The table after these batches, numbered from 0."""
    for number, batch in enumerate(changes):
        apply(batch, path, number, key, order, gone, buckets)
    return read(changes[0].sparkSession, path, gone)
