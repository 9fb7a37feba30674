"""Shared storage for rounds of iterative operators."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def made_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; removed by ``clear`` or at the end.

    Where that isn't set, a folder below the warehouse on one machine; a cluster has to name one that all its machines reach.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} reach")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    atexit.register(_remove, spark, path)
    return path


def shared_dir(spark: SparkSession, label: str) -> str:
    return made_dir(spark, f"rounds-{label}")


def clear(spark: SparkSession) -> None:
    """Removes all folders made so far: for long sessions, between queries whose results have been read or written."""
    while _made:
        remove(spark, _made.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; one that isn't there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended
        pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """Rows written to shared storage and read again, so that lineage is cut and survives executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
