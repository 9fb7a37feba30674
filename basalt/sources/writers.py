"""Sinks: overwrite, replace-by-partition, append, index tables, reports. Every one goes through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 2000


def overwrite_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the partitions that the rows have and leaves all others: incremental rebuild by group."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append(rows: DataFrame, path: str, cut: tuple[str, ...] = ()) -> None:
    """Appends rows; the ``cut`` columns are cut to their longest length."""
    for c in cut:
        rows = rows.withColumn(c, F.left(c, F.lit(LONGEST)))
    rows.write.mode("append").parquet(path)


def create_table(spark: SparkSession, name: str, schema: str, rebuild: bool = False) -> None:
    """Creates a table if it isn't there; ``rebuild`` drops it first."""
    if rebuild:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def index(chunks: DataFrame, path: str, existing: DataFrame | None = None, key: str = "id", kind: str = "chunk_type") -> DataFrame:
    """Writes chunks that aren't there yet, by kind; gives the number of each kind written."""
    fresh = chunks.join(existing.select(key), key, "left_anti") if existing is not None else chunks
    fresh.write.mode("append").partitionBy(kind).parquet(path)
    return fresh.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def csv_with_mark(rows: DataFrame, path: str) -> bool:
    """CSV in UTF-8 with a byte-order mark on its first column's name; nothing is written for no rows."""
    if rows.isEmpty():
        return False
    first = rows.columns[0]
    rows.withColumnRenamed(first, f"﻿{first}").write.mode("overwrite").option("header", True).csv(path)
    return True


def report(rows: DataFrame, path: str, title: str, line: str, order: str) -> None:
    """A text report: a title, a count and one line a row, in order. The rows are one day's or one run's."""
    body = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"])
    text = rows.agg(F.concat_ws("\n", F.lit(f"# {title}"), F.concat(F.lit("rows: "), F.count(F.lit(1)).cast("string")), F.array_join(body, "\n")).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)
