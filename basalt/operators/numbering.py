"""Numbering a whole table in an order without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def numbered(rows: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Adds 1-based numbers in the given order. Equal rows in the order get numbers in any order among them.

    Rows are dealt to parts by ranges of the order, numbered in their part, and moved on by the sizes of the parts before:
    only these sizes, one row a part, meet in one task.
    """
    parts = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_inside", inside).join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")
