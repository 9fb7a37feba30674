"""What the training-data operators share: tables, shared storage and text constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import made_dir

#: The six ASCII white-space characters that part words.
SPACE = r"[\x20\x09-\x0D]"
#: Arrow batches that Python workers get. All operators set the same bounds, as they are the session's; what wants smaller
#: pieces cuts them itself.
ARROW_BATCH_ROWS = 2000
ARROW_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order, as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors reach; removed when the driver ends.

    Only where the setting is absent (one machine, as in tests) a folder below the warehouse is used.
    """
    return made_dir(spark, f"basalt-{label}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes rows to shared storage and reads them again: cuts lineage in a way that outlives executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, in rows and bytes, and sees to it that workers have the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def file_system(path: str):
    """The file system of a URI or path, and the path in it; for executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
