"""Session settings that the operators assume."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "basalt", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above. ``settings`` take precedence; dots in their names are written as ``__``."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Puts the settings that can change at run time into a session made elsewhere."""
    for key in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(key, SETTINGS[key])
    return spark


#: Bytes of a batch of rows that Python gets, at most; Spark's default counts rows only, of any length, or allows far more.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Limits batches for Python to ``BATCH_BYTES``, so that a worker's memory doesn't grow with the texts or partitions of a table.

    A smaller limit of the session stays.
    """
    now = spark.conf.get(_BATCH)
    if not 0 < int(now.rstrip("b") if now.rstrip("b").isdigit() else 0) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's executors, once, so that Python workers can import it wherever they run."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="basalt-")) / "basalt.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, Path(top.name) / f.relative_to(top))
    spark.sparkContext.addPyFile(str(archive))
