"""Session settings the library relies on, and frame sharing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# The Java VM compiles no method above this many bytes of code.  Spark runs the loop it made
# of a stage interpreted then, which is several times slower than doing without that loop.
LARGEST_METHOD = {"spark.sql.codegen.hugeMethodLimit": "8000"}

SETTINGS = {
    **LARGEST_METHOD,
    # Business dates are derived by shifting UTC wall-clock time.
    "spark.sql.session.timeZone": "UTC",
    # Coalesce small shuffle partitions, split skewed ones, re-plan joins.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Views are assembled from many small expressions; recording the call site
    # of each takes longer than building them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The default timestamp encoding keeps no statistics to skip row groups by.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def build_session(app: str = "lastseen", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")


@contextmanager
def shared(frame: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame while several results are derived from it.

    Blocks that do not fit in memory spill to disk, and blocks lost with an
    executor are recomputed from the archive.
    """
    kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
