"""Sightings and verdicts stored side by side by service, joined without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lastseen.operators.filters import has_identity
from lastseen.operators.latest import SERVICE_KEY

#: Buckets of both tables; equal numbers are what lets them be joined in place.
BUCKETS = 512


def write_by_service(
    rows: DataFrame, table: str, path: str, buckets: int = BUCKETS, mode: str = "overwrite"
) -> None:
    """Store sightings or verdicts as a catalog table, bucketed and sorted by service.

    Only rows that name a route and a service are kept: all that looks at services drops
    the others first, and they would share few buckets.  Each file is one bucket, so the
    number of buckets bounds the tasks that read the table; choose it by the size wanted for
    a task.  Views that look at services take the table for the archive.
    """
    (
        rows.filter(has_identity())
        .repartition(buckets, *SERVICE_KEY)
        .write.mode(mode)
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, *SERVICE_KEY)
        .sortBy(*SERVICE_KEY)
        .saveAsTable(table)
    )


def read_by_service(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
