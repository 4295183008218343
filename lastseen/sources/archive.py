"""The scrape archive: raw feed schema, typed form, partitioned storage.

The feed carries dates and seat counts as text.  Typing them once at ingest
lets departure-date filters reach the parquet row groups.  Partitions by scrape
day and by departure month let scrape and departure windows prune folders; the
route name is stored in lower case too, so region filters are pushed down.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastseen.functions.times import business_date, feed_date
from lastseen.session import require_utc

RAW_INVENTORY = T.StructType(
    [
        T.StructField("scrape_timestamp", T.TimestampType()),
        T.StructField("relation_name", T.StringType()),
        T.StructField("departure_date", T.StringType()),
        T.StructField("departure_time", T.StringType()),
        T.StructField("service_id", T.StringType()),
        T.StructField("travels_name", T.StringType()),
        T.StructField("bus_type", T.StringType()),
        T.StructField("is_seater", T.BooleanType()),
        T.StructField("is_sleeper", T.BooleanType()),
        T.StructField("is_ac", T.BooleanType()),
        T.StructField("available_seats", T.StringType()),
        T.StructField("total_seats", T.StringType()),
    ]
)
RAW_VERDICTS = T.StructType(
    [
        T.StructField("scrape_timestamp", T.TimestampType()),
        T.StructField("relation_name", T.StringType()),
        T.StructField("departure_date", T.StringType()),
        T.StructField("service_id", T.StringType()),
        T.StructField("bus_product_type", T.StringType()),
    ]
)
TYPED_FIELDS = {
    "departure_date": T.DateType(),
    "available_seats": T.LongType(),
    "total_seats": T.LongType(),
}


STORED_COLUMNS = T.StructType(
    [
        T.StructField("relation_key", T.StringType()),
        T.StructField("scrape_date", T.DateType()),
        T.StructField("departure_month", T.DateType()),
    ]
)
LOADS = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("first_day", T.DateType()),
        T.StructField("last_day", T.DateType()),
    ]
)


def _typed_schema(raw: T.StructType, added: T.StructType | None = None) -> T.StructType:
    fields = [T.StructField(f.name, TYPED_FIELDS.get(f.name, f.dataType)) for f in raw]
    return T.StructType([*fields, *(added or ())])


def typed_inventory(raw: DataFrame) -> DataFrame:
    """Parse dates and seat counts; text that does not parse becomes null."""
    return raw.withColumns(
        {
            "departure_date": feed_date(F.col("departure_date")),
            "available_seats": F.col("available_seats").try_cast("bigint"),
            "total_seats": F.col("total_seats").try_cast("bigint"),
        }
    )


#: Text of a typed row that did not parse, by column; null if all did.
UNPARSED = "unparsed"


def typed_with_unparsed(raw: DataFrame) -> DataFrame:
    """:func:`typed_inventory` with the text that became null kept in a map."""
    before = raw.withColumns({f"_{name}": F.col(name) for name in TYPED_FIELDS})
    typed = typed_inventory(before)
    lost = {
        name: F.col(f"_{name}").isNotNull() & F.col(name).isNull() for name in TYPED_FIELDS
    }
    texts = [
        F.when(failed, F.struct(F.lit(name).alias("key"), F.col(f"_{name}").alias("value")))
        for name, failed in lost.items()
    ]
    kept = F.map_from_entries(F.array_compact(F.array(*texts)))
    marked = typed.withColumn(UNPARSED, F.when(reduce(or_, lost.values()), kept))
    return marked.drop(*(f"_{name}" for name in TYPED_FIELDS))


def rejected(typed: DataFrame) -> DataFrame:
    """Rows of :func:`typed_with_unparsed` whose text did not parse, each with the reason."""
    reason = F.concat_ws(", ", F.array_sort(F.map_keys(UNPARSED)))
    return typed.filter(F.col(UNPARSED).isNotNull()).withColumn("reason", reason)


def json_rows(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A result as lines of JSON: dates in ISO form, nulls visible, columns in order."""
    row = F.struct(*(columns or frame.columns))
    return frame.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))


def typed_verdicts(raw: DataFrame) -> DataFrame:
    return raw.withColumn("departure_date", feed_date(F.col("departure_date")))


def unparsed_counts(raw: DataFrame) -> DataFrame:
    """How many sightings carry text that typing turns into null, in one pass."""
    typed = typed_inventory(raw.withColumns({f"_{name}": F.col(name) for name in TYPED_FIELDS}))
    lost = {
        name: F.count_if(F.col(f"_{name}").isNotNull() & F.col(name).isNull())
        for name in TYPED_FIELDS
    }
    return typed.agg(
        F.count(F.lit(1)).alias("sightings"), *(count.alias(name) for name, count in lost.items())
    )


def scrape_day(frame: DataFrame) -> Column:
    """Scrape day column: the stored partition if there is one, else derived."""
    if "scrape_date" in frame.columns:
        return F.col("scrape_date")
    require_utc(frame.sparkSession)
    return business_date(F.col("scrape_timestamp"))


def _replacing(writer: DataFrameWriter, mode: str, replace: bool) -> DataFrameWriter:
    """Overwrite the partitions found in the batch and no others, or append."""
    if replace:
        return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return writer.mode(mode)


def _swap_days(spark: SparkSession, staged: str, path: str) -> None:
    """Put the scrape days of a staged load in the place of theirs, months included."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source = hadoop.Path(staged)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(source):
        day = status.getPath().getName()
        if not day.startswith("scrape_date="):
            continue
        target, aside = hadoop.Path(f"{path}/{day}"), hadoop.Path(f"{staged}/_before-{day}")
        if files.exists(target) and not files.rename(target, aside):
            raise OSError(f"{target} cannot be moved")
        if not files.rename(status.getPath(), target):
            raise OSError(f"{status.getPath()} cannot be moved")
    files.delete(source, True)


def _loads(path: str) -> str:
    # A name that readers of the archive pass over.
    return f"{path.rstrip('/')}/_loads"


def write_inventory(
    typed: DataFrame, path: str, mode: str = "append", replace_days: bool = False
) -> None:
    """Store typed sightings by scrape day, ordered for date and route filters.

    Rebalancing splits a day that dwarfs the others into several tasks and
    merges small ones, so file sizes stay even.  ``replace_days`` rewrites the
    scrape days found in the batch and no others, so a failed load of whole
    days can simply be repeated.  It is written aside first and then moved into
    place day by day: a write that fails leaves the old days as they are.  For
    loads that appear in one step see ``layers.load_days``.  Every load leaves a
    row in a small table next to the data.
    """
    spark = typed.sparkSession
    require_utc(spark)
    seen = Observation()
    stored = typed.select(*RAW_INVENTORY.names).withColumns(
        {
            "relation_key": F.lower("relation_name"),
            "scrape_date": business_date(F.col("scrape_timestamp")),
            "departure_month": F.trunc("departure_date", "month"),
        }
    )
    counted = stored.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.min("scrape_date").alias("first_day"),
        F.max("scrape_date").alias("last_day"),
    )
    writer = (
        counted.hint("rebalance", "scrape_date")
        .sortWithinPartitions("scrape_date", "departure_date", "relation_name", "service_id")
        .write.partitionBy("scrape_date", "departure_month")
    )
    if replace_days:
        # A name that readers of the archive pass over.
        staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
        writer.parquet(staged)
        _swap_days(spark, staged, path.rstrip("/"))
    else:
        writer.mode(mode).parquet(path)
    load = seen.get
    row = (load["rows"], load["first_day"], load["last_day"])
    spark.createDataFrame([row], LOADS).coalesce(1).write.mode("append").parquet(_loads(path))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    require_utc(spark)
    return spark.read.schema(_typed_schema(RAW_INVENTORY, STORED_COLUMNS)).parquet(path)


def newest_scrape_day(spark: SparkSession, path: str) -> date | None:
    """Last scrape day any load brought, from the loads alone: no data is opened."""
    loads = spark.read.schema(LOADS).parquet(_loads(path))
    return loads.agg(F.max("last_day")).first()[0]


def write_verdicts(
    typed: DataFrame, path: str, mode: str = "append", replace_days: bool = False
) -> None:
    """Store product verdicts by departure day, the only window they are read by.

    ``replace_days`` rewrites the departure days found in the batch and no
    others, so a failed load can be repeated.
    """
    require_utc(typed.sparkSession)
    writer = (
        typed.hint("rebalance", "departure_date")
        .sortWithinPartitions("departure_date", "relation_name", "service_id")
        .write.partitionBy("departure_date")
    )
    _replacing(writer, mode, replace_days).parquet(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    require_utc(spark)
    return spark.read.schema(_typed_schema(RAW_VERDICTS)).parquet(path)


def write_results(
    frames: dict[str, DataFrame],
    root: str,
    partition_by: dict[str, str] | None = None,
    mode: str = "overwrite",
    file_format: str = "parquet",
) -> None:
    """Store named result sets, one folder per name.

    ``partition_by`` names a partition column for results large enough to
    deserve one, such as detail rows by departure date.  As ``json``, dates
    become ISO text and nulls stay visible.
    """
    for name, frame in frames.items():
        writer = frame.write.mode(mode).format(file_format)
        if file_format == "json":
            writer = writer.option("ignoreNullFields", "false")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.save(f"{root.rstrip('/')}/{name}")
