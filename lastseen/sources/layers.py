"""An archive published load by load, with layers that views read instead of it.

One load writes the sightings of its days, the newest of them per slot, numbers for
services it is the first to name, and what is known of each day; all of it appears at
once (see ``published``).  Views take :func:`newest_sightings` for :func:`sightings`.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastseen.functions.times import business_date, business_day, business_minute_text
from lastseen.operators.filters import has_identity
from lastseen.operators.newest import newest_of_days, seen_until
from lastseen.session import require_utc
from lastseen.sources import published
from lastseen.sources.archive import (
    RAW_INVENTORY,
    STORED_COLUMNS,
    TYPED_FIELDS,
    UNPARSED,
    rejected,
    typed_with_unparsed,
)
from lastseen.sources.lookups import curve, filtered

SIGHTINGS, NEWEST, SERVICES, REJECTED = "sightings", "newest", "services", "rejected"
TABLES = (SIGHTINGS, NEWEST, SERVICES, REJECTED)
PARTITIONS = ("scrape_date", "departure_month")
#: Groups that number services side by side.
NUMBER_GROUPS = 256

_STORED = T.StructType(
    [
        *(T.StructField(f.name, TYPED_FIELDS.get(f.name, f.dataType)) for f in RAW_INVENTORY),
        *STORED_COLUMNS,
    ]
)
_TEXTS = T.StructField(UNPARSED, T.MapType(T.StringType(), T.StringType()))
_REJECTED = T.StructType([*_STORED, _TEXTS, T.StructField("reason", T.StringType())])
SERVICE_NUMBERS = T.StructType(
    [T.StructField("service_id", T.StringType()), T.StructField("service_no", T.LongType())]
)
_NEWEST = T.StructType([*_STORED, SERVICE_NUMBERS["service_no"]])
DAYS = T.StructType(
    [
        T.StructField("scrape_date", T.DateType()),
        T.StructField("n", T.LongType()),
        T.StructField("first_departure", T.DateType()),
        T.StructField("last_departure", T.DateType()),
    ]
)


def load_feed(
    raw: DataFrame, root: str, replace: bool = False, lookups: int | None = None
) -> published.Manifest:
    """Publish a batch as the feed has it, in one pass over it.

    Text that does not parse becomes null in the sightings, as in every view; the rows it
    stood in are published beside them, with the text and the reason
    (:func:`rejected_sightings`).
    """
    return load_days(typed_with_unparsed(raw), root, replace, lookups)


def load_days(
    typed: DataFrame, root: str, replace: bool = False, lookups: int | None = None
) -> published.Manifest:
    """Publish a batch of typed sightings.

    With ``replace`` the scrape days found in the batch are swapped for it, else they grow
    by it.  The batch is computed once; all else is made from what it wrote.  Whatever
    fails, readers go on seeing what was published before.  ``lookups``, the services to
    expect in a row group, stores the rows for point lookups (see ``lookups``).
    """
    spark = typed.sparkSession
    require_utc(spark)
    began, load = published.manifest(spark, root), published.new_load()
    try:
        rows = _store(_arranged(typed), root, SIGHTINGS, load, lookups)
        stored = _staged(spark, root, load)
        days = _known_of_days(stored)
        if sum(known["n"] for known in days.values()) != rows:
            raise OSError(f"{root}: load {load} does not read back as it was written")
        _store(rejected(stored), root, REJECTED, load)
        stored = stored.drop(UNPARSED)
        numbers = published.read_lasting(spark, root, SERVICES, SERVICE_NUMBERS, began)
        new = published.staged_path(root, SERVICES, load)
        new_numbers(stored, numbers).write.parquet(new)
        numbers = numbers.unionByName(spark.read.schema(SERVICE_NUMBERS).parquet(new))
        newest = with_service_numbers(newest_of_days(stored), numbers)
        _store(newest, root, NEWEST, load, lookups)
        return published.publish(spark, root, load, days, began, (SERVICES,), replace)
    except BaseException:
        published.discard(spark, root, load, TABLES)
        raise


def _arranged(typed: DataFrame) -> DataFrame:
    if UNPARSED not in typed.columns:
        typed = typed.withColumn(UNPARSED, F.lit(None).cast(_TEXTS.dataType))
    return typed.select(*RAW_INVENTORY.names, UNPARSED).withColumns(
        {
            "relation_key": F.lower("relation_name"),
            "scrape_date": business_date(F.col("scrape_timestamp")),
            "departure_month": F.trunc("departure_date", "month"),
        }
    )


def _store(
    rows: DataFrame, root: str, table: str, load: str, lookups: int | None = None
) -> int:
    """Write a table of a load aside; returns the rows handed to the writer."""
    seen = Observation()
    place = [F.col("departure_date")] if lookups is None else [curve()]
    writer = (
        rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        .hint("rebalance", "scrape_date")
        .sortWithinPartitions(*PARTITIONS, *place, "relation_name", "service_id")
        .write.partitionBy(*PARTITIONS)
    )
    if lookups is not None:
        writer = filtered(writer, lookups)
    writer.parquet(published.staged_path(root, table, load))
    try:
        return seen.get["rows"]
    except Py4JJavaError:  # a batch that is empty by its plan is never run
        return 0


def _staged(spark: SparkSession, root: str, load: str) -> DataFrame:
    schema = T.StructType([*_STORED, _TEXTS])
    return spark.read.schema(schema).parquet(published.staged_path(root, SIGHTINGS, load))


def _known_of_days(stored: DataFrame) -> dict[str, dict]:
    """Rows, departures and instants of each scrape day of one load."""
    found = stored.groupBy("scrape_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("departure_date").alias("first_departure"),
        F.max("departure_date").alias("last_departure"),
        F.min("scrape_timestamp").alias("oldest"),
        F.max("scrape_timestamp").alias("newest"),
        F.count(UNPARSED).alias(REJECTED),
    )
    texts = {name: F.col(name).cast("string") for name in ("first_departure", "last_departure")}
    texts |= {name: F.unix_micros(name) for name in ("oldest", "newest")}
    days = {}
    for row in found.withColumns(texts).collect():  # the days of one load
        known = row.asDict()
        day = known.pop("scrape_date")
        days[published.NO_DAY if day is None else day.isoformat()] = known
    return days


def new_numbers(sightings: DataFrame, numbers: DataFrame) -> DataFrame:
    """Numbers for the services that have none yet: ``service_id, service_no``.

    Numbers are dense within :data:`NUMBER_GROUPS` groups by hash, and nearly so overall,
    and go on from those given out before, which never change.
    """
    named = sightings.filter(has_identity()).select("service_id").distinct()
    new = named.join(numbers, "service_id", "left_anti").withColumn(
        "_group", F.pmod(F.hash("service_id"), F.lit(NUMBER_GROUPS))
    )
    used = numbers.groupBy((F.col("service_no") % NUMBER_GROUPS).cast("int").alias("_group")).agg(
        (F.floor(F.max("service_no") / NUMBER_GROUPS) + 1).alias("_used")
    )
    place = F.row_number().over(Window.partitionBy("_group").orderBy("service_id")) - 1
    place += F.coalesce("_used", F.lit(0))
    return new.join(used, "_group", "left").select(
        "service_id", (place * NUMBER_GROUPS + F.col("_group")).cast("long").alias("service_no")
    )


def with_service_numbers(sightings: DataFrame, numbers: DataFrame) -> DataFrame:
    """Add ``service_no``, null for sightings that name no service."""
    joined = sightings.join(numbers, "service_id", "left")
    number = F.when(has_identity(), F.col("service_no")).alias("service_no")
    return joined.select(*sightings.columns, number)


def sightings(
    spark: SparkSession, root: str, since: date | None = None, until: date | None = None
) -> DataFrame:
    """All published sightings, of some scrape days if named."""
    require_utc(spark)
    return published.read_days(spark, root, SIGHTINGS, _STORED, PARTITIONS, since, until)


def rejected_sightings(
    spark: SparkSession, root: str, since: date | None = None, until: date | None = None
) -> DataFrame:
    """Published sightings with text that did not parse: the text by column, the reason."""
    require_utc(spark)
    return published.read_days(
        spark, root, REJECTED, _REJECTED, PARTITIONS, since, until, counted=REJECTED
    )


def newest_sightings(
    spark: SparkSession, root: str, since: date | None = None, until: datetime | None = None
) -> DataFrame:
    """Sightings any view may take instead of all: the newest layer, ``service_no`` added.

    A view whose scrape window ends at an instant (``filters.scrape_end``) needs it as
    ``until``: the day it falls on is then read in full, and only that day.
    """
    require_utc(spark)
    found = published.manifest(spark, root)

    def layer(**days) -> DataFrame:
        return published.read_days(
            spark, root, NEWEST, _NEWEST, PARTITIONS, published=found, **days
        )

    if until is None:
        return layer(since=since)
    last = business_day(until)
    before = layer(since=since, until=last - timedelta(days=1))
    if since is not None and last < since:
        return before
    whole = published.read_days(
        spark, root, SIGHTINGS, _STORED, PARTITIONS, only=[last], published=found
    )
    numbers = published.read_lasting(spark, root, SERVICES, SERVICE_NUMBERS, found)
    cut = with_service_numbers(newest_of_days(seen_until(whole, until)), numbers)
    return before.unionByName(cut.select(*_NEWEST.names))


def _days(found: published.Manifest) -> Iterator[tuple[date, dict]]:
    """What is known of each scrape day, its loads taken together."""
    for day, loads in found.days.items():
        if day == published.NO_DAY:
            continue
        known: dict = {"n": sum(load["n"] for load in loads)}
        for name, pick in (
            ("first_departure", min), ("last_departure", max), ("oldest", min), ("newest", max),
        ):
            values = [load[name] for load in loads if load[name] is not None]
            known[name] = pick(values) if values else None
        yield date.fromisoformat(day), known


def day_sizes(spark: SparkSession, root: str, as_of: datetime, days: int) -> DataFrame:
    """Sightings and departure bounds per scrape day of the last ``days`` times 24 hours.

    Taken from what the loads noted, without a data file.  Only if the window begins
    between two sightings of a day is that one day read.
    """
    require_utc(spark)
    found = published.manifest(spark, root)
    begins = as_of - timedelta(days=days)
    low = (begins - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    rows, split = [], []
    for day, known in _days(found):
        if known["newest"] is None or known["newest"] < low:
            continue
        if known["oldest"] < low:
            split.append(day)
            continue
        bounds = (known["first_departure"], known["last_departure"])
        rows.append((day, known["n"], *(text and date.fromisoformat(text) for text in bounds)))
    whole = spark.createDataFrame(rows, DAYS)
    if not split:
        return whole
    part = published.read_days(
        spark, root, SIGHTINGS, _STORED, PARTITIONS, only=split, published=found
    ).filter(F.col("scrape_timestamp") >= F.lit(begins))
    sizes = part.groupBy("scrape_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("departure_date").alias("first_departure"),
        F.max("departure_date").alias("last_departure"),
    )
    return whole.unionByName(sizes)


def latest_scrape(spark: SparkSession, root: str) -> DataFrame:
    """Newest published scrape as business-time text, empty if there is none; no file is read."""
    require_utc(spark)
    found = [known["newest"] for _, known in _days(published.manifest(spark, root))]
    newest = max((instant for instant in found if instant is not None), default=None)
    rows = spark.createDataFrame([(newest,)], "micros long")
    text = business_minute_text(F.timestamp_micros("micros"))
    return rows.select(F.coalesce(text, F.lit("")).alias("latest"))
