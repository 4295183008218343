"""Reduce sightings to the newest one per departure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastseen.operators.filters import has_identity

# A departure with its time of day, and without it: the time of one service
# drifts between scrapes.
SLOT_KEY = ("relation_name", "departure_date", "service_id", "departure_time")
SERVICE_KEY = ("relation_name", "departure_date", "service_id")
# Order among sightings with equal timestamps.  A view may stop after the last
# column it uses: the sighting chosen agrees on all columns before that point.
TIE_ORDER = (
    "travels_name",
    "bus_type",
    "total_seats",
    "available_seats",
    "is_seater",
    "is_sleeper",
    "is_ac",
)


def latest_by(
    frame: DataFrame,
    keys: Sequence[str],
    ties: Sequence[str],
    newest: str = "scrape_timestamp",
) -> DataFrame:
    """One row per key: the newest, ties broken by ``ties`` ascending.

    Spark keeps one row per key in every map task before it shuffles, so a key
    that holds a large part of the archive costs one row per task.
    """
    order = [F.col(newest).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ties)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def ties_through(*used: str) -> tuple[str, ...]:
    """Tie order up to the last column a view uses; all of it when none is named."""
    last = max(map(TIE_ORDER.index, used), default=len(TIE_ORDER) - 1)
    return TIE_ORDER[: last + 1]


def latest_slots(sightings: DataFrame, *used: str) -> DataFrame:
    """Newest sighting per departure slot.

    Naming the ``used`` columns drops the others before the shuffle.
    """
    ties = ties_through(*used)
    kept = sightings.select("scrape_timestamp", *SLOT_KEY, *ties)
    return latest_by(kept, SLOT_KEY, ties)


def latest_services(
    sightings: DataFrame, *used: str, carried: Sequence[str] = ()
) -> DataFrame:
    """Newest sighting per service and day, of sightings that name both.

    ``carried`` are further columns to keep, which must depend on the key alone.
    """
    ties = ties_through(*used)
    # The time of day decides last, so it is needed only next to all the rest.
    extra = () if used else ("departure_time",)
    kept = sightings.filter(has_identity()).select(
        "scrape_timestamp", *SERVICE_KEY, *ties, *extra, *carried
    )
    return latest_by(kept, SERVICE_KEY, (*ties, *extra))


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """Newest product verdict per service and day."""
    kept = verdicts.filter(has_identity()).select(
        *SERVICE_KEY, "scrape_timestamp", "bus_product_type"
    )
    return latest_by(kept, SERVICE_KEY, ("bus_product_type",)).drop("scrape_timestamp")


def with_verdict(
    latest: DataFrame, verdicts: DataFrame, lacks_identity: bool = False
) -> DataFrame:
    """Add ``bus_product_type`` to deduplicated departures; misses stay null.

    Set ``lacks_identity`` when departures without a route or service id are
    among them.  Those never match, and get join keys of their own so that they
    do not all land in the task of one blank key.
    """
    right = latest_verdicts(verdicts)
    if not lacks_identity:
        return latest.join(right, list(SERVICE_KEY), "left")
    own_key = F.concat(F.lit("no match "), F.xxhash64(*SLOT_KEY).cast("string"))
    left = latest.withColumn(
        "_service", F.when(has_identity(), F.col("service_id")).otherwise(own_key)
    )
    right = right.withColumnRenamed("service_id", "_service")
    joined = left.join(right, ["relation_name", "departure_date", "_service"], "left")
    # Exact even if a service id should equal one of the made-up keys.
    verdict = F.when(has_identity(), F.col("bus_product_type"))
    return joined.withColumn("bus_product_type", verdict).drop("_service")
