"""The newest sightings of a day, as a layer that views read instead of all sightings."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastseen.operators.latest import SLOT_KEY, TIE_ORDER, latest_by
from lastseen.sources.archive import scrape_day

# What filters of views look at besides a slot.  Sightings that differ in one of these
# compete for newest only once the filters have acted, so each stays in the layer.
FILTERED = ("travels_name", "bus_type", "total_seats")
_COUNTED = "_seats_counted"


def newest_of_days(sightings: DataFrame) -> DataFrame:
    """Newest sighting per scrape day, slot and filtered attributes.

    Every view that takes sightings may take these instead.  Its filters depend on the
    slot, on :data:`FILTERED` and on whether free seats are known, so they keep or drop a
    whole group here; the sighting a view picks is first of its group, because the order
    among sightings is total and the same.  That also holds for a window that begins
    within a day.  One that ends within a day needs ``until`` (see :func:`seen_until`).
    The layer holds one row for each slot and day, however often a day scrapes a slot.
    """
    tagged = sightings.withColumns(
        {"scrape_date": scrape_day(sightings), _COUNTED: F.col("available_seats").isNotNull()}
    )
    keys = ("scrape_date", *SLOT_KEY, *FILTERED, _COUNTED)
    ties = [name for name in TIE_ORDER if name not in FILTERED]
    return latest_by(tagged, keys, ties).drop(_COUNTED)


def seen_until(sightings: DataFrame, until: datetime | None) -> DataFrame:
    """Sightings not later than an instant; all of them without one."""
    if until is None:
        return sightings
    return sightings.filter(F.col("scrape_timestamp") <= F.lit(until))


def merged(*layers: DataFrame) -> DataFrame:
    """Layers of several loads as one.

    Merging is associative and commutative, and a layer merged with itself is itself: loads
    may arrive in any order and in any number of parts.
    """
    return newest_of_days(reduce(DataFrame.unionByName, layers))
