"""Literal sightings for the semantic traps."""

from contextlib import contextmanager
from datetime import date, datetime, timezone

from lastseen.sources.archive import RAW_INVENTORY, RAW_VERDICTS, typed_inventory, typed_verdicts

AS_OF = datetime(2026, 6, 1, 12, 0, tzinfo=timezone.utc)
TODAY = date(2026, 6, 1)

DEFAULTS = {
    "scrape_timestamp": datetime(2026, 6, 1, 6, 0, tzinfo=timezone.utc),
    "relation_name": "delhi to jaipur",
    "departure_date": "03-Jun-2026",
    "departure_time": "10:00:00",
    "service_id": "s1",
    "travels_name": "FlixBus",
    "bus_type": "A/C Seater (2+2)",
    "is_seater": True,
    "is_sleeper": False,
    "is_ac": True,
    "available_seats": "10",
    "total_seats": "40",
}


def at(day: int, hour: int = 6, month: int = 6) -> datetime:
    return datetime(2026, month, day, hour, tzinfo=timezone.utc)


def sighting(**changes) -> tuple:
    unknown = set(changes) - set(DEFAULTS)
    assert not unknown, unknown
    row = {**DEFAULTS, **changes}
    return tuple(row[name] for name in RAW_INVENTORY.names)


def archive(spark, *rows):
    return typed_inventory(spark.createDataFrame(list(rows), RAW_INVENTORY))


def verdict_archive(spark, *rows):
    return typed_verdicts(spark.createDataFrame(list(rows), RAW_VERDICTS))


def tuples(frame, *columns):
    rows = frame.select(*columns).collect() if columns else frame.collect()
    return sorted((tuple(row) for row in rows), key=repr)


@contextmanager
def setting(spark, key, value):
    """Hold a session setting at a value."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)
