"""Date and time column helpers."""

from __future__ import annotations

from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Business time zone, date text of the feed, hour bands, weekdays.
BUSINESS_ZONE = "Asia/Kolkata"
FEED_DATE_FORMAT = "d-MMM-yyyy"
HOUR_BANDS = ("00:00-05:59", "06:00-11:59", "12:00-17:59", "18:00-23:59")
HOURS_PER_BAND = 6
UNKNOWN_BAND = "unknown"
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def business_day(instant: datetime) -> date:
    """Calendar day of an instant in the business time zone."""
    if instant.tzinfo is None:
        raise ValueError("as_of needs a time zone")
    return instant.astimezone(ZoneInfo(BUSINESS_ZONE)).date()


def business_date(instant: Column) -> Column:
    """Column form of :func:`business_day`; the session time zone must be UTC."""
    return F.to_date(F.from_utc_timestamp(instant, BUSINESS_ZONE))


def business_minute_text(instant: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(instant, BUSINESS_ZONE), "yyyy-MM-dd HH:mm")


def feed_date(text: Column) -> Column:
    """Date from the feed's day-month-year text; null when malformed."""
    return F.try_to_date(text, FEED_DATE_FORMAT)


def departure_hour(text: Column) -> Column:
    """Number in the two characters before the first colon, else null."""
    colon = F.instr(text, ":")
    digits = F.substr(text, colon - 2, F.lit(2))
    return F.when(colon >= 3, digits.try_cast("bigint"))


def leading_hour(text: Column) -> Column:
    """Number in the first two characters, else null."""
    return F.substring(text, 1, 2).try_cast("bigint")


def band(value: Column, width: int, labels: tuple[str, ...], default: str) -> Column:
    """Label of the equally wide range holding ``value``, counted from 0."""
    inside = value.between(0, width * len(labels) - 1)
    position = F.floor(value / F.lit(width)).cast("int") + 1
    return F.when(inside, F.element_at(F.array(*map(F.lit, labels)), position)).otherwise(
        F.lit(default)
    )


def hour_band(hour: Column) -> Column:
    return band(hour, HOURS_PER_BAND, HOUR_BANDS, UNKNOWN_BAND)


def weekday_label(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), index + 1)
