"""Request filters and the column predicates they stand for."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from functools import reduce
from operator import and_
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastseen.functions.rules import OPERATORS, PRODUCTS, has_product, operated_by
from lastseen.functions.times import BUSINESS_ZONE, business_day, departure_hour
from lastseen.sources.dimensions import line_id_of_code, routes_of_region

# Named ranges of days before departure.
DAY_RANGES = {"d0-d4": (0, 4), "d5-d30": (5, 30), "d0-d30": (0, 30)}
DEFAULT_DAY_RANGE = "d0-d30"
FORWARD_SCRAPE_DAYS = 2
SCRAPE_MARGIN_DAYS = 15

# Columns a stored archive adds to the feed's.
MONTH_COLUMN, ROUTE_COLUMN = "departure_month", "relation_key"

_ISO_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def _known(text: str | None, choices: tuple[str, ...]) -> tuple[str, ...]:
    picked = [item.strip() for item in (text or "").split(",")]
    return tuple(item for item in picked if item in choices)


# Hours as requests write them, with or without a leading zero.
_HOURS = {form.format(hour): hour for hour in range(24) for form in ("{}", "{:02}")}


def _hour(text: str | None) -> int | None:
    return _HOURS.get(str(text).strip())


def _day(text: str | None) -> date | None:
    text = (text or "").strip()
    return date.fromisoformat(text) if _ISO_DAY.fullmatch(text) else None


@dataclass(frozen=True)
class FilterSpec:
    """What a view is restricted to.  Defaults restrict nothing.

    ``operators`` and ``products`` left empty mean all of them; ``relation``
    takes precedence over ``region``.
    """

    operators: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    relation: str | None = None
    region: str | None = None
    line_code: str | None = None
    origin_hub: str | None = None
    hour_from: int | None = None
    hour_to: int | None = None
    day_range: str = DEFAULT_DAY_RANGE
    dep_from: date | None = None
    dep_to: date | None = None

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> FilterSpec:
        """Read request parameters; unknown or malformed values are ignored."""
        dep_from, dep_to = _day(params.get("dep_from")), _day(params.get("dep_to"))
        if dep_from is None or dep_to is None:
            dep_from = dep_to = None
        return cls(
            operators=_known(params.get("operators"), OPERATORS),
            products=_known(params.get("product_type"), PRODUCTS),
            relation=params.get("relation") or params.get("corridor") or None,
            region=params.get("region") or None,
            line_code=params.get("line_code") or None,
            origin_hub=params.get("origin_hub") or None,
            hour_from=_hour(params.get("hr_from")),
            hour_to=_hour(params.get("hr_to")),
            day_range=params.get("pbd_range", DEFAULT_DAY_RANGE),
            dep_from=dep_from,
            dep_to=dep_to,
        )

    def operator_rows(self) -> Column:
        """Chosen operators; rows of no known operator never pass."""
        known = [label for label in self.operators if label in OPERATORS]
        return operated_by(F.col("travels_name"), known or OPERATORS)

    def product_rows(self) -> Column | None:
        """Chosen product types; None when every bus passes."""
        wanted = {product for product in self.products if product in PRODUCTS}
        if not wanted or wanted == set(PRODUCTS):
            return None
        return has_product(F.col("total_seats"), F.col("bus_type"), wanted)

    def place_rows(self, frame: DataFrame | None = None) -> list[Column]:
        """One relation, or the relations of a region if it is known.

        A stored archive has the lower-case name as a column, so the region's
        routes reach the row groups.
        """
        if self.relation:
            return [F.col("relation_name") == self.relation]
        routes = routes_of_region(self.region)
        stored = frame is not None and ROUTE_COLUMN in frame.columns
        name = F.col(ROUTE_COLUMN) if stored else F.lower("relation_name")
        return [name.isin(routes)] if routes else []

    def hub_rows(self) -> list[Column]:
        """Relations that start with a city."""
        if not self.origin_hub:
            return []
        return [F.startswith(F.lower("relation_name"), F.lower(F.lit(self.origin_hub)))]

    def line_rows(self) -> list[Column]:
        """A line by its code, any other text as a service id."""
        if not self.line_code:
            return []
        text = self.line_code.strip()
        line = line_id_of_code(text)
        if line:
            # Line ids have one length, so a prefix test is enough, and parquet can skip by it.
            return [F.col("service_id").startswith(line)]
        return [F.col("service_id") == text]

    def service_rows(self) -> list[Column]:
        return [F.col("service_id") == self.line_code] if self.line_code else []

    def hour_rows(self) -> list[Column]:
        """Departure hour range; applied only when both ends are given."""
        if self.hour_from is None or self.hour_to is None:
            return []
        return [departure_hour(F.col("departure_time")).between(self.hour_from, self.hour_to)]

    def forward_days(self, as_of: datetime) -> tuple[date, date]:
        if self.dep_from and self.dep_to:
            return self.dep_from, self.dep_to
        low, high = DAY_RANGES.get(self.day_range, DAY_RANGES[DEFAULT_DAY_RANGE])
        today = business_day(as_of)
        return today + timedelta(days=low), today + timedelta(days=high)

    def in_force(self, as_of: datetime) -> dict[str, object]:
        """The filters as they act, defaults filled in, to show next to a result."""
        return self._echo(*self.forward_days(as_of))

    def in_force_past(self, as_of: datetime, days: int) -> dict[str, object]:
        """The same for past views: the explicit range, else the last ``days``."""
        today = business_day(as_of)
        last_days = (today - timedelta(days=days), today - timedelta(days=1))
        return self._echo(*(self.past_range() or last_days))

    def _echo(self, first: date, last: date) -> dict[str, object]:
        return {
            "operators": list(self.operators or OPERATORS),
            "products": list(self.products or PRODUCTS),
            "relation": self.relation,
            "region": None if self.relation else self.region,
            "line_code": self.line_code,
            "origin_hub": self.origin_hub,
            "hours": None if not self.hour_rows() else [self.hour_from, self.hour_to],
            "dep_from": first.isoformat(),
            "dep_to": last.isoformat(),
        }

    def past_range(self) -> tuple[date, date] | None:
        """Explicit departure range for past views; None if absent or reversed."""
        if self.dep_from and self.dep_to and self.dep_from <= self.dep_to:
            return self.dep_from, self.dep_to
        return None


def has_identity() -> Column:
    """The sighting names both a route and a service."""
    return F.col("relation_name").isNotNull() & (F.col("service_id") != "")


def departs_between(days: tuple[date, date]) -> Column:
    return F.col("departure_date").between(F.lit(days[0]), F.lit(days[1]))


def departs_in(frame: DataFrame, days: tuple[date, date]) -> list[Column]:
    """Departure window, stated on the stored month too so that folders are pruned."""
    bounds = [departs_between(days)]
    if MONTH_COLUMN in frame.columns:
        first, last = (day.replace(day=1) for day in days)
        bounds.append(F.col(MONTH_COLUMN).between(F.lit(first), F.lit(last)))
    return bounds


def scraped_since(frame: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Sightings of the last ``days`` times 24 hours."""
    return _scraped(frame, as_of - timedelta(days=days), None)


def scraped_on_days_since(frame: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Like :func:`scraped_since`, with the first scrape day taken whole."""
    day = business_day(as_of - timedelta(days=days))
    return _scraped(frame, datetime.combine(day, time(), ZoneInfo(BUSINESS_ZONE)), None)


def scraped_around(
    frame: DataFrame, days: tuple[date, date], margin: int = SCRAPE_MARGIN_DAYS
) -> DataFrame:
    """Sightings from ``margin`` days before the range to ``margin`` after it."""
    first, last = (datetime.combine(day, time(), timezone.utc) for day in days)
    return _scraped(frame, first - timedelta(days=margin), last + timedelta(days=margin))


def scrape_end(
    spec: FilterSpec, margin: int = SCRAPE_MARGIN_DAYS
) -> datetime | None:
    """Instant the scrape window of past views ends at; None if it has no end."""
    days = spec.past_range()
    if days is None:
        return None
    return datetime.combine(days[1], time(), timezone.utc) + timedelta(days=margin)


def _scraped(frame: DataFrame, low: datetime, high: datetime | None) -> DataFrame:
    # The day bounds follow from the instants; stating them prunes partitions.
    bounds = [F.col("scrape_timestamp") >= F.lit(low)]
    if high is not None:
        bounds.append(F.col("scrape_timestamp") <= F.lit(high))
    if "scrape_date" in frame.columns:
        bounds.append(F.col("scrape_date") >= F.lit(business_day(low)))
        if high is not None:
            bounds.append(F.col("scrape_date") <= F.lit(business_day(high)))
    return keep(frame, bounds)


def keep(frame: DataFrame, predicates: list[Column]) -> DataFrame:
    """Rows on which every predicate holds."""
    return frame.filter(reduce(and_, predicates)) if predicates else frame
