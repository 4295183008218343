"""Upcoming departures: detail rows, seats and load, counts by day and line."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastseen.functions.numbers import (
    exact_mean,
    occupied_share,
    round_to_tenth,
    zero_to_null,
)
from lastseen.functions.rules import OTHER_OPERATOR, is_volvo, operator_of, product_of
from lastseen.functions.times import (
    business_day,
    departure_hour,
    hour_band,
    leading_hour,
)
from lastseen.operators.filters import (
    FORWARD_SCRAPE_DAYS,
    FilterSpec,
    departs_between,
    departs_in,
    keep,
    scraped_since,
)
from lastseen.operators.latest import latest_slots, with_verdict
from lastseen.sources.dimensions import with_line_number

# Label of blank services, columns of a detail row.
NO_SERVICE = "(no-service)"
DETAIL_COLUMNS = (
    "departure_date",
    "departure_time",
    "operator",
    "relation_name",
    "service_id",
    "line_number",
    "bus_type",
    "product",
    "is_ac",
    "is_volvo",
    "total_seats",
    "avail_seats",
    "load_pct",
)


# Columns each result reads besides the key, to prune a base made for it alone.
COUNT_COLUMNS = ("travels_name",)
SEAT_COLUMNS = ("travels_name", "total_seats", "available_seats")
PRODUCT_COLUMNS = ("bus_type", "total_seats")


def latest_departures(
    sightings: DataFrame,
    spec: FilterSpec,
    as_of: datetime,
    verdicts: DataFrame | None = None,
    used: tuple[str, ...] = (),
    scrape_days: int = FORWARD_SCRAPE_DAYS,
) -> DataFrame:
    """Newest sighting of each upcoming departure slot, with operator and band.

    All filters but the product filter act on sightings; the product filter
    judges the newest one.  ``used`` limits the columns carried along;
    departures last seen more than ``scrape_days`` ago are left out.
    """
    recent = keep(
        scraped_since(sightings, as_of, scrape_days),
        [
            *departs_in(sightings, spec.forward_days(as_of)),
            spec.operator_rows(),
            *spec.place_rows(sightings),
            *spec.line_rows(),
            *spec.hour_rows(),
        ],
    )
    products = spec.product_rows()
    if used and products is not None:
        used = (*used, *PRODUCT_COLUMNS)
    latest = latest_slots(recent, *used)
    if products is not None:
        latest = latest.filter(products)
    if verdicts is not None:
        window = verdicts.filter(departs_between(spec.forward_days(as_of)))
        latest = with_verdict(latest, window, lacks_identity=True)
    return latest.withColumns(
        {
            "operator": operator_of(F.col("travels_name")),
            "hour_band": hour_band(departure_hour(F.col("departure_time"))),
        }
    )


def _known(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("operator") != OTHER_OPERATOR)


def detail(latest: DataFrame) -> DataFrame:
    """One display row per departure."""
    total, available = zero_to_null(F.col("total_seats")), F.col("available_seats")
    rows = _known(latest).withColumns(
        {
            "product": product_of(total, F.col("bus_type")),
            "is_volvo": is_volvo(F.col("bus_type")),
            "total_seats": total,
            "avail_seats": available,
            "load_pct": round_to_tenth(occupied_share(available, total) * 100),
        }
    )
    return with_line_number(rows).select(*DETAIL_COLUMNS)


def detail_capped(latest: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` display rows in a fixed order, for a consumer with a limit."""
    first = [F.col(name).asc_nulls_first() for name in DETAIL_COLUMNS]
    return detail(latest).orderBy(*first).limit(cap)


#: Columns that tell any two display rows apart, in the order of pages.
PAGE_KEY = DETAIL_COLUMNS[:5]


def detail_page(latest: DataFrame, size: int, after: Mapping[str, object] | None = None) -> DataFrame:
    """The ``size`` display rows that follow a row, in the order of :func:`detail_capped`.

    ``after`` holds the :data:`PAGE_KEY` of the last row of the page before.  Rows up to it
    are dropped before anything is sorted, and its departure date reaches the scan.  Pages
    of a base that does not change join to exactly :func:`detail`.
    """
    rows = detail(latest)
    if after is not None:
        rows = rows.filter(_follows(after))
    return rows.orderBy(*(F.col(name).asc_nulls_first() for name in PAGE_KEY)).limit(size)


def _follows(key: Mapping[str, object]) -> Column:
    """Rows after ``key`` in ascending order, nulls first."""
    later, same = F.lit(False), F.lit(True)
    for name in PAGE_KEY:
        value = F.lit(key[name])
        above = F.col(name).isNotNull() if key[name] is None else F.col(name) > value
        later = later | (same & F.coalesce(above, F.lit(False)))
        same = same & F.col(name).eqNullSafe(value)
    first = PAGE_KEY[0]
    if key[first] is None:
        return later
    # Implied by the rest; on its own it is pushed down.
    return (F.col(first) >= F.lit(key[first])) & later


def row_count(latest: DataFrame) -> DataFrame:
    return latest.agg(F.count(F.lit(1)).alias("row_count_raw"))


def by_operator_hourband(latest: DataFrame) -> DataFrame:
    """Departures, seats and mean load of the single buses."""
    total = zero_to_null(F.col("total_seats"))
    load = exact_mean(occupied_share(F.col("available_seats"), total))
    return (
        _known(latest)
        .groupBy("operator", "hour_band")
        .agg(
            F.count(F.lit(1)).alias("departure_count"),
            F.coalesce(F.sum("total_seats"), F.lit(0)).alias("seats_offered"),
            round_to_tenth(load * 100).alias("avg_load_pct"),
        )
        .orderBy("operator", "hour_band")
    )


def by_day(latest: DataFrame) -> DataFrame:
    return (
        _known(latest)
        .groupBy(F.col("departure_date").alias("date"), "operator")
        .agg(F.count(F.lit(1)).alias("departure_count"))
        .orderBy("date", "operator")
    )


LINE = ("service_id", "corridor", "operator")


def by_line_times(latest: DataFrame) -> DataFrame:
    """Departures per service, route, operator and time of day, in long form.

    One row per distinct time, null for a blank one: nothing is gathered, however
    many departures share a service id.
    """
    service = F.when(F.col("service_id") != "", F.col("service_id")).otherwise(F.lit(NO_SERVICE))
    time = F.nullif(F.col("departure_time"), F.lit(""))
    return (
        _known(latest)
        .select(
            service.alias("service_id"),
            F.col("relation_name").alias("corridor"),
            "operator",
            time.alias("departure_time"),
        )
        .groupBy(*LINE, "departure_time")
        .agg(F.count(F.lit(1)).alias("departure_count"))
    )


def by_line(latest: DataFrame) -> DataFrame:
    """The same as one row per line with its times in an array.

    The array holds every distinct time text of a line.  For services with an id
    that is a handful; for feeds with free text under a blank id use
    :func:`by_line_times`.
    """
    return _lines(by_line_times(latest))


def _lines(times: DataFrame) -> DataFrame:
    return (
        times.groupBy(*LINE)
        .agg(
            F.sum("departure_count").alias("departure_count"),
            F.array_sort(F.collect_list("departure_time")).alias("departure_times"),
        )
        .orderBy(*LINE)
    )


#: Views of one pass, by the columns they group by.
ONE_PASS = {
    "row_count": (),
    "by_operator_hourband": ("operator", "hour_band"),
    "by_day": ("date", "operator"),
    "by_line": (*LINE, "departure_time"),
}


def in_one_pass(latest: DataFrame) -> DataFrame:
    """The counting results of the forward view together, told apart by ``view``.

    One aggregation over grouping sets: the base is read and deduplicated once, whoever
    takes which result.  Columns a view does not group by are null, and so are seats in all
    but the view by band.  The row count is of all departures, the others of known
    operators.  :func:`one_pass_results` splits it.
    """
    total = zero_to_null(F.col("total_seats"))
    service = F.when(F.col("service_id") != "", F.col("service_id")).otherwise(F.lit(NO_SERVICE))
    known = F.col("operator") != OTHER_OPERATOR
    rows = latest.select(
        known.alias("known"),
        "operator",
        "hour_band",
        F.col("departure_date").alias("date"),
        service.alias("service_id"),
        F.col("relation_name").alias("corridor"),
        F.nullif(F.col("departure_time"), F.lit("")).alias("departure_time"),
        "total_seats",
        occupied_share(F.col("available_seats"), total).alias("load"),
    )
    columns = ("operator", "hour_band", "date", "service_id", "corridor", "departure_time")
    sets = [["known", *names] for names in ONE_PASS.values()]
    counted = rows.groupingSets(sets, "known", *columns).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("departure_count"),
        F.coalesce(F.sum("total_seats"), F.lit(0)).alias("seats_offered"),
        round_to_tenth(exact_mean(F.col("load")) * 100).alias("avg_load_pct"),
    )
    view = F
    for name, names in ONE_PASS.items():
        # A bit per column, set if the view does not group by it; the first is ``known``.
        bits = "0" + "".join("0" if column in names else "1" for column in columns)
        view = view.when(F.col("_set") == int(bits, 2), F.lit(name))
    named = counted.withColumn("view", view).filter(F.col("known") | (F.col("view") == "row_count"))
    seated = F.col("view") == "by_operator_hourband"
    seats = {name: F.when(seated, F.col(name)) for name in ("seats_offered", "avg_load_pct")}
    return named.withColumns(seats).drop("known", "_set")


def one_pass_results(views: DataFrame) -> dict[str, DataFrame]:
    """The results of :func:`in_one_pass` by name; to take several, wrap it in ``shared``."""
    of = {name: views.filter(F.col("view") == name) for name in ONE_PASS}
    seats = ("departure_count", "seats_offered", "avg_load_pct")
    return {
        "row_count": of["row_count"].agg(
            F.coalesce(F.sum("departure_count"), F.lit(0)).alias("row_count_raw")
        ),
        "by_operator_hourband": of["by_operator_hourband"]
        .select("operator", "hour_band", *seats)
        .orderBy("operator", "hour_band"),
        "by_day": of["by_day"].select("date", "operator", "departure_count").orderBy("date", "operator"),
        "by_line": _lines(of["by_line"].select(*LINE, "departure_time", "departure_count")),
    }


def departures(
    sightings: DataFrame,
    spec: FilterSpec,
    as_of: datetime,
    verdicts: DataFrame | None = None,
    scrape_days: int = FORWARD_SCRAPE_DAYS,
) -> dict[str, DataFrame]:
    """All forward results.  To compute several, wrap the base in ``shared``."""
    latest = latest_departures(sightings, spec, as_of, verdicts, scrape_days=scrape_days)
    return departure_results(latest)


def departure_results(latest: DataFrame) -> dict[str, DataFrame]:
    return {
        "rows": detail(latest),
        "row_count": row_count(latest),
        "by_operator_hourband": by_operator_hourband(latest),
        "by_day": by_day(latest),
        "by_line": by_line(latest),
    }


def days_before_departure(sightings: DataFrame, as_of: datetime) -> DataFrame:
    """Add ``pbd``: days from the business day of ``as_of`` to the departure."""
    today = F.lit(business_day(as_of))
    return sightings.withColumn("pbd", F.date_diff(F.col("departure_date"), today))


def latest_departures_template(
    sightings: DataFrame, spec: FilterSpec, as_of: datetime
) -> DataFrame:
    """Older forward rules: every scrape counts, the product filter acts before
    the newest sighting is taken, the hour is the first two characters, and
    rows of no known operator are dropped last."""
    products = spec.product_rows()
    rows = keep(
        sightings,
        [
            *departs_in(sightings, spec.forward_days(as_of)),
            *spec.hub_rows(),
            *spec.place_rows(sightings),
            *spec.service_rows(),
            *([] if products is None else [products]),
        ],
    )
    latest = latest_slots(rows, *SEAT_COLUMNS)
    return latest.withColumns(
        {
            "operator": operator_of(F.col("travels_name"), default=None),
            "hour_band": hour_band(leading_hour(F.col("departure_time"))),
        }
    ).filter(F.col("operator").isNotNull())


def hourband_template(latest: DataFrame) -> DataFrame:
    """Older seats-and-load roll-up, rounding halves away from zero."""
    total = F.col("total_seats").cast("double")
    taken = (F.col("total_seats") - F.col("available_seats")).cast("double")
    return (
        latest.groupBy("operator", "hour_band")
        .agg(
            F.count(F.lit(1)).alias("departure_count"),
            F.sum("total_seats").alias("seats_offered"),
            F.round(exact_mean(F.try_divide(taken, total)) * 100, 1).alias("avg_load_pct"),
        )
        .orderBy("operator", "hour_band")
    )
