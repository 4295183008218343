"""Past departures: trends, shares, weekday profiles, movers, utilisation.

A departure counts once it was seen by any scrape of the window: services drop
out of later scrapes when they sell out, so a single scrape under-counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastseen.functions.rules import OTHER_OPERATOR, operator_group, operator_of
from lastseen.functions.times import business_day
from lastseen.operators.aggregates import (
    compared_periods,
    period_over_period,
    seat_utilization,
    share_of_total,
    top_with_breakdown,
    weekday_profile,
)
from lastseen.operators.bitmaps import bitmaps_of, distinct_counts, holds_bitmaps
from lastseen.operators.completeness import (
    COMPLETE_DAY_ROWS,
    COMPLETE_DAY_SPAN,
    complete_days,
    on_days,
)
from lastseen.operators.filters import (
    SCRAPE_MARGIN_DAYS,
    FilterSpec,
    departs_between,
    departs_in,
    keep,
    scraped_around,
    scraped_on_days_since,
    scraped_since,
)
from lastseen.operators.latest import latest_services, latest_slots, with_verdict

# Window lengths in days and list lengths of the reports.
HISTORY_DAYS = 45
COMPARED_DAYS = 14
TOP_RELATIONS = 10
TOP_MOVERS = 10


def compared_weeks(as_of: datetime) -> dict[str, tuple[date, date]]:
    """First and last day of the two weeks the week-over-week views compare."""
    return compared_periods(business_day(as_of))


def past_days(as_of: datetime, days: int) -> tuple[date, date]:
    today = business_day(as_of)
    return today - timedelta(days=days), today - timedelta(days=1)


def past_window(
    spec: FilterSpec, as_of: datetime, days: int, explicit_range: bool = True
) -> tuple[date, date]:
    """Departure days of a view: the request's own range, else the last ``days``."""
    return (explicit_range and spec.past_range()) or past_days(as_of, days)


def past_sightings(
    sightings: DataFrame,
    spec: FilterSpec,
    as_of: datetime,
    days: int,
    explicit_range: bool = True,
    margin: int = SCRAPE_MARGIN_DAYS,
) -> DataFrame:
    """Sightings of past departures that pass every filter but the product one.

    Scrapes more than ``margin`` days outside the departure window do not count.
    """
    if explicit_range and spec.past_range():
        rows = scraped_around(sightings, spec.past_range(), margin)
    else:
        rows = scraped_since(sightings, as_of, days + margin)
    return keep(
        rows,
        [
            *departs_in(sightings, past_window(spec, as_of, days, explicit_range)),
            spec.operator_rows(),
            *spec.place_rows(sightings),
            *spec.service_rows(),
        ],
    )


def past_services(
    sightings: DataFrame,
    spec: FilterSpec,
    as_of: datetime,
    days: int = HISTORY_DAYS,
    explicit_range: bool = True,
    verdicts: DataFrame | None = None,
    margin: int = SCRAPE_MARGIN_DAYS,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Newest sighting per service and day, then the product filter.

    The base of trend, share, weekday profile and relation counts: frames for
    equal arguments are equal and can be ``shared``.  None of them reads the
    verdict, so it is joined only on request.  ``carried`` columns are kept;
    they must depend on the service alone, like its number in the newest layer.
    """
    rows = past_sightings(sightings, spec, as_of, days, explicit_range, margin)
    products = spec.product_rows()
    if products is None:
        latest = latest_services(rows, "travels_name", carried=carried)
    else:
        used = ("travels_name", "bus_type", "total_seats")
        latest = latest_services(rows, *used, carried=carried).filter(products)
    if verdicts is not None:
        window = past_window(spec, as_of, days, explicit_range)
        latest = with_verdict(latest, verdicts.filter(departs_between(window)))
    return latest.withColumn("operator", operator_of(F.col("travels_name")))


def service_days(services: DataFrame, number: str = "service_no") -> DataFrame:
    """Bitmaps of the services per departure day, route and operator.

    ``services`` is :func:`past_services` with ``number`` carried.  Trend, share, weekday
    profile, route counts and week over week by operator take the result in its place, and
    :func:`services_between` counts any window of its days.
    """
    known = services.filter(F.col("operator") != OTHER_OPERATOR)
    return bitmaps_of(known, number, "departure_date", "relation_name", "operator")


def services_between(days: DataFrame, first: date, last: date, *groups: str) -> DataFrame:
    """Distinct services of a window of :func:`service_days`, by operator or other groups."""
    inside = days.filter(departs_between((first, last)))
    return distinct_counts(inside, *(groups or ("operator",)), name="services")


def services_in_windows(
    days: DataFrame, windows: Mapping[str, tuple[date, date]], *groups: str
) -> DataFrame:
    """:func:`services_between` for several windows by name, in one pass over the days.

    A day's bitmaps go to each window it lies in.
    """
    holding = F.array_compact(
        F.array(*(F.when(departs_between(span), F.lit(name)) for name, span in windows.items()))
    )
    inside = days.withColumn("window", F.explode(holding))
    by = groups or ("operator",)
    return distinct_counts(inside, *by, "window", name="services").select(*by, "services", "window")


def daily_counts(services: DataFrame) -> DataFrame:
    """Distinct services per day and operator."""
    if holds_bitmaps(services):
        return distinct_counts(services, "departure_date", "operator", name="departure_count")
    return (
        services.filter(F.col("operator") != OTHER_OPERATOR)
        .groupBy("departure_date", "operator")
        .agg(F.countDistinct("service_id").alias("departure_count"))
    )


def trend(services: DataFrame) -> DataFrame:
    return daily_counts(services).orderBy("departure_date", "operator")


def share(services: DataFrame) -> DataFrame:
    """Each operator's part of a day's departures."""
    counts = daily_counts(services).withColumnRenamed("departure_count", "count")
    return share_of_total(counts, "departure_date", "count").orderBy("departure_date", "operator")


def weekdays(services: DataFrame) -> DataFrame:
    """Typical departures per operator on each weekday."""
    profile = weekday_profile(
        daily_counts(services), "operator", "departure_date", "departure_count"
    )
    return profile.orderBy("operator", "dow")


def relation_operator_counts(services: DataFrame) -> DataFrame:
    """Distinct services per route and operator over the whole window."""
    if holds_bitmaps(services):
        return distinct_counts(services, "relation_name", "operator", name="departure_count")
    return (
        services.filter(F.col("operator") != OTHER_OPERATOR)
        .groupBy("relation_name", "operator")
        .agg(F.countDistinct("service_id").alias("departure_count"))
    )


def top_relations(services: DataFrame, k: int = TOP_RELATIONS) -> DataFrame:
    """Busiest routes with their operators."""
    counts = relation_operator_counts(services).withColumnRenamed("relation_name", "relation")
    return top_with_breakdown(counts, "relation", "operator", "departure_count", k)


def compared_services(
    sightings: DataFrame,
    spec: FilterSpec,
    as_of: datetime,
    verdicts: DataFrame | None = None,
    margin: int = SCRAPE_MARGIN_DAYS,
) -> DataFrame:
    """Base of the week-over-week views, which ignore explicit ranges."""
    return past_services(sightings, spec, as_of, COMPARED_DAYS, False, verdicts, margin)


def week_counts(services: DataFrame, as_of: datetime) -> DataFrame:
    """Departures per operator in each compared week, next to its first and last day."""
    weeks = compared_weeks(as_of)
    day = F.col("departure_date")
    label = F
    for name, (first, last) in weeks.items():
        label = label.when(day.between(F.lit(first), F.lit(last)), F.lit(name))
    bounds = {
        "first_day": {name: first for name, (first, _) in weeks.items()},
        "last_day": {name: last for name, (_, last) in weeks.items()},
    }
    named = daily_counts(services).withColumn("period", label).filter("period IS NOT NULL")
    for column, of_period in bounds.items():
        value = F
        for name, bound in of_period.items():
            value = value.when(F.col("period") == name, F.lit(bound))
        named = named.withColumn(column, value)
    return (
        named.groupBy("period", "first_day", "last_day", "operator")
        .agg(F.sum("departure_count").alias("departures"))
        .orderBy("first_day", "operator")
    )


def week_over_week(services: DataFrame, as_of: datetime) -> DataFrame:
    """Departures per operator, last seven days against the seven before."""
    return period_over_period(
        daily_counts(services),
        "operator",
        "departure_date",
        "departure_count",
        compared_weeks(as_of),
    ).orderBy("operator")


def week_over_week_by_relation(services: DataFrame, as_of: datetime) -> DataFrame:
    """The same per route, whoever operates it.

    The base has one row per route, day and service, so rows are services.
    """
    daily = services.groupBy(F.col("relation_name").alias("relation"), "departure_date").agg(
        F.count(F.lit(1)).alias("n")
    )
    return period_over_period(daily, "relation", "departure_date", "n", compared_weeks(as_of))


def gainers(changes: DataFrame, k: int = TOP_MOVERS) -> DataFrame:
    """Routes with the highest signed change; routes new this week have none."""
    ranked = changes.filter(F.col("pct_delta").isNotNull())
    return ranked.orderBy(F.col("pct_delta").desc(), F.col("relation").asc()).limit(k)


def losers(changes: DataFrame, k: int = TOP_MOVERS) -> DataFrame:
    ranked = changes.filter(F.col("pct_delta").isNotNull())
    return ranked.orderBy(F.col("pct_delta").asc(), F.col("relation").asc()).limit(k)


def movers(changes: DataFrame, k: int = TOP_MOVERS) -> DataFrame:
    """Gainers and losers in one frame, told apart by ``direction``.

    Both ends of the ranking come from the same shuffled sums, which Spark
    computes once.
    """
    up = gainers(changes, k).withColumn("direction", F.lit("gainer"))
    return up.unionByName(losers(changes, k).withColumn("direction", F.lit("loser")))


def utilization(
    sightings: DataFrame,
    spec: FilterSpec,
    as_of: datetime,
    days: int = HISTORY_DAYS,
    margin: int = SCRAPE_MARGIN_DAYS,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Daily seat-weighted utilisation, the line operator against the rest.

    Only sightings with usable seat counts compete for newest.  ``verdicts`` are joined
    on request like in :func:`past_services`; the sums do not read them.
    """
    rows = past_sightings(sightings, spec, as_of, days, margin=margin).filter(
        (F.col("total_seats") > 0) & F.col("available_seats").isNotNull()
    )
    latest = latest_services(rows, "travels_name", "total_seats", "available_seats")
    products = spec.product_rows()
    if products is not None:
        latest = latest.filter(products)
    if verdicts is not None:
        window = past_window(spec, as_of, days)
        latest = with_verdict(latest, verdicts.filter(departs_between(window)))
    grouped = latest.withColumn("operator_group", operator_group(F.col("travels_name")))
    return seat_utilization(
        grouped, ("departure_date", "operator_group"), "total_seats", "available_seats"
    ).orderBy("departure_date", "operator_group")


def history(
    sightings: DataFrame,
    spec: FilterSpec,
    as_of: datetime,
    view: str = "wow",
    verdicts: DataFrame | None = None,
    days: int = HISTORY_DAYS,
    k: int | None = None,
    margin: int = SCRAPE_MARGIN_DAYS,
) -> dict[str, DataFrame]:
    """Results of one view by name; an unknown name means week over week.

    ``k`` is the length of the top lists.  Week-over-week views also return the
    counts of both weeks with their bounds.
    """
    if view == "mom":
        raise ValueError("there is no month-over-month view")
    if view == "util":
        return {"points": utilization(sightings, spec, as_of, days, margin, verdicts)}
    if view in ("trend_45", "share", "dow", "top_relations"):
        services = past_services(
            sightings, spec, as_of, days, verdicts=verdicts, margin=margin
        )
        if view == "top_relations":
            return {"rows": top_relations(services, k or TOP_RELATIONS)}
        return {"points": {"trend_45": trend, "share": share, "dow": weekdays}[view](services)}
    compared = compared_services(sightings, spec, as_of, verdicts, margin)
    weeks = week_counts(compared, as_of)
    if view == "wow_relation":
        changes = week_over_week_by_relation(compared, as_of)
        k = k or TOP_MOVERS
        return {"gainers": gainers(changes, k), "losers": losers(changes, k), "weeks": weeks}
    return {"delta": week_over_week(compared, as_of), "weeks": weeks}


def trend_on_complete_days(
    sightings: DataFrame,
    spec: FilterSpec,
    as_of: datetime,
    min_rows: int = COMPLETE_DAY_ROWS,
    min_span: int = COMPLETE_DAY_SPAN,
    days: int = HISTORY_DAYS,
    margin: int = SCRAPE_MARGIN_DAYS,
) -> DataFrame:
    """Older trend rules: only complete scrape days count, the product filter
    acts before the newest sighting is taken, and slots are counted."""
    window = days + margin
    complete = complete_days(scraped_since(sightings, as_of, window), min_rows, min_span)
    rows = on_days(scraped_on_days_since(sightings, as_of, window), complete)
    products = spec.product_rows()
    rows = keep(
        rows,
        [
            # The day is part of the departure's key, so it can be checked first.
            *departs_in(sightings, past_days(as_of, days)),
            *spec.hub_rows(),
            *spec.place_rows(sightings),
            *spec.service_rows(),
            *([] if products is None else [products]),
        ],
    )
    return (
        latest_slots(rows, "travels_name")
        .withColumn("operator", operator_of(F.col("travels_name"), default=None))
        .filter(F.col("operator").isNotNull())
        .groupBy("departure_date", "operator")
        .agg(F.count(F.lit(1)).alias("departure_count"))
        .orderBy("departure_date", "operator")
    )
