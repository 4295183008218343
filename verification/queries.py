"""One query per operator, over the whole fixture archive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lastseen.functions.rules import (
    is_volvo,
    operator_of,
    product_of,
    product_of_flags,
)
from lastseen.functions.times import departure_hour as hour_of
from lastseen.functions.times import hour_band
from lastseen.operators.completeness import complete_days, on_days
from lastseen.functions.times import business_day
from lastseen.operators.filters import FilterSpec, scraped_since
from lastseen.operators.latest import (
    latest_services,
    latest_slots,
    latest_verdicts,
    with_verdict,
)
from lastseen.operators.newest import newest_of_days
from lastseen.plans import departures as fwd
from lastseen.plans import history as past
from lastseen.plans import quality
from lastseen.sources.archive import json_rows, rejected, typed_with_unparsed, unparsed_counts
from lastseen.sources.archive import typed_inventory as typed
from lastseen.sources.dimensions import with_line_number, with_region
from lastseen.sources.layers import SERVICE_NUMBERS, new_numbers, with_service_numbers
from lastseen.sources.published import empty
from verification.fixtures import AS_OF, inventory, raw_inventory, verdicts

Query = Callable[[SparkSession, str], DataFrame]

EVERYTHING = FilterSpec()
EXPLICIT_RANGE = FilterSpec(dep_from=date(2026, 5, 4), dep_to=date(2026, 5, 24))
FORWARD_RANGE = FilterSpec(dep_from=date(2026, 5, 30), dep_to=date(2026, 6, 9))
# The fixture archive is smaller than a real one, and so are its thresholds.  The
# partial-day limit lies inside the range of day sizes at the check's scale; at
# larger scales nearly every day exceeds it.
FULL_DAY_ROWS = 500
FULL_DAY_SPAN = 29
PARTIAL_ROWS = 800
# Short enough that the lists leave routes and departures out.
TOP, REPORT_ROWS = 3, 1000

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _ranked(frame: DataFrame, *within: str) -> DataFrame:
    """Number the rows of a sorted report, so that its order is compared too."""
    placed = frame.withColumn("_at", F.monotonically_increasing_id())
    order = Window.partitionBy(*within).orderBy("_at")
    return placed.withColumn("rank", F.row_number().over(order)).drop("_at")


def _count(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


# ---- typing, scalars and lookups over every sighting ----------------------


@query
def typed_inventory(spark, sf_dir):
    rows = typed(raw_inventory(spark, sf_dir))
    return rows.groupBy("departure_date", "total_seats", "available_seats").agg(
        F.count(F.lit(1)).alias("n"), F.sum("available_seats").alias("free")
    )


@query
def unparsed_text(spark, sf_dir):
    return unparsed_counts(raw_inventory(spark, sf_dir))


@query
def rejected_rows(spark, sf_dir):
    return _count(rejected(typed_with_unparsed(raw_inventory(spark, sf_dir))), "reason")


@query
def route_regions(spark, sf_dir):
    return _count(with_region(inventory(spark, sf_dir)), "relation_name", "region")


@query
def line_code_lookup(spark, sf_dir):
    rows = inventory(spark, sf_dir).withColumn("operator", operator_of(F.col("travels_name")))
    return _count(with_line_number(rows), "operator", "service_id", "line_number")


@query
def departure_hour(spark, sf_dir):
    hour = hour_of(F.col("departure_time"))
    rows = inventory(spark, sf_dir).withColumn("departure_hour", hour)
    return _count(rows, "departure_time", "departure_hour")


@query
def hour_band_counts(spark, sf_dir):
    band = hour_band(hour_of(F.col("departure_time")))
    return _count(inventory(spark, sf_dir).withColumn("hour_band", band), "hour_band")


@query
def operator_classify(spark, sf_dir):
    rows = inventory(spark, sf_dir).withColumn("operator", operator_of(F.col("travels_name")))
    return _count(rows, "travels_name", "operator")


@query
def product_classify(spark, sf_dir):
    rows = inventory(spark, sf_dir).withColumns(
        {
            "product": product_of(F.col("total_seats"), F.col("bus_type")),
            "is_volvo": is_volvo(F.col("bus_type")),
        }
    )
    return _count(rows, "bus_type", "total_seats", "product", "is_volvo")


@query
def product_classify_flags(spark, sf_dir):
    product = product_of_flags(F.col("is_seater"), F.col("is_sleeper"))
    rows = inventory(spark, sf_dir).withColumn("product", product)
    return _count(rows, "is_seater", "is_sleeper", "product")


@query
def days_before_departure(spark, sf_dir):
    return _count(fwd.days_before_departure(inventory(spark, sf_dir), AS_OF), "pbd")


# ---- newest sighting ------------------------------------------------------


def _stamped(frame: DataFrame) -> DataFrame:
    stamp = F.date_format("scrape_timestamp", "yyyy-MM-dd HH:mm:ss")
    return frame.withColumn("scrape_timestamp", stamp)


@query
def latest_sighting_4key(spark, sf_dir):
    return _stamped(latest_slots(inventory(spark, sf_dir)))


@query
def latest_sighting_3key(spark, sf_dir):
    return _stamped(latest_services(inventory(spark, sf_dir)))


@query
def latest_enriched(spark, sf_dir):
    return latest_verdicts(verdicts(spark, sf_dir))


@query
def latest_with_enriched(spark, sf_dir):
    services = latest_services(inventory(spark, sf_dir), "travels_name")
    joined = with_verdict(services, verdicts(spark, sf_dir))
    return joined.select(
        "relation_name", "departure_date", "service_id", "travels_name", "bus_product_type"
    )


# ---- upcoming departures --------------------------------------------------


def _forward(spark, sf_dir, spec=EVERYTHING, used=()):
    return fwd.latest_departures(inventory(spark, sf_dir), spec, AS_OF, used=used)


def _counted(spark, sf_dir, spec=EVERYTHING):
    return _forward(spark, sf_dir, spec, fwd.COUNT_COLUMNS)


def _seated(spark, sf_dir, spec=EVERYTHING):
    return _forward(spark, sf_dir, spec, fwd.SEAT_COLUMNS)


@query
def departures_detail(spark, sf_dir):
    return fwd.detail(_forward(spark, sf_dir))


@query
def departures_detail_capped(spark, sf_dir):
    return _ranked(fwd.detail_capped(_forward(spark, sf_dir), REPORT_ROWS))


@query
def departures_row_count(spark, sf_dir):
    return fwd.row_count(_counted(spark, sf_dir))


@query
def departures_with_enriched(spark, sf_dir):
    latest = fwd.latest_departures(
        inventory(spark, sf_dir),
        EVERYTHING,
        AS_OF,
        verdicts(spark, sf_dir),
        used=fwd.COUNT_COLUMNS,
    )
    return _count(latest, "operator", "hour_band", "bus_product_type")


@query
def by_operator_hourband(spark, sf_dir):
    return fwd.by_operator_hourband(_seated(spark, sf_dir))


@query
def departures_by_day(spark, sf_dir):
    return fwd.by_day(_counted(spark, sf_dir))


@query
def departures_by_day_d0_d4(spark, sf_dir):
    return fwd.by_day(_counted(spark, sf_dir, FilterSpec(day_range="d0-d4")))


@query
def departures_by_day_d5_d30(spark, sf_dir):
    return fwd.by_day(_counted(spark, sf_dir, FilterSpec(day_range="d5-d30")))


@query
def by_line(spark, sf_dir):
    lines = fwd.by_line(_counted(spark, sf_dir))
    return lines.withColumn("departure_times", F.array_join("departure_times", "|"))


@query
def by_line_times(spark, sf_dir):
    return fwd.by_line_times(_counted(spark, sf_dir))


@query
def filter_operator(spark, sf_dir):
    spec = FilterSpec(operators=("zingbus", "laxmi"))
    return fwd.by_day(_counted(spark, sf_dir, spec))


@query
def filter_relation(spark, sf_dir):
    spec = FilterSpec(relation="Mumbai to Goa")
    return fwd.by_day(_counted(spark, sf_dir, spec))


@query
def filter_region(spark, sf_dir):
    spec = FilterSpec(region="IN01")
    return fwd.by_operator_hourband(_seated(spark, sf_dir, spec))


@query
def filter_line_code(spark, sf_dir):
    spec = FilterSpec(line_code="in0421b")
    return fwd.detail(_forward(spark, sf_dir, spec))


@query
def filter_hour_range(spark, sf_dir):
    spec = FilterSpec(hour_from=6, hour_to=15)
    return fwd.by_operator_hourband(_seated(spark, sf_dir, spec))


@query
def filter_dep_range(spark, sf_dir):
    return fwd.by_day(_counted(spark, sf_dir, FORWARD_RANGE))


@query
def filter_product_forward(spark, sf_dir):
    spec = FilterSpec(products=("Seater", "Volvo"))
    return fwd.by_operator_hourband(_seated(spark, sf_dir, spec))


def _forward_template(spark, sf_dir, spec=EVERYTHING):
    return fwd.latest_departures_template(inventory(spark, sf_dir), spec, AS_OF)


@query
def hourband_template(spark, sf_dir):
    return fwd.hourband_template(_forward_template(spark, sf_dir))


@query
def filter_origin_hub(spark, sf_dir):
    spec = FilterSpec(origin_hub="Delhi")
    return fwd.hourband_template(_forward_template(spark, sf_dir, spec))


@query
def product_before_dedup(spark, sf_dir):
    spec = FilterSpec(products=("Sleeper", "Hybrid"))
    return fwd.hourband_template(_forward_template(spark, sf_dir, spec))


# ---- past departures ------------------------------------------------------


def _past(spark, sf_dir, spec=EVERYTHING):
    return past.past_services(inventory(spark, sf_dir), spec, AS_OF)


def _compared(spark, sf_dir, spec=EVERYTHING):
    return past.compared_services(inventory(spark, sf_dir), spec, AS_OF)


@query
def trend_daily(spark, sf_dir):
    return _ranked(past.trend(_past(spark, sf_dir)))


@query
def trend_by_product(spark, sf_dir):
    return past.trend(_past(spark, sf_dir, FilterSpec(products=("Sleeper",))))


@query
def history_range_trend(spark, sf_dir):
    return past.trend(_past(spark, sf_dir, EXPLICIT_RANGE))


@query
def filter_service(spark, sf_dir):
    return past.trend(_past(spark, sf_dir, FilterSpec(line_code="svc-12")))


@query
def past_with_enriched(spark, sf_dir):
    services = past.past_services(
        inventory(spark, sf_dir), EVERYTHING, AS_OF, verdicts=verdicts(spark, sf_dir)
    )
    return _count(services, "operator", "bus_product_type")


@query
def trend_by_region(spark, sf_dir):
    return past.trend(_past(spark, sf_dir, FilterSpec(region="IN11")))


@query
def share(spark, sf_dir):
    return past.share(_past(spark, sf_dir))


@query
def dow_profile(spark, sf_dir):
    return past.weekdays(_past(spark, sf_dir))


@query
def relation_operator_counts(spark, sf_dir):
    return past.relation_operator_counts(_past(spark, sf_dir))


@query
def top_relations(spark, sf_dir):
    return past.top_relations(_past(spark, sf_dir), TOP)


@query
def top_relations_by_product(spark, sf_dir):
    spec = FilterSpec(products=("Seater", "Hybrid"))
    return past.top_relations(_past(spark, sf_dir, spec), TOP)


@query
def wow(spark, sf_dir):
    return past.week_over_week(_compared(spark, sf_dir), AS_OF)


@query
def wow_by_operator(spark, sf_dir):
    spec = FilterSpec(operators=("intrcity", "nuego"))
    return past.week_over_week(_compared(spark, sf_dir, spec), AS_OF)


@query
def wow_relation(spark, sf_dir):
    return past.week_over_week_by_relation(_compared(spark, sf_dir), AS_OF)


def _changes(spark, sf_dir):
    return past.week_over_week_by_relation(_compared(spark, sf_dir), AS_OF)


@query
def wow_gainers(spark, sf_dir):
    return _ranked(past.gainers(_changes(spark, sf_dir), TOP))


@query
def wow_losers(spark, sf_dir):
    return _ranked(past.losers(_changes(spark, sf_dir), TOP))


@query
def wow_movers(spark, sf_dir):
    return _ranked(past.movers(_changes(spark, sf_dir), TOP), "direction")


@query
def wow_weeks(spark, sf_dir):
    return past.week_counts(_compared(spark, sf_dir), AS_OF)


@query
def utilization(spark, sf_dir):
    return past.utilization(inventory(spark, sf_dir), EVERYTHING, AS_OF)


@query
def utilization_by_product(spark, sf_dir):
    spec = FilterSpec(products=("Volvo",))
    return past.utilization(inventory(spark, sf_dir), spec, AS_OF)


def _clean_trend(spark, sf_dir, spec=EVERYTHING):
    rows = inventory(spark, sf_dir)
    return past.trend_on_complete_days(rows, spec, AS_OF, FULL_DAY_ROWS, FULL_DAY_SPAN)


@query
def trend_clean_days(spark, sf_dir):
    return _clean_trend(spark, sf_dir)


@query
def trend_clean_days_by_product(spark, sf_dir):
    return _clean_trend(spark, sf_dir, FilterSpec(products=("Hybrid",), origin_hub="Delhi"))


# ---- archive quality ------------------------------------------------------


def _complete(rows: DataFrame) -> DataFrame:
    window = past.HISTORY_DAYS + past.SCRAPE_MARGIN_DAYS
    return complete_days(scraped_since(rows, AS_OF, window), FULL_DAY_ROWS, FULL_DAY_SPAN)


@query
def clean_days(spark, sf_dir):
    return _complete(inventory(spark, sf_dir))


@query
def clean_day_rows(spark, sf_dir):
    rows = inventory(spark, sf_dir)
    return _count(on_days(rows, _complete(rows)), "scrape_date", "travels_name")


@query
def freshness_latest(spark, sf_dir):
    return quality.latest_scrape(inventory(spark, sf_dir))


@query
def daily_scrape_counts(spark, sf_dir):
    return _ranked(quality.daily_scrape_counts(inventory(spark, sf_dir), AS_OF))


@query
def partial_days(spark, sf_dir):
    daily = quality.daily_scrape_counts(inventory(spark, sf_dir), AS_OF)
    return quality.partial_days(daily, PARTIAL_ROWS)


@query
def clean_day_count(spark, sf_dir):
    daily = quality.daily_scrape_counts(inventory(spark, sf_dir), AS_OF)
    return quality.clean_day_count(daily, PARTIAL_ROWS)


@query
def relations(spark, sf_dir):
    return _ranked(quality.relations(inventory(spark, sf_dir), AS_OF))


@query
def relation_count(spark, sf_dir):
    return quality.relation_count(inventory(spark, sf_dir), AS_OF)


@query
def freshness_newest_day(spark, sf_dir):
    return quality.latest_scrape(inventory(spark, sf_dir), business_day(AS_OF))


# ---- views over the newest layer ------------------------------------------


def _layer(spark, sf_dir):
    return newest_of_days(inventory(spark, sf_dir))


@query
def layer_latest_4key(spark, sf_dir):
    return _stamped(latest_slots(_layer(spark, sf_dir)))


@query
def layer_latest_3key(spark, sf_dir):
    return _stamped(latest_services(_layer(spark, sf_dir)))


@query
def layer_departures_detail(spark, sf_dir):
    return fwd.detail(fwd.latest_departures(_layer(spark, sf_dir), EVERYTHING, AS_OF))


@query
def layer_product_before_dedup(spark, sf_dir):
    spec = FilterSpec(products=("Sleeper", "Hybrid"))
    latest = fwd.latest_departures_template(_layer(spark, sf_dir), spec, AS_OF)
    return fwd.hourband_template(latest)


@query
def layer_wow_by_operator(spark, sf_dir):
    spec = FilterSpec(operators=("intrcity", "nuego"))
    services = past.compared_services(_layer(spark, sf_dir), spec, AS_OF)
    return past.week_over_week(services, AS_OF)


@query
def layer_utilization(spark, sf_dir):
    return past.utilization(_layer(spark, sf_dir), EVERYTHING, AS_OF)


# ---- distinct services from bitmaps ---------------------------------------


def _service_days(spark, sf_dir, spec=EVERYTHING):
    rows = inventory(spark, sf_dir)
    numbers = new_numbers(rows, empty(spark, SERVICE_NUMBERS))
    layer = with_service_numbers(newest_of_days(rows), numbers)
    services = past.past_services(layer, spec, AS_OF, carried=("service_no",))
    return past.service_days(services)


@query
def bitmap_trend_daily(spark, sf_dir):
    return _ranked(past.trend(_service_days(spark, sf_dir)))


@query
def bitmap_trend_by_region(spark, sf_dir):
    return past.trend(_service_days(spark, sf_dir, FilterSpec(region="IN11")))


@query
def bitmap_relation_operator_counts(spark, sf_dir):
    return past.relation_operator_counts(_service_days(spark, sf_dir))


@query
def bitmap_top_relations(spark, sf_dir):
    return past.top_relations(_service_days(spark, sf_dir), TOP)


@query
def bitmap_dow_profile(spark, sf_dir):
    return past.weekdays(_service_days(spark, sf_dir))


@query
def services_of_windows(spark, sf_dir):
    """Distinct services per operator over windows of a week, a month and a fixed range."""
    days = _service_days(spark, sf_dir)
    windows = {
        "week": past.past_days(AS_OF, 7),
        "month": past.past_days(AS_OF, 30),
        "range": (date(2026, 5, 4), date(2026, 5, 24)),
    }
    return past.services_in_windows(days, windows)


# ---- whole views ----------------------------------------------------------


@query
def departures_in_one_pass(spark, sf_dir):
    return fwd.in_one_pass(_forward(spark, sf_dir))


@query
def departures_page(spark, sf_dir):
    after = {
        "departure_date": date(2026, 6, 10),
        "departure_time": None,
        "operator": "freshbus",
        "relation_name": "delhi to manali",
        "service_id": "svc-16",
    }
    return _ranked(fwd.detail_page(_forward(spark, sf_dir), 500, after))


def _as_lines(results: dict[str, DataFrame]) -> DataFrame:
    """Results of a view as JSON lines, columns by name, each with the result's name."""
    lines = [
        json_rows(frame, sorted(frame.columns)).withColumn("result", F.lit(name))
        for name, frame in results.items()
    ]
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    return every


@query
def departures_view(spark, sf_dir):
    return _as_lines(fwd.departures(inventory(spark, sf_dir), EVERYTHING, AS_OF))


@query
def history_views(spark, sf_dir):
    rows, slots = inventory(spark, sf_dir), verdicts(spark, sf_dir)
    results = {}
    for view in ("trend_45", "share", "dow", "top_relations", "wow", "wow_relation", "util"):
        frames = past.history(rows, EVERYTHING, AS_OF, view, slots, k=TOP)
        results |= {f"{view} {name}": frame for name, frame in frames.items()}
    return _as_lines(results)


@query
def freshness_view(spark, sf_dir):
    return _as_lines(quality.freshness(inventory(spark, sf_dir), AS_OF, PARTIAL_ROWS))
