"""Semantics of the views on literal sightings."""

import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from lastseen import FilterSpec
from lastseen.operators.latest import latest_services, latest_slots, with_verdict
from lastseen.plans import departures as fwd
from lastseen.plans import history as past
from lastseen.plans import quality
from lastseen.session import shared
from tests.conftest import SF_DIRS
from tests.rows import AS_OF, TODAY, archive, at, setting, sighting, tuples, verdict_archive
from tests.test_archive import plan
from verification import fixtures
from verification.queries import QUERIES

EVERYTHING = FilterSpec()


def past_sighting(day: int, month: int = 5, **changes):
    """A departure in the past, seen the evening before."""
    changes.setdefault("scrape_timestamp", datetime(2026, month, day, 0, 30, tzinfo=timezone.utc))
    return sighting(departure_date=f"{day}-{'May' if month == 5 else 'Jun'}-2026", **changes)


# ---- newest sighting ----


def test_newest_sighting_wins_and_ties_have_a_fixed_order(spark):
    frame = archive(
        spark,
        sighting(scrape_timestamp=at(1, 6), available_seats="9"),
        sighting(scrape_timestamp=at(1, 7), travels_name="Zingbus", available_seats="1"),
        sighting(scrape_timestamp=at(1, 7), travels_name="FlixBus", total_seats=None),
        sighting(scrape_timestamp=at(1, 7), travels_name="FlixBus", total_seats="40"),
        sighting(scrape_timestamp=at(1, 7), travels_name=None),
    )
    expected = [("FlixBus", 40, 10)]
    columns = ("travels_name", "total_seats", "available_seats")
    assert tuples(latest_slots(frame), *columns) == expected
    assert tuples(latest_services(frame), *columns) == expected
    assert tuples(latest_services(frame, *columns), *columns) == expected


def test_drifting_time_splits_slots_but_not_services(spark):
    frame = archive(
        spark,
        sighting(scrape_timestamp=at(1, 6), departure_time="10:00"),
        sighting(scrape_timestamp=at(1, 7), departure_time="10:05"),
    )
    assert latest_slots(frame).count() == 2
    assert tuples(latest_services(frame), "departure_time") == [("10:05",)]


def test_one_date_spelled_two_ways_is_one_departure(spark):
    frame = archive(
        spark, sighting(departure_date="3-Jun-2026"), sighting(departure_date="03-JUN-2026")
    )
    assert latest_slots(frame).count() == 1


def test_blank_services_collapse_per_slot_and_leave_services(spark):
    frame = archive(
        spark,
        sighting(service_id=None),
        sighting(service_id=None),
        sighting(service_id=""),
        sighting(service_id=None, relation_name=None),
        sighting(service_id="s1", relation_name=None),
    )
    assert latest_slots(frame).count() == 4
    assert latest_services(frame).count() == 0


@pytest.fixture(scope="module")
def verdicts(spark):
    return verdict_archive(
        spark,
        (at(1, 6), "delhi to jaipur", "03-Jun-2026", "s1", "seater"),
        (at(1, 7), "delhi to jaipur", "3-Jun-2026", "s1", "hybrid"),
        (at(1, 9), "delhi to jaipur", "03-Jun-2026", "", "sleeper"),
        (at(1, 9), None, "03-Jun-2026", "s1", "sleeper"),
    )


def test_verdict_join_keeps_unmatched_departures(spark, verdicts):
    frame = archive(
        spark,
        sighting(departure_time="10:00"),
        sighting(departure_time="11:00"),
        sighting(service_id="", departure_time="12:00"),
        sighting(service_id=None, departure_time=None),
        sighting(relation_name=None),
        sighting(service_id="s2"),
    )
    joined = with_verdict(latest_slots(frame), verdicts, lacks_identity=True)
    assert joined.count() == 6
    found = tuples(joined.filter("bus_product_type IS NOT NULL"), "departure_time", "bus_product_type")
    assert found == [("10:00", "hybrid"), ("11:00", "hybrid")]
    services = with_verdict(latest_services(frame), verdicts)
    assert tuples(services, "service_id", "bus_product_type") == [("s1", "hybrid"), ("s2", None)]


def test_order_of_input_rows_does_not_matter(spark):
    rng = random.Random(7)
    rows = [
        sighting(
            scrape_timestamp=at(1, rng.randint(5, 7)),
            service_id=rng.choice(["s1", "s2", None]),
            travels_name=rng.choice(["FlixBus", "NueGo", None]),
            bus_type=rng.choice(["Seater", "Sleeper", None]),
            total_seats=rng.choice(["36", "40", None]),
            available_seats=rng.choice(["1", "2", None]),
            is_ac=rng.choice([True, False, None]),
        )
        for _ in range(300)
    ]
    expected = tuples(latest_slots(archive(spark, *rows)))
    for _ in range(3):
        rng.shuffle(rows)
        assert tuples(latest_slots(archive(spark, *rows).repartition(5))) == expected


def test_a_dominant_key_matches_brute_force(spark):
    """Half of the sightings share one blank key."""
    rng = random.Random(11)
    rows = []
    for n in range(4000):
        hot = n % 2 == 0
        rows.append(
            sighting(
                scrape_timestamp=at(1, rng.randint(0, 11)),
                service_id=None if hot else f"s{rng.randint(1, 50)}",
                travels_name=f"FlixBus {rng.randint(1, 99)}",
            )
        )
    best = {}
    for row in rows:
        stamp, service, name = row[0], row[4], row[5]
        rank = (-stamp.timestamp(), name)
        if service not in best or rank < best[service]:
            best[service] = rank
    found = tuples(latest_slots(archive(spark, *rows)), "service_id", "travels_name")
    assert found == sorted(((s, name) for s, (_, name) in best.items()), key=repr)


# ---- forward view ----


def forward(spark, *rows, spec=EVERYTHING):
    return fwd.latest_departures(archive(spark, *rows), spec, AS_OF)


def test_operator_filter_acts_before_and_product_filter_after_dedup(spark):
    rows = [
        sighting(scrape_timestamp=at(1, 6), bus_type="Seater"),
        sighting(scrape_timestamp=at(1, 7), bus_type="Sleeper"),
        sighting(scrape_timestamp=at(1, 8), travels_name="Sharma Travels"),
    ]
    assert tuples(forward(spark, *rows), "bus_type") == [("Sleeper",)]
    assert forward(spark, *rows, spec=FilterSpec(products=("Seater",))).count() == 0
    template = fwd.latest_departures_template(
        archive(spark, *rows[:2]), FilterSpec(products=("Seater",)), AS_OF
    )
    assert template.count() == 1


def test_template_drops_a_departure_whose_newest_name_is_unknown(spark):
    rows = [sighting(), sighting(scrape_timestamp=at(1, 8), travels_name="Sharma Travels")]
    assert fwd.latest_departures_template(archive(spark, *rows), EVERYTHING, AS_OF).count() == 0
    assert forward(spark, *rows).count() == 1


def test_forward_window_edges(spark):
    rows = [
        sighting(service_id="today", departure_date="01-Jun-2026"),
        sighting(service_id="last", departure_date="01-Jul-2026"),
        sighting(service_id="after", departure_date="02-Jul-2026"),
        sighting(service_id="before", departure_date="31-May-2026"),
        sighting(service_id="broken", departure_date="soon"),
        sighting(service_id="stale", scrape_timestamp=at(30, 11, month=5)),
    ]
    assert tuples(forward(spark, *rows), "service_id") == [("last",), ("today",)]


def test_detail_row(spark):
    line = "e1fa0e0a-a170-4ed5-b95f-b7f88f252f46"
    rows = [
        sighting(service_id=f"{line}-9", bus_type="Volvo A/C Semi Sleeper", is_ac=None),
        sighting(service_id=f"{line}-9", travels_name="NueGo", departure_time="11:00"),
        sighting(service_id="s3", total_seats="0", bus_type=None),
        sighting(service_id="s4", available_seats="x", total_seats="36"),
        sighting(service_id="s5", available_seats="50"),
    ]
    columns = (
        "service_id", "operator", "line_number", "product", "is_ac", "is_volvo",
        "total_seats", "avail_seats", "load_pct",
    )
    assert tuples(fwd.detail(forward(spark, *rows)), *columns) == [
        (f"{line}-9", "flix", "IN0410", "Seater", None, True, 40, 10, 75.0),
        (f"{line}-9", "nuego", None, "Seater", True, False, 40, 10, 75.0),
        ("s3", "flix", None, "Unknown", True, False, None, 10, None),
        ("s4", "flix", None, "Sleeper", True, False, 36, None, None),
        ("s5", "flix", None, "Seater", True, False, 40, 50, -25.0),
    ]


def test_detail_cap_is_a_prefix_of_the_fixed_order(spark):
    base = forward(spark, *(sighting(service_id=f"s{n}") for n in range(9)))
    ordered = sorted(tuple(row) for row in fwd.detail(base).collect())
    assert [tuple(row) for row in fwd.detail_capped(base, cap=4).collect()] == ordered[:4]


def test_seats_and_load_per_band(spark):
    base = forward(
        spark,
        sighting(service_id="a", total_seats="40", available_seats="10"),
        sighting(service_id="b", total_seats="30", available_seats="0"),
        sighting(service_id="c", total_seats="0", available_seats="5"),
        sighting(service_id="d", total_seats="20", available_seats=None),
        sighting(service_id="e", total_seats=None, departure_time=None),
    )
    assert tuples(fwd.by_operator_hourband(base)) == [
        ("flix", "06:00-11:59", 4, 90, 87.5),
        ("flix", "unknown", 1, 0, None),
    ]


def test_lines_gather_distinct_times(spark):
    base = forward(
        spark,
        sighting(departure_time="11:00"),
        sighting(departure_time="10:00"),
        sighting(departure_time="10:00", departure_date="04-Jun-2026"),
        sighting(departure_time=None),
        sighting(departure_time=""),
        sighting(service_id=None, departure_time=None),
        sighting(service_id="", departure_time=None),
    )
    assert tuples(fwd.by_line(base)) == [
        ("(no-service)", "delhi to jaipur", "flix", 2, []),
        ("s1", "delhi to jaipur", "flix", 5, ["10:00", "11:00"]),
    ]


def test_forward_results_agree_with_each_other(spark):
    rows = fixtures.inventory(spark, SF_DIRS["small"])
    with shared(fwd.latest_departures(rows, EVERYTHING, AS_OF)) as base:
        results = fwd.departure_results(base)
        total = results["row_count"].first()[0]
        assert total > 0
        for name in ("by_day", "by_operator_hourband", "by_line"):
            assert results[name].agg(F.sum("departure_count")).first()[0] == total
        assert results["rows"].count() == total


# ---- past views ----


def services(spark, *rows, spec=EVERYTHING, **kwargs):
    return past.past_services(archive(spark, *rows), spec, AS_OF, **kwargs)


def test_trend_counts_distinct_services(spark):
    base = services(
        spark,
        past_sighting(20, service_id="a", departure_time="10:00"),
        past_sighting(20, service_id="a", departure_time="12:00"),
        past_sighting(20, service_id="a", relation_name="jaipur to delhi"),
        past_sighting(20, service_id="b"),
        past_sighting(20, service_id="c", travels_name="NueGo"),
        past_sighting(20, service_id=""),
        past_sighting(1, month=6, service_id="today"),
        sighting(departure_date="16-Apr-2026", scrape_timestamp=at(16, month=4)),
    )
    day = date(2026, 5, 20)
    assert tuples(past.trend(base)) == [(day, "flix", 2), (day, "nuego", 1)]


def test_explicit_range_bounds_scrapes_too(spark):
    spec = FilterSpec(dep_from=date(2026, 5, 20), dep_to=date(2026, 5, 20))
    base = services(
        spark,
        past_sighting(20, service_id="seen", scrape_timestamp=at(5, 0, month=5)),
        past_sighting(20, service_id="missed", scrape_timestamp=at(4, 23, month=5)),
        past_sighting(21, service_id="other day"),
        spec=spec,
    )
    assert tuples(base, "service_id") == [("seen",)]
    reversed_spec = FilterSpec(dep_from=date(2026, 5, 21), dep_to=date(2026, 5, 20))
    assert services(spark, past_sighting(10), spec=reversed_spec).count() == 1


def test_share_and_weekdays(spark):
    base = services(
        spark,
        *(past_sighting(18, service_id=f"f{n}") for n in range(2)),
        past_sighting(18, service_id="n", travels_name="NueGo"),
        past_sighting(25, service_id="f0"),
        past_sighting(26, service_id="f0"),
    )
    assert tuples(past.share(base)) == [
        (date(2026, 5, 18), "flix", 2, 66.7),
        (date(2026, 5, 18), "nuego", 1, 33.3),
        (date(2026, 5, 25), "flix", 1, 100.0),
        (date(2026, 5, 26), "flix", 1, 100.0),
    ]
    # A Monday without a NueGo row does not pull its mean down.
    assert tuples(past.weekdays(base)) == [
        ("flix", 0, "Mon", 1.5, 2),
        ("flix", 1, "Tue", 1.0, 1),
        ("nuego", 0, "Mon", 1.0, 1),
    ]


def test_relations_count_a_daily_service_once(spark):
    base = services(
        spark,
        *(past_sighting(day, service_id="daily") for day in (18, 19, 20)),
        past_sighting(18, service_id="n", travels_name="NueGo"),
        past_sighting(18, service_id="x", relation_name="pune to goa"),
    )
    assert tuples(past.top_relations(base)) == [
        ("delhi to jaipur", 2, "flix", 1),
        ("delhi to jaipur", 2, "nuego", 1),
        ("pune to goa", 1, "flix", 1),
    ]
    assert tuples(past.top_relations(base, k=1), "relation") == [("delhi to jaipur",)] * 2


def test_top_relations_break_ties_by_name(spark):
    base = services(spark, *(past_sighting(18, relation_name=f"r{n:02}") for n in range(12)))
    assert tuples(past.top_relations(base), "relation") == [(f"r{n:02}",) for n in range(10)]


def compared(spark, *rows):
    return past.compared_services(archive(spark, *rows), EVERYTHING, AS_OF)


def test_week_over_week(spark):
    base = compared(
        spark,
        past_sighting(25, service_id="a"),
        past_sighting(31, service_id="a"),
        past_sighting(31, service_id="b"),
        past_sighting(24, service_id="a"),
        past_sighting(18, service_id="a"),
        past_sighting(17, service_id="too old"),
        past_sighting(31, service_id="n", travels_name="NueGo"),
        past_sighting(18, service_id="z", travels_name="Zingbus"),
    )
    assert tuples(past.week_over_week(base, AS_OF)) == [
        ("flix", 3, 2, 1, 50.0),
        ("nuego", 1, 0, 1, None),
        ("zingbus", 0, 1, -1, -100.0),
    ]
    assert past.compared_weeks(AS_OF) == {
        "current": (date(2026, 5, 25), date(2026, 5, 31)),
        "prior": (date(2026, 5, 18), date(2026, 5, 24)),
    }


def test_movers_skip_routes_without_a_prior_week(spark):
    base = compared(
        spark,
        past_sighting(31, relation_name="up", service_id="a"),
        past_sighting(31, relation_name="up", service_id="b"),
        past_sighting(20, relation_name="up", service_id="a"),
        past_sighting(20, relation_name="down"),
        past_sighting(31, relation_name="new"),
    )
    changes = past.week_over_week_by_relation(base, AS_OF)
    assert changes.count() == 3
    assert [row.relation for row in past.gainers(changes).collect()] == ["up", "down"]
    assert [row.relation for row in past.losers(changes).collect()] == ["down", "up"]


def test_utilisation_uses_the_newest_valid_sighting(spark):
    rows = [
        past_sighting(20, scrape_timestamp=at(19, 6, month=5), available_seats="20"),
        past_sighting(20, scrape_timestamp=at(19, 7, month=5), available_seats="n/a"),
        past_sighting(20, scrape_timestamp=at(19, 8, month=5), total_seats="0"),
        past_sighting(20, service_id="n", travels_name="NueGo", available_seats="0"),
    ]
    points = past.utilization(archive(spark, *rows), EVERYTHING, AS_OF)
    day = date(2026, 5, 20)
    assert tuples(points) == [(day, "comp", 40, 0, 100.0), (day, "flix", 40, 20, 50.0)]


def test_shares_add_up_and_weeks_cover_the_trend(spark):
    rows = fixtures.inventory(spark, SF_DIRS["small"])
    base = past.past_services(rows, EVERYTHING, AS_OF)
    off = past.share(base).groupBy("departure_date").agg(
        F.abs(F.sum("share_pct") - 100).alias("off"), F.count("*").alias("k")
    )
    assert off.filter("off > 0.1 * k").count() == 0
    two_weeks = past.compared_services(rows, EVERYTHING, AS_OF)
    weeks = past.week_over_week(two_weeks, AS_OF).agg(F.sum(F.col("current") + F.col("prior")))
    trend = past.trend(two_weeks).agg(F.sum("departure_count"))
    assert weeks.first()[0] == trend.first()[0] > 0


@pytest.mark.parametrize(
    ("view", "names"),
    [
        ("wow", {"delta", "weeks"}),
        ("trend_45", {"points"}),
        ("share", {"points"}),
        ("dow", {"points"}),
        ("top_relations", {"rows"}),
        ("wow_relation", {"gainers", "losers", "weeks"}),
        ("util", {"points"}),
        ("anything else", {"delta", "weeks"}),
    ],
)
def test_history_by_view_name(spark, view, names):
    rows = archive(spark, past_sighting(20), past_sighting(30))
    results = past.history(rows, EVERYTHING, AS_OF, view)
    assert set(results) == names
    assert all(frame.count() > 0 for frame in results.values())


def test_history_passes_its_arguments_on(spark):
    rows = archive(
        spark, *(past_sighting(20 + n, service_id=f"s{n}", relation_name=f"r{n}") for n in range(8))
    )
    assert past.history(rows, EVERYTHING, AS_OF, "top_relations", k=2)["rows"].count() == 2
    assert past.history(rows, EVERYTHING, AS_OF, "trend_45", days=5)["points"].count() == 1
    weeks = past.history(rows, EVERYTHING, AS_OF)["weeks"]
    assert tuples(weeks) == [
        ("current", date(2026, 5, 25), date(2026, 5, 31), "flix", 3),
        ("prior", date(2026, 5, 18), date(2026, 5, 24), "flix", 5),
    ]


def test_blank_service_times_stay_in_long_form(spark):
    """Most departures share the blank id; no row gathers their times."""
    base = forward(
        spark,
        *(sighting(service_id="", departure_time=f"{n % 24:02}:{n % 60:02}") for n in range(300)),
        sighting(),
    )
    lines = fwd.by_line_times(base)
    assert lines.filter("service_id = '(no-service)'").count() == 120
    assert lines.agg(F.sum("departure_count")).first()[0] == base.count()


def test_filters_in_force_fill_in_defaults():
    shown = FilterSpec(region="IN01", hour_from=3).in_force(AS_OF)
    assert shown["operators"][0] == "flix" and shown["hours"] is None
    assert (shown["dep_from"], shown["dep_to"], shown["region"]) == ("2026-06-01", "2026-07-01", "IN01")


def test_there_is_no_month_over_month_view(spark):
    with pytest.raises(ValueError):
        past.history(archive(spark), EVERYTHING, AS_OF, "mom")


# ---- archive quality ----


def test_freshness(spark):
    rows = archive(
        spark,
        *(sighting(scrape_timestamp=at(1, 2)) for _ in range(3)),
        sighting(scrape_timestamp=at(31, 18, month=5)),
        sighting(scrape_timestamp=at(1, 3, month=4)),
    )
    results = quality.freshness(rows, AS_OF, min_rows=2)
    assert tuples(results["latest"]) == [("2026-06-01 07:30",)]
    assert tuples(results["excluded"]) == [(date(2026, 5, 31), 1, "only 1 rows")]
    assert tuples(results["history_days"]) == [(1,)]


def test_partial_day_reason_groups_thousands(spark):
    daily = spark.createDataFrame([(TODAY, 33669), (TODAY, 50000)], "scrape_date date, n long")
    assert tuples(quality.partial_days(daily)) == [(TODAY, 33669, "only 33,669 rows")]


def test_an_empty_archive_is_not_an_error(spark):
    rows = archive(spark)
    results = quality.freshness(rows, AS_OF)
    assert tuples(results["latest"]) == [("",)]
    assert tuples(results["history_days"]) == [(0,)]
    assert quality.relation_count(rows, AS_OF).first()[0] == 0
    assert tuples(fwd.row_count(fwd.latest_departures(rows, EVERYTHING, AS_OF))) == [(0,)]


def test_relations_lists_recent_names(spark):
    rows = archive(
        spark,
        sighting(relation_name="b"),
        sighting(relation_name="b"),
        sighting(relation_name="A"),
        sighting(relation_name=None),
        sighting(relation_name="old", scrape_timestamp=at(30, 6, month=5)),
    )
    assert [row[0] for row in quality.relations(rows, AS_OF).collect()] == ["A", "b"]


def test_only_complete_scrape_days_count_in_the_older_trend(spark):
    def crawl(day, *services):
        stamp = at(day, 6, month=5)
        ahead = sighting(
            scrape_timestamp=stamp, service_id="ahead", departure_date=f"{day}-Jun-2026"
        )
        rows = [past_sighting(day, service_id=s, scrape_timestamp=stamp) for s in services]
        return [ahead, *rows]

    rows = archive(
        spark,
        *crawl(20, "a", "b"),
        *crawl(21, "c"),
        past_sighting(22, service_id="d", scrape_timestamp=at(22, 6, month=5)),
        past_sighting(22, service_id="e", scrape_timestamp=at(22, 6, month=5)),
        past_sighting(22, service_id="f", scrape_timestamp=at(22, 6, month=5)),
    )
    trend = past.trend_on_complete_days(rows, EVERYTHING, AS_OF, min_rows=3, min_span=29)
    assert tuples(trend) == [(date(2026, 5, 20), "flix", 2)]


# ---- pages and one pass ----


def test_pages_join_to_the_whole(spark):
    latest = fwd.latest_departures(fixtures.inventory(spark, SF_DIRS["small"]), FilterSpec(), AS_OF)
    odd = archive(
        spark,
        *(
            sighting(relation_name=name, service_id=service, departure_time=time)
            for name in (None, "a to b")
            for service in (None, "", "s")
            for time in (None, "", "9:00")
        ),
    )
    small = fwd.latest_departures(odd, FilterSpec(), AS_OF)
    for base, size in ((latest.persist(), 250), (small.persist(), 4)):
        pages, after = [], None
        while page := fwd.detail_page(base, size, after).collect():
            pages += page
            after = page[-1].asDict()
        expected = fwd.detail_capped(base, 10**6).collect()
        assert [tuple(row) for row in pages] == [tuple(row) for row in expected]
        base.unpersist()


def test_a_page_drops_the_rows_before_it_first(spark):
    latest = fwd.latest_departures(fixtures.inventory(spark, SF_DIRS["small"]), FilterSpec(), AS_OF)
    after = dict.fromkeys(fwd.PAGE_KEY, "x") | {"departure_date": date(2026, 6, 20)}
    text = plan(fwd.detail_page(latest, 10, after))
    assert "TakeOrderedAndProject" in text
    # The date is known before the newest sightings are looked for.
    scan = text.split("(1) Scan")[1]
    assert scan.index(">= 2026-06-20") < scan.index("WindowGroupLimit")


def test_one_pass_equals_the_separate_results(spark):
    latest = fwd.latest_departures(fixtures.inventory(spark, SF_DIRS["small"]), FilterSpec(), AS_OF)
    views = fwd.in_one_pass(latest)
    text = plan(views)
    assert text.count("WindowGroupLimit") == plan(latest).count("WindowGroupLimit")
    assert text.split("(1) Scan")[0].count("Scan parquet") == 1
    # One exchange finds the newest sightings, one groups them.
    assert text.split("(1) Scan")[0].count("Exchange") == 2
    separate = fwd.departure_results(latest)
    for name, frame in fwd.one_pass_results(views).items():
        assert frame.columns == separate[name].columns
        assert tuples(frame) == tuples(separate[name]), name
    none = fwd.one_pass_results(fwd.in_one_pass(latest.limit(0)))
    assert none["row_count"].first()[0] == 0 and none["by_line"].isEmpty()


def test_past_views_echo_their_own_window():
    assert FilterSpec().in_force_past(AS_OF, 45)["dep_from"] == "2026-04-17"
    assert FilterSpec().in_force_past(AS_OF, 45)["dep_to"] == "2026-05-31"
    spec = FilterSpec(dep_from=date(2026, 5, 4), dep_to=date(2026, 5, 24), region="IN01")
    echo = spec.in_force_past(AS_OF, 45)
    assert (echo["dep_from"], echo["dep_to"], echo["region"]) == ("2026-05-04", "2026-05-24", "IN01")


def test_utilisation_takes_verdicts(spark):
    rows = fixtures.inventory(spark, SF_DIRS["small"])
    slots = fixtures.verdicts(spark, SF_DIRS["small"])
    plain = past.history(rows, FilterSpec(), AS_OF, "util")["points"]
    joined = past.history(rows, FilterSpec(), AS_OF, "util", slots)["points"]
    assert tuples(joined) == tuples(plain)


def test_services_of_several_windows_come_from_one_pass(spark):
    found = QUERIES["services_of_windows"](spark, SF_DIRS["small"])
    # The sightings and the numbers of services, each read once whatever the windows.
    assert plan(found).split("(1) Scan")[0].count("Scan parquet") == 2
    rows = [
        (date(2026, 5, 1), "r", "flix", 1), (date(2026, 5, 2), "r", "flix", 1),
        (date(2026, 5, 2), "q", "nuego", 2), (date(2026, 5, 3), "r", "flix", 3), (None, "r", "flix", 4),
    ]
    services = spark.createDataFrame(
        rows, "departure_date date, relation_name string, operator string, service_no long"
    )
    days = past.service_days(services)
    first, second, third = (row[0] for row in rows[:1] + rows[2:4])
    windows = {"a": (first, second), "b": (second, third), "none": (third, first)}
    assert tuples(past.services_in_windows(days, windows)) == sorted(
        (*row, name) for name, span in windows.items() for row in tuples(past.services_between(days, *span))
    )


def test_the_archive_query_does_not_run_methods_too_large_to_compile(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    with setting(spark, "spark.sql.codegen.hugeMethodLimit", "65535"):
        fixtures.inventory(spark, SF_DIRS["small"])
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
