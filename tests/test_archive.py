"""Storage round trip and the plans the stored archive allows."""

import io
import re
from contextlib import redirect_stdout
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lastseen import FilterSpec
from lastseen.operators.completeness import complete_days, on_days
from lastseen.operators.filters import scraped_since
from lastseen.operators.latest import latest_services, with_verdict
from lastseen.plans import departures as fwd
from lastseen.plans import history as past
from lastseen.plans import quality
from lastseen.session import require_utc
from lastseen.sources.archive import (
    RAW_INVENTORY,
    newest_scrape_day,
    read_inventory,
    read_verdicts,
    scrape_day,
    unparsed_counts,
    write_inventory,
    write_results,
    write_verdicts,
)
from lastseen.sources.dimensions import (
    LINE_CODES,
    ROUTE_REGIONS,
    routes_of_region,
    with_region,
)
from tests.conftest import SF_DIRS
from tests.rows import AS_OF, archive, at, setting, sighting, tuples, verdict_archive
from verification import fixtures
from verification.queries import QUERIES

EVERYTHING = FilterSpec()


def plan(frame) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return fixtures.ingest(spark, SF_DIRS["small"], str(tmp_path_factory.mktemp("archive")))


@pytest.fixture(scope="module")
def stored(spark, folder):
    return fixtures.inventory(spark, folder)


@pytest.fixture(scope="module")
def stored_verdicts(spark, folder):
    return fixtures.verdicts(spark, folder)


def test_round_trip_keeps_every_row(spark, tmp_path):
    rows = archive(
        spark,
        sighting(scrape_timestamp=at(31, 18, month=5)),
        sighting(scrape_timestamp=at(31, 19, month=5)),
        sighting(scrape_timestamp=at(31, 19, month=5)),
        sighting(scrape_timestamp=None, departure_date="never", total_seats="n/a"),
    )
    path = str(tmp_path / "inventory")
    write_inventory(rows, path)
    back = read_inventory(spark, path)
    assert tuples(back, *rows.columns) == tuples(rows)
    assert tuples(back, "departure_month") == [(None,)] + [(date(2026, 6, 1),)] * 3
    assert newest_scrape_day(spark, path) == date(2026, 6, 1)
    days = [date(2026, 5, 31), date(2026, 6, 1), date(2026, 6, 1), None]
    assert {row[0] for row in tuples(back, "scrape_date")} == set(days)
    write_inventory(rows.limit(1), path)
    assert read_inventory(spark, path).count() == 5


def test_a_load_of_whole_days_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "inventory")
    monday = archive(spark, sighting(service_id="mon", scrape_timestamp=at(31, 6, month=5)))
    tuesday = archive(spark, sighting(service_id="tue"), sighting(service_id="tue2"))
    for batch in (monday, tuesday, tuesday):
        write_inventory(batch, path, replace_days=True)
    assert tuples(read_inventory(spark, path), "service_id") == [("mon",), ("tue",), ("tue2",)]
    # A repeated load that lacks a departure month leaves none of the old one behind.
    july = archive(spark, sighting(service_id="tue3", departure_date="03-Jul-2026"))
    write_inventory(july, path, replace_days=True)
    assert tuples(read_inventory(spark, path), "service_id") == [("mon",), ("tue3",)]


def test_a_repeated_load_that_fails_leaves_the_old_days(spark, tmp_path):
    path = str(tmp_path / "inventory")
    write_inventory(archive(spark, sighting(service_id="old")), path)
    name = F.when(F.col("service_id") == "new7", F.raise_error(F.lit("feed broke off")))
    batch = archive(spark, *(sighting(service_id=f"new{n}") for n in range(10))).repartition(10)
    with pytest.raises(PySparkException):
        broken = batch.withColumn("travels_name", name.otherwise(F.col("travels_name")))
        write_inventory(broken, path, replace_days=True)
    assert tuples(read_inventory(spark, path), "service_id") == [("old",)]
    # The batch may even be made from the days it replaces.
    again = read_inventory(spark, path).withColumn("travels_name", F.lit("NueGo"))
    write_inventory(again, path, replace_days=True)
    assert tuples(read_inventory(spark, path), "service_id", "travels_name") == [("old", "NueGo")]


def test_a_load_of_verdicts_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    rows = [(at(1), "a to b", f"{day}-Jun-2026", "s1", "seater") for day in (3, 4)]
    for batch in (rows[:1], rows[1:], rows[1:]):
        write_verdicts(verdict_archive(spark, *batch), path, replace_days=True)
    assert read_verdicts(spark, path).count() == 2


def test_stored_columns_have_statistics_to_skip_by(stored):
    chunks = pq.ParquetFile(stored.inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
    columns = {chunks.column(i).path_in_schema: chunks.column(i) for i in range(chunks.num_columns)}
    for name in ("scrape_timestamp", "departure_date", "relation_name", "service_id"):
        assert columns[name].statistics.has_min_max, name


def test_unparsed_text_is_counted(spark):
    raw = spark.createDataFrame(
        [
            sighting(departure_date="31-Feb-2026", total_seats="n/a", available_seats=None),
            sighting(departure_date="1-Jun-2026", total_seats="12.5", available_seats=""),
            sighting(departure_date=None, total_seats=None),
        ],
        RAW_INVENTORY,
    )
    assert unparsed_counts(raw).first().asDict() == {
        "sightings": 3, "departure_date": 1, "available_seats": 1, "total_seats": 2,
    }


def test_verdicts_round_trip(spark, tmp_path):
    rows = verdict_archive(spark, (at(1), "a to b", "3-Jun-2026", "s1", "seater"))
    path = str(tmp_path / "verdicts")
    write_verdicts(rows, path)
    assert tuples(read_verdicts(spark, path), *rows.columns) == tuples(rows)


def test_stored_and_derived_scrape_days_agree(spark, stored):
    raw = fixtures.typed_inventory(fixtures.raw_inventory(spark, SF_DIRS["small"]))
    count = F.count("*").alias("n")
    assert tuples(stored.groupBy(scrape_day(stored).alias("d")).agg(count)) == tuples(
        raw.groupBy(scrape_day(raw).alias("d")).agg(count)
    )
    assert tuples(quality.latest_scrape(stored)) == tuples(quality.latest_scrape(raw))
    assert tuples(past.trend(past.past_services(stored, EVERYTHING, AS_OF))) == tuples(
        past.trend(past.past_services(raw, EVERYTHING, AS_OF))
    )


def test_results_are_written_by_name(spark, tmp_path, stored):
    results = fwd.departures(stored, EVERYTHING, AS_OF)
    write_results(results, str(tmp_path), partition_by={"rows": "departure_date"})
    for name, frame in results.items():
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == frame.count()
    assert list((tmp_path / "rows").glob("departure_date=*"))


def test_json_results_show_iso_dates_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(date(2026, 6, 1), None)], "date date, pct_delta double")
    write_results({"delta": rows}, str(tmp_path), file_format="json")
    text = spark.read.text(f"{tmp_path}/delta").first()[0]
    assert text == '{"date":"2026-06-01","pct_delta":null}'


def test_a_dominant_scrape_day_is_split_over_files(spark, tmp_path, stored):
    """Most sightings on one day still end up in evenly sized files."""
    hot = stored.withColumn(
        "scrape_timestamp",
        F.when(F.col("service_id") > "svc-3", F.lit(AS_OF)).otherwise(F.col("scrape_timestamp")),
    )
    with setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k"):
        write_inventory(hot, str(tmp_path / "hot"))
    files = list((tmp_path / "hot" / "scrape_date=2026-06-01").glob("*/*.parquet"))
    assert len(files) > 1
    assert read_inventory(spark, str(tmp_path / "hot")).count() == stored.count()


def test_library_refuses_other_session_zones(spark):
    with setting(spark, "spark.sql.session.timeZone", "Asia/Kolkata"):
        with pytest.raises(ValueError):
            require_utc(spark)


def test_dimensions():
    assert len(ROUTE_REGIONS) == 72 and len(set(ROUTE_REGIONS.values())) == 11
    assert len(LINE_CODES) == 150 == len(set(LINE_CODES.values()))
    assert routes_of_region("in02") == ["delhi to lucknow", "lucknow to delhi"]
    assert routes_of_region("IN08") == routes_of_region(None) == []


# ---- plans ----


def test_forward_scan_is_pruned_and_pushed_down(stored):
    text = plan(fwd.by_day(fwd.latest_departures(stored, EVERYTHING, AS_OF, used=fwd.COUNT_COLUMNS)))
    assert re.search(r"PartitionFilters: \[[^\]]*scrape_date#\d+ >= 2026-05-30", text)
    pushed = re.search(r"PushedFilters: (\[.*\])", text).group(1)
    assert "GreaterThanOrEqual(departure_date,2026-06-01)" in pushed
    assert "GreaterThanOrEqual(scrape_timestamp" in pushed
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    for column in ("bus_type", "is_ac", "is_seater", "total_seats", "available_seats"):
        assert column not in schema


def test_trend_reads_only_what_it_counts(stored):
    text = plan(past.trend(past.past_services(stored, EVERYTHING, AS_OF)))
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert {part.split(":")[0] for part in schema.split(",")} == {
        "scrape_timestamp", "relation_name", "departure_date", "service_id", "travels_name",
    }


def test_relation_and_line_filters_reach_the_scan(stored):
    spec = FilterSpec(relation="Mumbai to Goa", line_code="IN0421B")
    pushed = re.search(
        r"PushedFilters: (\[.*\])", plan(fwd.latest_departures(stored, spec, AS_OF))
    ).group(1)
    assert "EqualTo(relation_name,Mumbai to Goa)" in pushed
    assert "StringStartsWith(service_id,4568ed20" in pushed


def test_newest_sightings_are_cut_before_the_shuffle(stored):
    text = plan(latest_services(stored))
    partial = text.index("WindowGroupLimit", text.index("Exchange"))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < partial


def test_verdict_scan_prunes_departure_days(stored, stored_verdicts):
    text = plan(fwd.latest_departures(stored, EVERYTHING, AS_OF, stored_verdicts))
    assert re.search(r"PartitionFilters: \[[^\]]*departure_date#\d+ >= 2026-06-01", text)


def test_service_verdict_join_needs_no_further_shuffle(spark, stored, stored_verdicts):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        text = plan(with_verdict(latest_services(stored, "travels_name"), stored_verdicts))
    assert "SortMergeJoin" in text
    assert text.split("(1) Scan")[0].count("Exchange") == 2


def test_blank_slots_are_spread_over_the_join(spark, stored_verdicts):
    """Slots of one blank service differ in time only and share no verdict."""
    rows = archive(
        spark,
        *(
            sighting(service_id="", departure_time=f"{n % 24:02}:{n // 24:02}:00")
            for n in range(960)
        ),
    )
    with (
        setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"),
        setting(spark, "spark.sql.adaptive.enabled", "false"),
    ):
        joined = fwd.latest_departures(rows, EVERYTHING, AS_OF, stored_verdicts)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(row["count"] for row in sizes) == 960
    assert max(row["count"] for row in sizes) < 960 / 4


def test_complete_days_prune_partitions(stored):
    days = complete_days(scraped_since(stored, AS_OF, 60), 10, 29)
    text = plan(on_days(stored, days))
    assert "dynamicpruning" in text and "BroadcastHashJoin LeftSemi" in text


def test_lookups_are_broadcast(stored):
    assert "BroadcastHashJoin LeftOuter" in plan(with_region(stored))
    assert "BroadcastHashJoin LeftOuter" in plan(
        fwd.detail(fwd.latest_departures(stored, EVERYTHING, AS_OF))
    )


def executed(frame) -> str:
    """Plan after the query ran, with the stages it reused."""
    frame.collect()
    return plan(frame)


def test_movers_compute_the_changes_once(stored):
    base = past.compared_services(stored, EVERYTHING, AS_OF)
    movers = past.movers(past.week_over_week_by_relation(base, AS_OF))
    assert "ReusedExchange" in executed(movers)


def test_a_catalog_table_works_like_a_path(spark, tmp_path, stored):
    target = str(tmp_path / "table")
    stored.write.partitionBy("scrape_date").option("path", target).saveAsTable("stored_inventory")
    try:
        table = spark.table("stored_inventory")
        frame = past.trend(past.past_services(table, EVERYTHING, AS_OF))
        assert "PartitionFilters: [isnotnull(scrape_date" in plan(frame)
        assert tuples(frame) == tuples(past.trend(past.past_services(stored, EVERYTHING, AS_OF)))
    finally:
        spark.sql("DROP TABLE stored_inventory")


def test_newest_scrape_opens_the_newest_partition_only(spark, folder, stored):
    day = newest_scrape_day(spark, f"{folder}/inventory")
    frame = quality.latest_scrape(stored, day)
    text = plan(frame)
    assert text.count("Scan parquet") == 2  # tree and details of one scan
    assert re.search(rf"PartitionFilters: \[[^\]]*scrape_date#\d+ >= {day}", text)
    assert tuples(frame) == tuples(quality.latest_scrape(stored))


def test_template_scans_prune_departure_months(stored):
    spec = FilterSpec(origin_hub="Delhi", products=("Sleeper",))
    for frame in (
        fwd.latest_departures_template(stored, spec, AS_OF),
        past.past_services(stored, EVERYTHING, AS_OF),
    ):
        assert re.search(r"PartitionFilters: \[[^\]]*departure_month#\d+ >= 2026", plan(frame))


def test_region_filter_reaches_the_scan(stored):
    text = plan(fwd.latest_departures(stored, FilterSpec(region="IN01"), AS_OF))
    assert re.search(r"PushedFilters: \[.*In\(relation_key", text)


def test_building_queries_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    for build in QUERIES.values():
        build(spark, SF_DIRS["small"])
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_stored_and_lazy_queries_agree(spark, folder):
    for name in ("departures_detail", "trend_by_region", "hourband_template", "share", "by_line"):
        lazy, stored = (QUERIES[name](spark, place) for place in (SF_DIRS["small"], folder))
        assert tuples(lazy) == tuples(stored), name


@pytest.mark.parametrize("name", ["by_operator_hourband", "hourband_template"])
def test_mean_load_does_not_depend_on_row_order(spark, monkeypatch, name):
    lazy, results = fixtures.inventory, []
    for partitions in (1, 64):
        monkeypatch.setattr(
            "verification.queries.inventory",
            lambda s, d, n=partitions: lazy(s, d).repartition(n, F.rand(n)),
        )
        results.append(tuples(QUERIES[name](spark, SF_DIRS["small"])))
    assert results[0] == results[1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_in_the_jvm_without_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIRS["small"]))
    for unwanted in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text
