"""Published loads, the newest layer and what is known of days."""

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lastseen import FilterSpec
from lastseen.operators.bitmaps import bitmaps_of, distinct_counts, merged_bitmaps
from lastseen.operators.completeness import complete_among, complete_days
from lastseen.operators.filters import scrape_end, scraped_since
from lastseen.operators.latest import latest_services, latest_slots
from lastseen.operators.newest import merged, newest_of_days
from lastseen.plans import departures as fwd
from lastseen.plans import history as past
from lastseen.plans import quality
from lastseen.sources import layers, published
from lastseen.sources.archive import RAW_INVENTORY, typed_inventory, unparsed_counts
from tests.conftest import SF_DIRS
from tests.rows import AS_OF, archive, at, sighting, tuples
from tests.test_archive import plan
from verification import fixtures

RANGE = FilterSpec(dep_from=date(2026, 5, 4), dep_to=date(2026, 5, 12))
SPECS = (
    FilterSpec(),
    FilterSpec(operators=("intrcity", "nuego")),
    FilterSpec(products=("Sleeper",), region="IN01"),
    FilterSpec(relation="Mumbai to Goa", hour_from=6, hour_to=15),
    FilterSpec(line_code="svc-12"),
    RANGE,
)


@pytest.fixture(scope="module")
def typed(spark):
    return fixtures.inventory(spark, SF_DIRS["small"])


@pytest.fixture(scope="module")
def root(spark, typed, tmp_path_factory):
    """The small table in three loads, one day of it in two parts and one replaced."""
    root = str(tmp_path_factory.mktemp("published"))
    early = F.col("scrape_date") < date(2026, 5, 1)
    half = F.col("service_id") < "svc-2"
    hot = F.col("scrape_date") == date(2026, 5, 20)
    layers.load_days(typed.filter(early | hot & half), root)
    layers.load_days(typed.filter(hot).withColumn("travels_name", F.lit("wrong")), root, replace=True)
    layers.load_days(typed.filter(~early & ~hot), root)
    layers.load_days(typed.filter(hot), root, replace=True)
    return root


def wide(spark, seed=1, rows=400):
    """Sightings of few slots that differ in everything a filter or a tie looks at."""
    chance = random.Random(seed)
    pick = chance.choice
    return [
        sighting(
            scrape_timestamp=at(pick((29, 30, 31)), pick((0, 6, 18, 19)), month=5),
            relation_name=pick(("delhi to jaipur", "Mumbai to Goa", None)),
            service_id=pick(("s1", "s2", "", None)),
            departure_time=pick(("10:00:00", "23:30:00", None)),
            departure_date=pick(("20-May-2026", "03-Jun-2026")),
            travels_name=pick(("FlixBus", "NueGo", "Other", None)),
            bus_type=pick(("A/C Seater", "Volvo Sleeper", None)),
            total_seats=pick(("36", "40", "0", "x")),
            available_seats=pick(("1", "2", "", None)),
            is_ac=pick((True, False, None)),
        )
        for _ in range(rows)
    ]


def test_loads_add_up_and_replace_days(spark, root, typed):
    back = layers.sightings(spark, root)
    assert tuples(back, *typed.columns) == tuples(typed, *typed.columns)
    some = layers.sightings(spark, root, date(2026, 5, 19), date(2026, 5, 20))
    window = F.col("scrape_date").between(date(2026, 5, 19), date(2026, 5, 20))
    assert some.count() == typed.filter(window).count()
    assert {f.split("/load=")[1].split("/")[1] for f in some.inputFiles()} == {
        "scrape_date=2026-05-19",
        "scrape_date=2026-05-20",
    }


def test_newest_by_slot_and_by_service_over_the_layer(spark, root, typed):
    layer = layers.newest_sightings(spark, root)
    for newest in (latest_slots, latest_services):
        assert tuples(newest(layer)) == tuples(newest(typed))
    text = plan(latest_services(layer, "travels_name"))
    assert f"/{layers.NEWEST}/load=" in text and f"/{layers.SIGHTINGS}/" not in text


@pytest.mark.parametrize("spec", SPECS, ids=repr)
def test_views_over_the_layer(spark, root, typed, spec):
    layer = layers.newest_sightings(spark, root, until=scrape_end(spec))
    plain = typed.filter(F.col("scrape_timestamp") <= (scrape_end(spec) or datetime(2100, 1, 1)))
    for rows in (layer, typed):
        assert set(rows.columns) >= set(typed.columns)
    pairs = [
        (past.trend(past.past_services(rows, spec, AS_OF)), past.utilization(rows, spec, AS_OF))
        for rows in (layer, plain)
    ]
    if spec is not RANGE:
        pairs = [
            (
                *frames,
                fwd.detail(fwd.latest_departures(rows, spec, AS_OF)),
                fwd.hourband_template(fwd.latest_departures_template(rows, spec, AS_OF)),
            )
            for frames, rows in zip(pairs, (layer, typed))
        ]
    for ours, raw in zip(*pairs):
        assert tuples(ours) == tuples(raw)


@pytest.mark.parametrize("seed", range(3))
def test_views_agree_where_everything_competes(spark, seed):
    rows = archive(spark, *wide(spark, seed))
    layer = newest_of_days(rows)
    assert layer.count() < rows.count()
    for spec in (FilterSpec(), FilterSpec(operators=("nuego",), products=("Sleeper",))):
        for begins in (at(29, 3, month=5), at(29, 18, month=5)):
            for view in (latest_slots, latest_services):
                assert tuples(view(layer.filter(F.col("scrape_timestamp") >= begins), "total_seats")) == tuples(
                    view(rows.filter(F.col("scrape_timestamp") >= begins), "total_seats")
                )
        for view in (
            lambda r: past.utilization(r, spec, AS_OF),
            lambda r: past.past_services(r, spec, AS_OF),
            lambda r: fwd.latest_departures(r, spec, AS_OF),
            lambda r: fwd.latest_departures_template(r, spec, AS_OF),
        ):
            assert tuples(view(layer)) == tuples(view(rows))


def test_a_window_that_ends_within_a_day(spark, tmp_path):
    """A slot seen before and after the end counts as it was before the end."""
    spec = FilterSpec(dep_from=date(2026, 5, 4), dep_to=date(2026, 5, 12))
    end = scrape_end(spec)
    assert end == datetime(2026, 5, 27, tzinfo=timezone.utc)
    seen = {"departure_date": "05-May-2026", "service_id": "late"}
    rows = archive(
        spark,
        sighting(scrape_timestamp=end - timedelta(hours=1), travels_name="NueGo", **seen),
        sighting(scrape_timestamp=end + timedelta(hours=1), travels_name="FlixBus", **seen),
    )
    layers.load_days(rows, str(tmp_path))
    layer = layers.newest_sightings(spark, str(tmp_path), until=end)
    trend = past.trend(past.past_services(layer, spec, AS_OF))
    assert tuples(trend) == [(date(2026, 5, 5), "nuego", 1)]
    assert tuples(trend) == tuples(past.trend(past.past_services(rows, spec, AS_OF)))
    assert layer.filter("service_no IS NULL").isEmpty()


def test_merging_layers_in_any_order(spark):
    parts = [newest_of_days(archive(spark, *wide(spark, seed, 60))) for seed in range(3)]
    whole = newest_of_days(archive(spark, *(row for seed in range(3) for row in wide(spark, seed, 60))))
    a, b, c = parts
    columns = whole.columns
    for layer in (merged(a, merged(b, c)), merged(merged(c, a), b), merged(a, b, c, a)):
        assert tuples(layer, *columns) == tuples(whole, *columns)


def test_a_load_that_fails_leaves_the_old_days(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "a")
    layers.load_days(archive(spark, sighting(service_id="old")), root)
    broken = F.when(F.col("service_id") == "new9", F.raise_error(F.lit("feed broke off"))).otherwise(
        F.col("travels_name")
    )
    rows = [sighting(service_id=f"new{n}", departure_date=f"{n + 1}-Jun-2026") for n in range(10)]
    batch = archive(spark, *rows).repartition(10)
    with pytest.raises(PySparkException):
        layers.load_days(batch.withColumn("travels_name", broken), root, replace=True)
    assert tuples(layers.sightings(spark, root), "service_id") == [("old",)]
    # Also when the failure comes after the sightings are written, or at the last step.
    for name in ("new_numbers", "newest_of_days"):
        with monkeypatch.context() as patch:
            patch.setattr(layers, name, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                layers.load_days(batch, root, replace=True)
        assert tuples(layers.newest_sightings(spark, root), "service_id") == [("old",)]
    assert len(list((tmp_path / "a" / layers.SIGHTINGS).glob("load=*"))) == 1
    layers.load_days(batch, root, replace=True)
    assert layers.sightings(spark, root).count() == 10


def test_two_loads_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    layers.load_days(archive(spark, sighting(service_id="first")), root)
    began = published.manifest(spark, root)
    layers.load_days(archive(spark, sighting(service_id="second")), root)
    with monkeypatch.context() as patch:
        patch.setattr(published, "manifest", lambda *_: began)
        with pytest.raises(published.LoadConflict):
            layers.load_days(archive(spark, sighting(service_id="third")), root)
    assert tuples(layers.sightings(spark, root), "service_id") == [("first",), ("second",)]
    layers.load_days(archive(spark, sighting(service_id="third")), root)
    assert layers.sightings(spark, root).count() == 3


def test_replaced_loads_are_cleaned(spark, tmp_path):
    root = str(tmp_path)
    for service in ("a", "b", "c"):
        layers.load_days(archive(spark, sighting(service_id=service)), root, replace=True)
    assert len(published.clean(spark, root, layers.TABLES, keep=2)) == 1
    assert len(list((tmp_path / layers.SIGHTINGS).glob("load=*"))) == 2
    # Numbers of services last, so the parts that hold them stay.
    assert len(list((tmp_path / layers.SERVICES).glob("load=*"))) == 3
    assert tuples(layers.newest_sightings(spark, root), "service_id") == [("c",)]


def test_services_keep_their_numbers(spark, root, tmp_path):
    found = published.manifest(spark, root)
    numbers = published.read_lasting(spark, root, layers.SERVICES, layers.SERVICE_NUMBERS, found)
    rows = tuples(numbers)
    assert len(rows) == len({row[0] for row in rows}) == len({row[1] for row in rows})
    layer = layers.newest_sightings(spark, root)
    wanted = layer.filter("relation_name IS NOT NULL AND service_id <> ''")
    joined = wanted.join(numbers.withColumnRenamed("service_no", "given"), "service_id")
    assert joined.count() == wanted.count()
    assert joined.filter(~F.col("given").eqNullSafe(F.col("service_no"))).isEmpty()
    assert layer.filter("service_id = '' AND service_no IS NOT NULL").isEmpty()


def test_days_are_known_without_reading_data(spark, root, typed):
    sizes = layers.day_sizes(spark, root, AS_OF, 60)
    daily = sizes.select("scrape_date", "n")
    raw = quality.daily_scrape_counts(typed, AS_OF)
    assert tuples(daily, "scrape_date", "n") == tuples(raw, "scrape_date", "n")
    assert tuples(complete_among(sizes, 100, 29)) == tuples(
        complete_days(scraped_since(typed, AS_OF, 60), 100, 29)
    )
    assert tuples(quality.partial_days(daily, 120)) == tuples(quality.partial_days(raw, 120))
    assert tuples(quality.clean_day_count(daily, 120)) == tuples(quality.clean_day_count(raw, 120))
    assert tuples(layers.latest_scrape(spark, root)) == tuples(quality.latest_scrape(typed))
    for frame in (complete_among(sizes), daily, layers.latest_scrape(spark, root)):
        assert "Scan parquet" not in plan(frame)


def test_a_window_that_begins_within_a_day_reads_that_day(spark, root, typed):
    as_of = AS_OF - timedelta(days=8, hours=3)
    sizes = layers.day_sizes(spark, root, as_of, 10)
    assert {f.split("scrape_date=")[1][:10] for f in sizes.inputFiles()} == {"2026-05-14"}
    assert tuples(sizes, "scrape_date", "n") == tuples(
        quality.daily_scrape_counts(typed, as_of, 10), "scrape_date", "n"
    )


def test_nothing_published_and_null_days(spark, tmp_path):
    root = str(tmp_path / "none")
    assert layers.sightings(spark, root).isEmpty() and layers.newest_sightings(spark, root).isEmpty()
    assert layers.day_sizes(spark, root, AS_OF, 60).isEmpty()
    assert layers.latest_scrape(spark, root).first()[0] == ""
    rows = archive(spark, sighting(scrape_timestamp=None, departure_date="never"), sighting())
    layers.load_days(rows, root)
    assert tuples(layers.sightings(spark, root), *rows.columns) == tuples(rows)
    assert layers.sightings(spark, root, since=date(2026, 1, 1)).count() == 1
    layers.load_days(rows.limit(0), root)
    assert layers.sightings(spark, root).count() == 2
    assert layers.day_sizes(spark, root, AS_OF, 60).count() == 1


# ---- bitmaps, rejects ----


def test_bitmaps_over_the_stored_layer(spark, root, typed):
    layer = layers.newest_sightings(spark, root)
    services = past.past_services(layer, FilterSpec(), AS_OF, carried=("service_no",))
    days = past.service_days(services)
    plain = past.past_services(typed, FilterSpec(), AS_OF)
    for view in (past.trend, past.share, past.weekdays, past.relation_operator_counts):
        assert tuples(view(days)) == tuples(view(plain)), view.__name__
    text = plan(past.daily_counts(days))
    # Rows are shuffled once, to find the newest; then bitmaps, then counts.  No join.
    assert "Join" not in text and f"/{layers.NEWEST}/load=" in text
    assert text.split("(1) Scan")[0].count("Exchange") == 4
    assert text.index("bitmap_construct_agg") < text.index("bitmap_or_agg")
    tree = text.split("(1) Scan")[0].splitlines()
    names = [line.strip("+-:* ").split(" ")[0] for line in reversed(tree)]
    first = names.index("Exchange")
    assert "Window" in names[first : names.index("Exchange", first + 1)]


def test_bitmaps_at_the_larger_scale(spark):
    rows = fixtures.inventory(spark, SF_DIRS["large"])
    numbers = layers.new_numbers(rows, published.empty(spark, layers.SERVICE_NUMBERS))
    layer = layers.with_service_numbers(newest_of_days(rows), numbers)
    days = past.service_days(past.past_services(layer, FilterSpec(), AS_OF, carried=("service_no",)))
    plain = past.past_services(rows, FilterSpec(), AS_OF)
    for view in (past.trend, past.relation_operator_counts):
        assert tuples(view(days)) == tuples(view(plain))


def test_distinct_counts_beyond_one_bucket(spark):
    """Numbers of several buckets, gaps, repeats, parts that overlap."""
    frame = spark.range(200_000).selectExpr("id % 70000 * 3 AS no", "id % 7 AS part", "id % 2 AS half")
    frame = frame.union(spark.createDataFrame([(None, 1, 1)], frame.schema))
    bitmaps = bitmaps_of(frame, "no", "part", "half")
    plain = frame.groupBy("half").agg(F.countDistinct("no").alias("n"))
    assert tuples(distinct_counts(bitmaps, "half")) == tuples(plain)
    assert distinct_counts(bitmaps).first()[0] == 70_000
    again = merged_bitmaps(bitmaps.union(bitmaps), "half")
    assert tuples(distinct_counts(again, "half")) == tuples(plain)


def test_numbers_go_on_from_those_given_out(spark):
    def ids(first, last):
        return archive(spark, *(sighting(service_id=f"s{n}") for n in range(first, last)))

    none = published.empty(spark, layers.SERVICE_NUMBERS)
    old = layers.new_numbers(ids(0, 3_000), none)
    new = layers.new_numbers(ids(2_000, 5_000), old)
    every = dict(tuples(old.union(new)))
    assert len(every) == len(set(every.values())) == 5_000
    assert max(every.values()) < 2 * 5_000 and new.count() == 2_000


def test_a_feed_is_split_into_typed_and_rejected_rows(spark, tmp_path):
    rows = [
        sighting(service_id="good"),
        sighting(service_id="bad", departure_date="31-Feb-2026", total_seats="n/a"),
        sighting(service_id="null", total_seats=None, available_seats=None),
        sighting(service_id="half", available_seats="12.5", scrape_timestamp=at(31, 6, month=5)),
    ]
    raw = spark.createDataFrame(rows, RAW_INVENTORY)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    root = str(tmp_path)
    layers.load_feed(raw.mapInArrow(counted, RAW_INVENTORY), root)
    assert reads.value == len(rows)
    typed = typed_inventory(raw)
    assert tuples(layers.sightings(spark, root), *typed.columns) == tuples(typed)
    bad = layers.rejected_sightings(spark, root)
    assert tuples(bad, "service_id", "reason", "unparsed") == [
        ("bad", "departure_date, total_seats", {"departure_date": "31-Feb-2026", "total_seats": "n/a"}),
        ("half", "available_seats", {"available_seats": "12.5"}),
    ]
    fine = typed.join(bad.select("service_id"), "service_id", "left_anti")
    assert tuples(fine.unionByName(bad.select(typed.columns))) == tuples(typed.select(fine.columns))
    counts = unparsed_counts(raw).first()
    for name in ("departure_date", "available_seats", "total_seats"):
        assert bad.filter(F.map_contains_key("unparsed", name)).count() == counts[name]
    # A day loaded anew takes its rejected rows with it.
    layers.load_feed(raw.filter("service_id = 'good'"), root, replace=True)
    assert tuples(layers.rejected_sightings(spark, root), "service_id") == [("half",)]
