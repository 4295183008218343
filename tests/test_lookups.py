"""Point lookups read few row groups of an archive stored for them."""

from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lastseen import FilterSpec
from lastseen.plans import history as past
from lastseen.sources import layers
from lastseen.sources.lookups import curve
from tests.rows import AS_OF, archive, at, setting, sighting, tuples

DAYS, SERVICES = 14, 3_000


def many(spark):
    """One scrape of many services over the days of a month, ids without an order."""
    base = archive(spark, sighting(scrape_timestamp=at(20, 6, month=5)))
    number = F.col("id") % SERVICES
    rows = spark.range(DAYS * SERVICES).select(
        F.sha2(number.cast("string"), 256).alias("service_id"),
        F.date_add(F.lit(date(2026, 5, 1)), (F.col("id") / SERVICES).cast("int")).alias("departure_date"),
        F.concat(F.lit("route "), F.md5((number % 500).cast("string"))).alias("relation_name"),
    )
    return rows.crossJoin(base.drop(*rows.columns)).select(base.columns)


def rows_scanned(spark, frame) -> int:
    """Rows the scans of a query hand on, whole row groups at a time."""
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        ran = frame.select("*")._jdf.queryExecution()
        ran.toRdd().count()
        leaves = ran.executedPlan().collectLeaves()
        return sum(
            leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())
        )


@pytest.fixture(scope="module")
def roots(spark, tmp_path_factory):
    found = {}
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.block.row.count.limit", "1000")
    conf.set("parquet.page.size", str(8 * 1024))
    try:
        for lookups in (None, 500):
            found[lookups] = str(tmp_path_factory.mktemp("lookups"))
            layers.load_days(many(spark).repartition(4, "departure_date"), found[lookups], lookups=lookups)
    finally:
        conf.unset("parquet.block.row.count.limit")
        conf.unset("parquet.page.size")
    return found


@pytest.mark.parametrize("table", [layers.sightings, layers.newest_sightings])
def test_a_service_is_found_in_few_row_groups(spark, roots, table):
    service = F.sha2(F.lit("77"), 256)
    wanted = spark.range(1).select(service).first()[0]
    read = {}
    # Pages are not skipped, so what is read are whole row groups.
    spark.conf.set("parquet.filter.columnindex.enabled", "false")
    try:
        for lookups, root in roots.items():
            frame = table(spark, root).filter(F.col("service_id") == wanted)
            assert frame.count() == DAYS
            read[lookups] = rows_scanned(spark, frame)
            missing = table(spark, root).filter(F.col("service_id") == "svc-none")
            if lookups:
                assert rows_scanned(spark, missing) == 0
    finally:
        spark.conf.unset("parquet.filter.columnindex.enabled")
    groups = sum(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in table(spark, roots[500]).inputFiles())
    assert groups > 20
    assert read[500] < read[None] / 3


def test_the_lookup_view_agrees(spark, roots):
    wanted = spark.range(1).select(F.sha2(F.lit("5"), 256)).first()[0]
    spec = FilterSpec(line_code=wanted)
    trends = [
        tuples(past.trend(past.past_services(layers.newest_sightings(spark, root), spec, AS_OF)))
        for root in roots.values()
    ]
    assert trends[0] == trends[1] and len(trends[0]) == DAYS


def test_curve_places(spark):
    rows = archive(spark, sighting(service_id=None, departure_date="never"), sighting())
    low, high = (row[0] for row in rows.select(curve()).collect())
    assert low == 0 < high < 1 << 10
