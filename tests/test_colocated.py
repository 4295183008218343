"""Tables bucketed by service are deduplicated and joined where they lie."""

import pytest
from pyspark.sql import functions as F

from lastseen import FilterSpec
from lastseen.operators.latest import latest_services, latest_verdicts, with_verdict
from lastseen.plans import history as past
from lastseen.sources.colocated import read_by_service, write_by_service
from tests.conftest import SF_DIRS
from tests.rows import AS_OF, setting, tuples
from tests.test_archive import plan
from verification import fixtures


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("by_service")
    frames = {
        "by_service_sightings": fixtures.inventory(spark, SF_DIRS["small"]),
        "by_service_verdicts": fixtures.verdicts(spark, SF_DIRS["small"]),
    }
    for name, frame in frames.items():
        write_by_service(frame, name, str(folder / name), buckets=16)
    yield [read_by_service(spark, name) for name in frames]
    for name in frames:
        spark.sql(f"DROP TABLE {name}")


def test_the_join_of_newest_rows_needs_no_exchange(spark, tables):
    sightings, verdicts = tables
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        joined = with_verdict(latest_services(sightings, "travels_name"), verdicts)
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert text.count("Bucketed: true") == 2
        raw = fixtures.inventory(spark, SF_DIRS["small"])
        slots = fixtures.verdicts(spark, SF_DIRS["small"])
        plain = with_verdict(latest_services(raw, "travels_name"), slots)
        assert "Exchange" in plan(plain)
        assert tuples(joined) == tuples(plain.select(joined.columns))


def test_past_views_take_the_table(spark, tables):
    sightings, verdicts = tables
    raw = fixtures.inventory(spark, SF_DIRS["small"])
    for spec in (FilterSpec(), FilterSpec(operators=("nuego",), products=("Sleeper",))):
        with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
            base = past.past_services(sightings, spec, AS_OF, verdicts=verdicts)
            assert "Exchange" not in plan(base)
        plain = past.past_services(raw, spec, AS_OF)
        assert tuples(past.trend(base)) == tuples(past.trend(plain))


def test_rows_without_a_service_are_left_out(tables):
    sightings, verdicts = tables
    nameless = F.col("relation_name").isNull() | F.coalesce(F.col("service_id"), F.lit("")).eqNullSafe("")
    assert sightings.filter(nameless).isEmpty() and not sightings.isEmpty()
    assert latest_verdicts(verdicts).count() == latest_verdicts(verdicts).distinct().count()
