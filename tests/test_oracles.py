"""Every registered query against its SQL, run by DuckDB on the same files."""

import math

import duckdb
import pytest

from lastseen.plans.departures import departures
from tests.conftest import SF_DIRS
from verification.fixtures import AS_OF, inventory
from verification.oracles import ORACLES
from verification.queries import EVERYTHING, QUERIES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    path = f"{SF_DIRS['medium']}/lineitem.parquet"
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}')")
    yield connection
    connection.close()


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


def test_composite_view_returns_every_departure_at_the_larger_scale(spark):
    base = departures(inventory(spark, SF_DIRS["large"]), EVERYTHING, AS_OF)
    with duckdb.connect() as connection:
        path = f"{SF_DIRS['large']}/lineitem.parquet"
        connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}')")
        compare(base["rows"], connection.execute(ORACLES["departures_detail"]))
    assert base["rows"].count() > 15_000


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    compare(QUERIES[name](spark, SF_DIRS["medium"]), duck.execute(ORACLES[name]))


def compare(frame, result):
    columns = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = canonical(columns, result.fetchall())
    assert expected, "the check must not be empty"
    assert canonical(frame.columns, frame.collect()) == expected
