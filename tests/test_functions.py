from datetime import date, datetime, timezone

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lastseen.functions import rules, times
from lastseen.functions.numbers import occupied_share, relative_change, round_to_tenth
from verification.oracles import PRODUCT_LABEL, PRODUCT_SQL

TEXTS = [
    None,
    "",
    "A/C Sleeper (2+1)",
    "A/C Seater (2+2)",
    "A/C Seater/Sleeper",
    "Semi Sleeper + Sleeper",
    "A/C Semi Sleeper (2+2)",
    "Semi Sleeper / Seater",
    "Semi Sleeper Sleeper Seater",
    "VOLVO Multi-Axle A/C Sleeper",
    "Volvo A/C Seater",
    "Electric Coach",
    "Semi Luxury",
]
SEATS = [None, 0, 30, 36, 40]
NAMES = {
    "FlixBus": "flix",
    "Flix Intrcity": "flix",
    "IntrCity SmartBus": "intrcity",
    "Zingbus Plus": "zingbus",
    "Zingbus Maxx": "other",
    "zingbus maxx nuego": "nuego",
    "NUEGO": "nuego",
    "FreshBus": "freshbus",
    "Laxmi Holidays": "laxmi",
    "LAXMI HOLIDAYS PVT LTD": "other",
    "Laxmi  Holidays": "other",
    "Sharma Travels": "other",
    "": "other",
    None: "other",
}


def evaluate(spark, values, column_type, expression):
    """Expression over a single column ``x``, in input order."""
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, x {column_type}")
    return [row.y for row in frame.select("i", expression.alias("y")).orderBy("i").collect()]


def test_operator_of_first_match_wins(spark):
    assert evaluate(spark, list(NAMES), "string", rules.operator_of(F.col("x"))) == list(
        NAMES.values()
    )


def test_operator_of_can_leave_unknown_names_null(spark):
    labels = evaluate(spark, list(NAMES), "string", rules.operator_of(F.col("x"), default=None))
    assert labels == [None if label == "other" else label for label in NAMES.values()]


def test_operator_filter_is_not_exclusive(spark):
    names = ["Flix Intrcity", "FlixBus", None]
    assert evaluate(spark, names, "string", rules.operated_by(F.col("x"), ["intrcity"])) == [
        True,
        False,
        None,
    ]


def test_operator_group(spark):
    assert evaluate(
        spark, ["FLIX India", "NueGo", None], "string", rules.operator_group(F.col("x"))
    ) == ["flix", "comp", "comp"]


@pytest.fixture(scope="module")
def buses(spark):
    pairs = [(seats, text) for seats in SEATS for text in TEXTS]
    return pairs, spark.createDataFrame(pairs, "total_seats long, bus_type string")


def in_duckdb(pairs, expression):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE bus (total_seats BIGINT, bus_type VARCHAR)")
    connection.executemany("INSERT INTO bus VALUES (?, ?)", pairs)
    return dict(
        ((seats, text), value)
        for seats, text, value in connection.execute(
            f"SELECT total_seats, bus_type, {expression} FROM bus"
        ).fetchall()
    )


def in_spark(frame, expression):
    rows = frame.select("total_seats", "bus_type", expression.alias("y")).collect()
    return {(row.total_seats, row.bus_type): row.y for row in rows}


def test_product_label_matches_written_out_rules(buses):
    pairs, frame = buses
    label = rules.product_of(F.col("total_seats"), F.col("bus_type"))
    assert in_spark(frame, label) == in_duckdb(pairs, PRODUCT_LABEL)


@pytest.mark.parametrize(
    "wanted", [("Sleeper",), ("Hybrid",), ("Seater",), ("Volvo",), ("Hybrid", "Volvo")]
)
def test_product_filter_is_three_valued(buses, wanted):
    pairs, frame = buses
    keep = rules.has_product(F.col("total_seats"), F.col("bus_type"), wanted)
    written = " OR ".join(PRODUCT_SQL[product] for product in wanted)
    ours, theirs = in_spark(frame, keep), in_duckdb(pairs, written)
    assert {k for k, v in ours.items() if v} == {k for k, v in theirs.items() if v}


def test_unknown_seat_count_has_a_label_but_passes_no_layout_filter(buses):
    _, frame = buses
    bus = frame.filter("total_seats IS NULL AND bus_type = 'A/C Seater/Sleeper'")
    seats, text = F.col("total_seats"), F.col("bus_type")
    assert bus.select(rules.product_of(seats, text)).first()[0] == "Hybrid"
    assert bus.filter(rules.has_product(seats, text, rules.PRODUCTS[:3])).count() == 0


def test_product_of_flags(spark):
    flags = [(True, False), (False, True), (True, True), (False, False), (None, True)]
    frame = spark.createDataFrame(flags, "a boolean, b boolean")
    labels = [r[0] for r in frame.select(rules.product_of_flags(F.col("a"), F.col("b"))).collect()]
    assert labels == ["Seater", "Sleeper", "Hybrid", "Unknown", "Unknown"]


def test_volvo_is_false_without_text(spark):
    assert evaluate(spark, ["VOLVO 9600", "Scania", None], "string", rules.is_volvo(F.col("x"))) == [
        True,
        False,
        False,
    ]


HOURS = {
    "23:15:00": (23, "18:00-23:59"),
    "05:59": (5, "00:00-05:59"),
    "2026-06-01 12:00:00": (12, "12:00-17:59"),
    "6:30": (None, "unknown"),
    "2315": (None, "unknown"),
    "TBD": (None, "unknown"),
    "xx:10": (None, "unknown"),
    "24:10": (24, "unknown"),
    "": (None, "unknown"),
    None: (None, "unknown"),
}


def test_departure_hour_and_band(spark):
    hour = times.departure_hour(F.col("x"))
    assert evaluate(spark, list(HOURS), "string", hour) == [h for h, _ in HOURS.values()]
    assert evaluate(spark, list(HOURS), "string", times.hour_band(hour)) == [
        b for _, b in HOURS.values()
    ]


def test_leading_hour_reads_the_first_two_characters(spark):
    texts = ["07:30", "6:30", "2026-06-01 05:00:00", None]
    assert evaluate(spark, texts, "string", times.leading_hour(F.col("x"))) == [7, None, 20, None]


def test_feed_date(spark):
    texts = ["05-May-2026", "5-May-2026", "05-MAY-2026", "31-Feb-2026", "2026-05-05", "", None]
    may = date(2026, 5, 5)
    assert evaluate(spark, texts, "string", times.feed_date(F.col("x"))) == [
        may, may, may, None, None, None, None,
    ]


def test_business_date_of_instants(spark):
    instants = [
        datetime(2026, 5, 31, 18, 29, tzinfo=timezone.utc),
        datetime(2026, 5, 31, 18, 30, tzinfo=timezone.utc),
    ]
    days = [date(2026, 5, 31), date(2026, 6, 1)]
    assert evaluate(spark, instants, "timestamp", times.business_date(F.col("x"))) == days
    assert [times.business_day(instant) for instant in instants] == days


def test_business_day_needs_a_time_zone():
    with pytest.raises(ValueError):
        times.business_day(datetime(2026, 6, 1))


@settings(
    max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.one_of(
            st.floats(-1e6, 1e6),
            st.integers(-20_000, 20_000).map(lambda n: n / 20),
            st.tuples(st.integers(0, 5000), st.integers(1, 5000)).map(lambda p: p[0] / p[1] * 100),
            st.integers(2**52, 2**57).map(lambda n: n / 16),
            st.floats(allow_nan=False, allow_infinity=False),
        ),
        min_size=200,
        max_size=400,
    )
)
def test_round_to_tenth_equals_python_round(spark, values):
    rounded = evaluate(spark, values, "double", round_to_tenth(F.col("x")))
    assert rounded == [round(value, 1) for value in values]


def test_round_to_tenth_judges_the_binary_value(spark):
    # 12.35 is stored just below the halfway point, 0.25 and 0.75 on it.
    values = [12.35, 0.25, 0.75, 0.35, -0.25, -0.04, 12.450000000000001]
    assert evaluate(spark, values, "double", round_to_tenth(F.col("x"))) == [
        12.3, 0.2, 0.8, 0.3, -0.2, 0.0, 12.5,
    ]


def test_null_results_of_divisions(spark):
    frame = spark.createDataFrame([(5, 0), (None, 4), (3, 4)], "a long, b long")
    shares = frame.select(
        occupied_share(F.col("a"), F.col("b")).alias("s"),
        relative_change(F.col("a"), F.col("b")).alias("c"),
    ).collect()
    assert [tuple(row) for row in shares] == [(None, None), (None, None), (0.25, -25.0)]


def test_operator_filter_names_its_column_once(spark):
    names = ["Flix", "zingbus Maxx", "Zingbus\nplus", "LAXMI HOLIDAYS\npvt", "laxmi holidays", "x", "", None]
    frame = spark.createDataFrame([(name,) for name in names], "name string")
    # A filter holds a copy of the expression behind the column for each time it is named.
    for labels in (rules.OPERATORS, ("zingbus",), ("laxmi", "nuego")):
        chosen = rules.operated_by(F.col("name"), labels)
        conditions = rules.operator_conditions(F.col("name"))
        separate = [F.coalesce(conditions[label], F.lit(False)) for label in labels]
        for row in frame.select("name", chosen.alias("one"), F.array(*separate).alias("each")).collect():
            assert row["one"] == (None if row["name"] is None else any(row["each"])), row
    text = frame.filter(chosen)._jdf.queryExecution().analyzed().toString()
    assert text.split("\n")[0].count("name#") == 1
