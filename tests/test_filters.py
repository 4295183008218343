from datetime import date

import pytest

from lastseen.operators.filters import FilterSpec, keep, scraped_around, scraped_since
from tests.rows import AS_OF, archive, at, sighting, tuples


def test_from_params_keeps_known_values_only():
    spec = FilterSpec.from_params(
        {
            "operators": "flix, nuego,acme",
            "product_type": "Seater,Tram",
            "corridor": "delhi to agra",
            "hr_from": "6",
            "hr_to": "24",
            "dep_from": "2026-06-01",
            "dep_to": "soon",
            "pbd_range": "d5-d30",
        }
    )
    assert spec.operators == ("flix", "nuego")
    assert spec.products == ("Seater",)
    assert spec.relation == "delhi to agra"
    assert (spec.hour_from, spec.hour_to) == (6, None)
    assert (spec.dep_from, spec.dep_to) == (None, None)
    assert spec.forward_days(AS_OF) == (date(2026, 6, 6), date(2026, 7, 1))


def test_relation_beats_corridor():
    spec = FilterSpec.from_params({"relation": "a to b", "corridor": "c to d", "region": "IN01"})
    assert spec.relation == "a to b"


def test_impossible_day_is_an_error():
    with pytest.raises(ValueError):
        FilterSpec.from_params({"dep_from": "2026-02-31", "dep_to": "2026-03-01"})


def test_unknown_day_range_means_the_whole_month():
    assert FilterSpec(day_range="d9").forward_days(AS_OF) == (date(2026, 6, 1), date(2026, 7, 1))


def test_explicit_days_override_the_range_forward_even_reversed():
    spec = FilterSpec(dep_from=date(2026, 6, 9), dep_to=date(2026, 6, 2))
    assert spec.forward_days(AS_OF) == (date(2026, 6, 9), date(2026, 6, 2))
    assert spec.past_range() is None


@pytest.fixture(scope="module")
def sightings(spark):
    return archive(
        spark,
        sighting(service_id="s1", relation_name="Delhi to Jaipur"),
        sighting(service_id="s2", relation_name="delhi to jaipur", travels_name="NueGo"),
        sighting(service_id="s3", relation_name="pune to goa", departure_time="2315"),
        sighting(service_id="s4", relation_name=None, departure_time="15:00"),
        sighting(
            service_id="4568ed20-be7c-4375-ac36-d901b4315de3-7", relation_name="delhi to shimla"
        ),
        sighting(service_id="s5", travels_name="Sharma Travels", relation_name="jaipur to delhi"),
        sighting(service_id="", travels_name=None, relation_name="jaipur to delhi"),
    )


def kept(frame, predicates):
    return [row[0] for row in tuples(keep(frame, predicates), "service_id")]


def test_relation_is_case_sensitive(sightings):
    assert kept(sightings, FilterSpec(relation="Delhi to Jaipur").place_rows()) == ["s1"]


def test_region_ignores_case_and_unknown_regions_filter_nothing(sightings):
    assert kept(sightings, FilterSpec(region=" in04 ").place_rows()) == ["", "s1", "s2", "s5"]
    assert FilterSpec(region="IN08").place_rows() == []


def test_relation_takes_precedence_over_region(sightings):
    spec = FilterSpec(relation="pune to goa", region="IN04")
    assert kept(sightings, spec.place_rows()) == ["s3"]


def test_line_code_or_service_id(sightings):
    line = "4568ed20-be7c-4375-ac36-d901b4315de3-7"
    assert kept(sightings, FilterSpec(line_code=" in0421b ").line_rows()) == [line]
    assert kept(sightings, FilterSpec(line_code="s2").line_rows()) == ["s2"]
    assert kept(sightings, FilterSpec(line_code="IN0421B").service_rows()) == []


def test_hour_range_needs_a_colon_and_both_ends(sightings):
    assert kept(sightings, FilterSpec(hour_from=11, hour_to=20).hour_rows()) == ["s4"]
    assert FilterSpec(hour_from=11).hour_rows() == []


def test_origin_hub_is_a_prefix(sightings):
    line = "4568ed20-be7c-4375-ac36-d901b4315de3-7"
    assert kept(sightings, FilterSpec(origin_hub="DELHI").hub_rows()) == [line, "s1", "s2"]


def test_operator_rows_always_apply(sightings):
    assert kept(sightings, [FilterSpec(operators=("nuego",)).operator_rows()]) == ["s2"]
    assert "s5" not in kept(sightings, [FilterSpec().operator_rows()])
    assert kept(sightings, [FilterSpec(operators=("acme",)).operator_rows()]) == kept(
        sightings, [FilterSpec().operator_rows()]
    )


def test_all_products_is_no_filter():
    assert FilterSpec(products=("Seater", "Sleeper", "Hybrid", "Volvo")).product_rows() is None
    assert FilterSpec(products=("Tram",)).product_rows() is None


def test_scrape_window_is_inclusive(spark):
    frame = archive(
        spark,
        sighting(service_id="edge", scrape_timestamp=at(30, 12, month=5)),
        sighting(service_id="old", scrape_timestamp=at(30, 11, month=5)),
        sighting(service_id="first", scrape_timestamp=at(30, 0, month=5)),
        sighting(service_id="early", scrape_timestamp=at(29, 23, month=5)),
        sighting(service_id="last", scrape_timestamp=at(16, 0)),
        sighting(service_id="late", scrape_timestamp=at(16, 1)),
    )
    assert kept(scraped_since(frame, AS_OF, 2), []) == ["edge", "last", "late"]
    # Midnight 15 days before the first day to midnight 15 days after the last.
    around = scraped_around(frame, (date(2026, 6, 14), date(2026, 6, 1)))
    assert kept(around, []) == ["edge", "first", "last", "old"]
