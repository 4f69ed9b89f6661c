"""Reports over hand-written rows: ties, gaps, repeated and missing values, empty input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseframe.model import Scope
from caseframe.operators import sizes
from caseframe.operators.places import named_district
from caseframe.operators.sizes import join_dimension
from caseframe.plans import (
    choices, deaths, districts, elements, maps, people, quality, rollup, summary, weekly)
from tests.frames import CODES, FLU, attributes, day, fact, org, rows_of


@pytest.fixture(scope="module")
def places(spark):
    return org(spark).cache()


# Dates and weeks -----------------------------------------------------------------------

def test_last_24h_is_two_calendar_days(spark):
    cases = fact(spark, [(1, 1, "2024-03-10", 1), (2, 1, "2024-03-09", 1), (2, 1, "2024-03-09", 1),
                         (3, 1, "2024-03-08", 1), (4, 1, None, 1)])
    assert rows_of(summary.cases_last_24h(cases, FLU)) == [(2,)]
    assert rows_of(summary.cases_last_24h(cases, FLU, as_of=dt.date(2024, 3, 9))) == [(2,)]
    assert rows_of(summary.cases_last_24h(cases, FLU, as_of="2024-03-08")) == [(1,)]


def test_weekly_change_runs_forward_in_time(spark):
    cases = fact(spark, [(i, 1, d, 1) for i, d in enumerate(
        ["2024-01-01"] * 4 + ["2024-01-08"] * 6 + ["2024-01-15"] * 3)])
    assert rows_of(weekly.weekly_table(cases, FLU)) == [
        (2024, 3, 3, 13, -50.0), (2024, 2, 6, 10, 50.0), (2024, 1, 4, 4, None)]
    assert rows_of(weekly.weekly_table(cases, FLU, compare="next")) == [
        (2024, 3, 3, 13, None), (2024, 2, 6, 10, 100.0), (2024, 1, 4, 4, -33.3)]
    assert rows_of(weekly.weekly_table(cases, FLU, weeks=1)) == [(2024, 3, 3, 13, -50.0)]
    with pytest.raises(ValueError):
        weekly.weekly_table(cases, FLU, compare="sideways")


def test_one_year_restarts_the_running_total(spark):
    cases = fact(spark, [(1, 1, "2023-12-20", 1), (2, 1, "2024-01-02", 1), (3, 1, "2024-01-09", 1)])
    assert rows_of(weekly.weekly_table_year(cases, FLU)) == [
        (2024, 2, 1, 2, 0.0), (2024, 1, 1, 1, None)]
    assert rows_of(weekly.weekly_table_year(cases, FLU, year=2024, weeks=1)) == [
        (2024, 2, 1, 1, None)]
    assert rows_of(weekly.weekly_table_year(cases, FLU, end=dt.date(2023, 12, 31))) == [
        (2023, 51, 1, 1, None)]


def test_last_days_of_a_year_may_belong_to_week_one(spark):
    cases = fact(spark, [(1, 1, "2024-12-30", 1), (2, 1, "2024-12-22", 1)])
    assert [r[:2] for r in rows_of(weekly.weekly_table(cases, FLU, by="rows"))] == [
        (2024, 51), (2024, 1)]
    assert [r[:2] for r in rows_of(weekly.weekly_table(cases, FLU, iso_year=True, by="rows"))] == [
        (2025, 1), (2024, 51)]
    assert [r[:2] for r in rows_of(weekly.weekly_table(cases, FLU))] == [(2025, 1), (2024, 51)]


def test_weeks_are_compared_by_distance(spark):
    """No change after a gap, and both ends of a year stay apart."""
    cases = fact(spark, [(i, 1, d, 1) for i, d in enumerate(
        ["2024-01-03"] * 2 + ["2024-01-15"] * 4 + ["2024-12-23"] * 2 + ["2024-12-31"] * 3)])
    assert rows_of(weekly.weekly_table(cases, FLU)) == [
        (2025, 1, 3, 11, 50.0), (2024, 52, 2, 8, None), (2024, 3, 4, 6, None), (2024, 1, 2, 2, None)]
    assert rows_of(weekly.weekly_table(cases, FLU, compare="next", weeks=2)) == [
        (2025, 1, 3, 11, None), (2024, 52, 2, 8, -33.3)]
    assert rows_of(weekly.weekly_table(cases, FLU, by="rows")) == [
        (2024, 52, 2, 11, -50.0), (2024, 3, 4, 9, -20.0), (2024, 1, 5, 5, None)]
    assert rows_of(weekly.weekly_table_year(cases, FLU, weeks=1)) == [(2025, 1, 3, 3, None)]
    with pytest.raises(ValueError):
        weekly.weekly_table(cases, FLU, by="months")


def test_contradicting_sexes_count_for_none(spark, places):
    cases = fact(spark, [(i, i, "2024-01-03", 1) for i in range(1, 4)])
    persons = attributes(spark, [(1, "SEX", "male"), (1, "SEX", "female"), (2, "SEX", "male"), (2, "SEX", "?"),
                                 (3, "SEX", "female"), *((i, "AGE", "7") for i in range(1, 4))])
    assert rows_of(weekly.weekly_by_sex(cases, places, persons, FLU, CODES)) == [(dt.date(2024, 1, 1), 1, 1)]
    assert rows_of(people.age_sex_by_name(
        cases, persons, FLU, age_words=("age",), sex_words=("sex",)))[0][1:] == (1, 1)


def test_moving_average_over_rows_or_weeks(spark, places):
    cases = fact(spark, [(i, 1, d, 1) for i, d in enumerate(
        ["2024-01-01"] * 5 + ["2024-01-17"] * 3)] + [(99, 1, "2024-01-17", 77)])
    assert rows_of(weekly.weekly_moving_average(cases, places, FLU)) == [
        (day("2024-01-15"), 3, 4.0), (day("2024-01-01"), 5, 5.0)]
    assert rows_of(weekly.weekly_moving_average(cases, places, FLU, fill_gaps=True)) == [
        (day("2024-01-15"), 3, 2.7), (day("2024-01-08"), 0, 2.5), (day("2024-01-01"), 5, 5.0)]


def test_weekly_by_sex_counts_an_event_once(spark, places):
    cases = fact(spark, [(1, 10, "2024-01-01", 1), (1, 10, "2024-01-03", 2), (2, 11, "2024-01-02", 1),
                         (3, 12, "2024-01-09", 1), (4, None, "2024-01-02", 1)])
    persons = attributes(spark, [(10, "SEX", "male"), (10, "SEX", "MALE"), (11, "SEX", "female"),
                                 (12, "SEX", "other")])
    assert rows_of(weekly.weekly_by_sex(cases, places, persons, FLU, CODES)) == [
        (day("2024-01-01"), 1, 1)]


def test_epicurves_keep_years_apart_and_match_the_ranking(spark, places):
    cases = fact(spark, [(1, 1, "2023-03-06", 1), (2, 1, "2024-03-04", 1), (3, 1, "2024-03-05", 1),
                         (4, 1, "2024-03-04", 3), (5, 1, "2023-03-04", 1)])
    assert rows_of(weekly.district_epicurves(cases, places, FLU)) == [
        ("North District", day("2023-03-06"), 10, 1), ("North District", day("2024-03-04"), 10, 2)]
    whole = weekly.district_epicurves(cases, places, FLU, year=2024)
    top = districts.top_districts(cases, places, FLU, scope=Scope(year=2024))
    assert whole.agg(F.sum("weekly_cases")).first()[0] == top.agg(F.sum("total_cases")).first()[0]


def test_weekly_shares_add_up(spark, places):
    cases = fact(spark, [(i, 1, "2024-01-02", 1 + (i % 3 == 0)) for i in range(9)])
    assert rows_of(weekly.district_weekly_share(cases, places, FLU)) == [
        (day("2024-01-01"), "North District", 66.67), (day("2024-01-01"), "South District", 33.33)]


# Districts -----------------------------------------------------------------------------

def outcome(event, told, element_name="Case outcome"):
    return (event, 1, "2024-01-02", 1, "OUT", element_name, told)


def test_ranking_counts_events_and_deaths_once(spark, places):
    cases = fact(spark, [
        (1, 1, "2024-01-09", 1), (1, 1, "2024-01-10", 1), (2, 1, "2024-01-02", 1),
        (3, 1, "2024-01-03", 1), (4, 1, "2024-01-09", 2), (5, 1, "2024-01-09", 3),
        (6, 1, "2024-01-09", 4), (7, 1, "2024-01-09", 5), (8, 1, None, 1), (9, 1, "2024-01-09", 77),
        outcome(1, "Died"), outcome(1, "death confirmed"), outcome(2, "Recovered"),
        outcome(3, "fatal", "Final result"), outcome(4, "Died", "Remark")])
    ranking = districts.top_districts(cases, places, FLU)
    assert rows_of(ranking) == [("North District", 3, 2, 1, 1, -50.0),
                                ("South District", 1, 0, 1, 0, None)]
    assert rows_of(districts.top_districts_totals(ranking)) == [
        ("North District", 3, 2, 1, 1, -50.0), ("South District", 1, 0, 1, 0, None),
        ("TOTAL", 4, 2, 2, 1, None)]
    named = districts.top_districts(cases, places, FLU, outcome_elements=["OUT"])
    assert rows_of(named) == rows_of(ranking)


def test_latest_week_may_span_the_new_year(spark, places):
    cases = fact(spark, [(1, 1, "2020-12-29", 1), (2, 1, "2021-01-02", 1), (3, 1, "2020-12-22", 1)])
    assert rows_of(districts.top_districts(cases, places, FLU)) == [
        ("North District", 3, 0, 2, 0, 100.0)]


def test_ties_are_broken_by_name(spark):
    three = org(spark, [(1, "C", "R"), (2, "A", "R"), (3, "B", "R")])
    cases = fact(spark, [(i, 1, "2024-01-01", 1 + i % 3) for i in range(6)])
    assert [r[0] for r in rows_of(districts.top_districts(cases, three, FLU, k=2))] == ["A", "B"]
    assert rows_of(districts.district_total_share(cases, three, FLU, k=2)) == [
        ("A", 2, 33.33), ("B", 2, 33.33)]


def test_reporting_uses_one_rule_for_both_counts(spark, places):
    cases = fact(spark, [(1, 1, "2024-01-20", 1), (2, 1, "2024-01-20", 3), (3, 1, "2024-01-20", 4),
                         (4, 1, "2024-01-01", 2)])
    assert rows_of(districts.district_reporting(cases, places, FLU)) == [(2, 2, 0, 100.0, 0.0)]
    assert rows_of(districts.district_reporting(cases, places, FLU, hours=24)) == [
        (2, 1, 1, 50.0, 50.0)]
    assert rows_of(districts.district_reporting(cases, places, FLU, days=19)) == [
        (2, 2, 0, 100.0, 0.0)]
    assert rows_of(districts.district_reporting(cases, places, FLU, days=21, as_of="2024-01-19")) \
        == [(2, 1, 1, 50.0, 50.0)]
    nowhere = Scope("region", "Sideways")
    assert rows_of(districts.district_reporting(cases, places, FLU, scope=nowhere)) == [
        (0, 0, 0, None, None)]


def test_place_names_are_plain_text(spark):
    odd = org(spark, [(1, "50% District", "R_1"), (2, "50 District", "RX1")])
    cases = fact(spark, [(1, 1, "2024-01-01", 1), (2, 1, "2024-01-01", 2)])

    def counted(scope):
        return rows_of(maps.map_cumulative_cases(cases, odd, FLU, scope=scope))

    assert counted(Scope("district", "50%")) == [("50% District", 1)]
    assert counted(Scope("region", "r_1")) == [("50% District", 1)]
    assert counted(Scope("district", "' OR 1=1 --")) == []


def test_summary_counts_undated_cases_and_applies_dates(spark, places):
    cases = fact(spark, [(1, 1, "2024-03-01", 1), (2, 1, "2024-02-20", 2), (3, 1, None, 3),
                         (4, 1, "2023-01-01", 77), (1, 1, "2024-03-01", 2)])
    assert rows_of(summary.summary_stats(cases, places, FLU)) == [(3, 3, 1, 2)]
    assert rows_of(summary.summary_stats(cases, places, FLU, scope=Scope(end=dt.date(2024, 2, 28)))) \
        == [(1, 1, 0, 1)]


def test_no_figure_counts_cases_after_the_day(spark, places):
    cases = fact(spark, [(1, 1, "2024-01-03", 1), (2, 2, "2024-12-31", 1), (3, 3, "2024-06-01", 2),
                         (4, 1, None, 1)])
    assert rows_of(summary.summary_stats(cases, places, FLU, as_of="2024-02-01")) == [(2, 1, 0, 1)]
    assert rows_of(districts.district_line_summary(cases, places, FLU, as_of="2024-02-01")) == [
        ("North District", 1, 1, dt.date(2024, 1, 3), dt.date(2024, 1, 3))]


def test_sexes_that_contradict_are_unknown(spark, places):
    cases = fact(spark, [(k, k, "2024-01-03", 1) for k in (1, 2, 3, 4)])
    persons = attributes(spark, [(1, "SEX", "male"), (1, "SEX", "female"), (2, "SEX", "female"),
                                 (2, "SEX", "n/a"), (3, "SEX", "male"), (3, "SEX", "MALE")])
    assert rows_of(people.gender_distribution(cases, places, persons, FLU, CODES)) == [
        ("Male", 1), ("Female", 1), ("Unknown", 2)]


def test_executive_summary(spark, places):
    cases = fact(spark, [(1, 1, "2024-01-02", 1), (2, 2, "2024-01-09", 1), (3, 3, "2024-01-09", 2),
                         (4, 4, "2024-01-08", 77)])
    persons = attributes(spark, [(1, "D", "yes", "Death reported"), (2, "D", "no", "Death reported"),
                                 (9, "D", "dead", "Death reported")])
    row = summary.executive_summary(cases, places, persons, FLU).first().asDict()
    assert row == {"total_cases": 4, "cases_last_24h": 3, "deaths": 1, "cfr_pct": 25.0,
                   "affected_districts": 2, "top_district": "North District",
                   "top_district_cases": 2, "trend": "Increasing"}


def test_executive_summary_counts_every_district_up_to_a_day(spark):
    places = org(spark, [(k, f"District {k:02d}", "R") for k in range(20)])
    cases = fact(spark, [(k, k, "2024-01-03", k) for k in range(20)]
                 + [(100 + k, k, "2024-12-24", 1) for k in range(2)]
                 + [(200 + k, k, "2024-12-31", 1) for k in range(5)])
    nobody = attributes(spark, [])
    row = summary.executive_summary(cases, places, nobody, FLU).first()
    assert (row.affected_districts, row.total_cases, row.trend) == (20, 27, "Increasing")
    row = summary.executive_summary(cases, places, nobody, FLU, as_of=dt.date(2024, 2, 1)).first()
    assert (row.total_cases, row.top_district_cases, row.cases_last_24h) == (20, 1, 0)


def test_a_large_dimension_keeps_equal_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    table = spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    for limit in (0, 10):
        assert join_dimension(rows, table, table, "k", limit=limit).count() == 3


def test_reporting_of_zero_days_is_the_last_day(spark, places):
    cases = fact(spark, [(1, 1, "2024-01-02", 1), (2, 2, "2024-01-09", 2)])
    assert districts.district_reporting(cases, places, FLU, days=0).first().districts_with_cases == 1


# Persons -------------------------------------------------------------------------------

def test_incident_cases_take_the_first_date_ever(spark, places):
    cases = fact(spark, [(1, 1, "2023-12-31", 1), (2, 1, "2024-01-05", 1), (3, 1, "2024-01-05", 2),
                         (4, 2, "2024-02-01", 77), (5, None, "2024-02-01", 1)])
    persons = attributes(spark, [(1, "SEX", "Female"), (1, "AGE", "7"), (1, "AGE", "30"),
                                 (2, "SEX", "unsure")])
    assert rows_of(people.gender_distribution(cases, places, persons, FLU, CODES)) == [
        ("Female", 2), ("Unknown", 1)]
    in_2024 = Scope(year=2024)
    assert rows_of(people.gender_distribution(cases, places, persons, FLU, CODES, scope=in_2024)) \
        == [("Female", 1), ("Unknown", 1)]
    assert rows_of(people.age_sex_distribution(cases, places, persons, FLU, CODES)) == [
        ("5-9", 0, 2, 0), ("Unknown", 0, 0, 1)]
    up = Scope("region", "up")
    assert rows_of(people.gender_distribution(cases, places, persons, FLU, CODES, scope=up)) == [
        ("Female", 1), ("Unknown", 0)]


def test_percentages_have_a_total_row(spark, places):
    cases = fact(spark, [(i, i, "2024-01-01", 1) for i in range(8)])
    persons = attributes(spark, [(i, "SEX", "male") for i in range(3)]
                         + [(i, "AGE", "3") for i in range(6)])
    counted = people.age_sex_distribution(cases, places, persons, FLU, CODES)
    assert sorted(rows_of(people.age_sex_percentages(counted))) == [
        ("0-4", 6, 75.0, 3, 100.0, 0, 0.0, 3, 60.0),
        ("TOTAL", 8, 100.0, 3, 100.0, 0, 0.0, 5, 100.0),
        ("Unknown", 2, 25.0, 0, 0.0, 0, 0.0, 2, 40.0)]


def test_rates_need_a_population(spark, places):
    cases = fact(spark, [(i, i, "2024-01-01", 1) for i in range(4)])
    persons = attributes(spark, [(0, "SEX", "male"), (0, "AGE", "3"), (1, "SEX", "male"),
                                 (1, "AGE", "60"), (2, "SEX", "male"), (2, "AGE", "61")])
    assert rows_of(people.age_sex_rate(cases, places, persons, FLU, CODES)) == [
        ("0-4", 0, 1, None, 33333.33), ("50+", 0, 2, None, 66666.67), ("Unknown", 0, 0, None, 0.0)]
    population = spark.createDataFrame(
        [("North District", "Male", "0-4", 400), ("South District", "Male", "0-4", 600),
         ("North District", "Female", "0-4", 500)],
        "district_name string, sex string, age_group string, population bigint")
    assert rows_of(people.age_sex_rate(cases, places, persons, FLU, CODES, population=population)) \
        == [("0-4", 0, 1, 0.0, 100.0), ("50+", 0, 2, None, None), ("Unknown", 0, 0, None, None)]
    assert rows_of(maps.map_attack_rate(cases, places, FLU, population=population)) == [
        ("North District", 4, 444.44)]
    assert rows_of(maps.map_attack_rate(cases, places, FLU)) == [("North District", 4, 400.0)]
    assert rows_of(maps.map_case_rate_21d(cases, places, FLU)) == [("North District", 4, 800.0)]


def test_ages_by_attribute_name(spark):
    cases = fact(spark, [(1, 1, "2024-01-01", 1), (2, 2, "2024-01-01", 1), (3, 3, None, 1)])
    persons = attributes(spark, [
        (1, "a", "7", "Age (years)"), (1, "b", "31", "AGE at death"), (1, "c", "M", "Gender"),
        (2, "a", "9", "Age (years)"), (2, "d", "Lakeside", "Village"), (2, "c", "2", "Sex"),
        (3, "a", "9", "Age (years)"), (4, "a", "9", "Age (years)")])
    assert rows_of(people.age_sex_by_name(cases, persons, FLU)) == [("5-9", 1, 1), ("30-39", 1, 0)]


def test_demographics_take_one_value_per_event(spark):
    def told(event, name, value):
        return (event, 1, "2024-01-01", 1, name, name, value)

    cases = fact(spark, [
        *((e, 1, "2024-01-01", 1) for e in range(1, 7)), (7, 1, "2023-01-01", 1),
        told(1, "Date of birth", "2000-01-01"), told(1, "Date of birth", "2010-01-01"),
        told(1, "Age", "70"), told(1, "Sex", "male"),
        told(2, "Age", "8 months"), told(2, "Gender", "Female"),
        told(3, "Age", "unclear"), told(4, "Sex", "male"), told(5, "DOB", None), told(5, "Age", "44"),
        told(6, "DOB", "bad"), told(6, "Age", "44"), told(6, "Was pregnant if female", "no"),
        told(7, "Age", "5"), told(8, "Age", "5")])
    got = rows_of(people.demographic_breakdown(cases, FLU, as_of=dt.date(2024, 1, 1)))
    assert got == [("<1 year", 1, 16.7, 0, 0.0, 1, 100.0), ("5-14 years", 2, 33.3, 1, 100.0, 0, 0.0),
                   ("15-44 years", 1, 16.7, 0, 0.0, 0, 0.0), ("Unknown", 2, 33.3, 0, 0.0, 0, 0.0)]
    cut = people.demographic_breakdown(cases, FLU, scope=Scope(year=2023))
    assert rows_of(cut) == [("5-14 years", 1, 100.0, 0, 0.0, 0, 0.0)]


# Deaths --------------------------------------------------------------------------------

def test_death_reports(spark, places):
    cases = fact(spark, [(1, 1, "2024-01-01", 1), (1, 1, "2024-01-01", 1), (2, 1, "2024-01-05", 2),
                         (3, 2, "2024-01-01", 1), (4, 3, "2024-01-01", 1), (5, 4, None, 3),
                         (6, None, "2024-01-01", 1)])
    persons = attributes(spark, [
        (1, "OUT", "DEAD"), (1, "OUT", "alive"), (1, "AGE", "0"), (1, "SEX2", "female"),
        (2, "OUT", "dead"), (2, "AGE", "n/a"), (2, "SEX2", "male"),
        (3, "OUT", "Alive"), (3, "AGE", "9"), (4, "OUT", "dead"), (4, "AGE", "50"),
        (1, "D", "found dead", "Death details"), (3, "D", "yes", "death")])
    assert rows_of(deaths.deaths_by_district(cases, places, persons, FLU, CODES)) == [
        ("North District", 2), ("South District", 1)]
    by_district = deaths.deaths_by_district(
        cases, places, persons, FLU, CODES, keep=named_district())
    assert rows_of(by_district) == [("North District", 2), ("South District", 1), ("Unknown", 1)]
    assert rows_of(deaths.mortality_summary(by_district)) == [(4, "North District", 3)]
    assert rows_of(deaths.deaths_by_district(
        cases, places, persons, FLU, CODES, scope=Scope(year=2024, month=1, end=dt.date(2024, 1, 2)))
    ) == [("North District", 2)]
    assert rows_of(deaths.deaths_by_district_text(cases, places, persons, FLU)) == [
        ("North District", 2), ("South District", 1)]
    assert rows_of(deaths.total_deaths(cases, persons, FLU)) == [(2,)]

    def by_age(unit, scope=Scope()):
        return rows_of(deaths.deaths_by_age(cases, places, persons, FLU, CODES, unit=unit,
                                            scope=scope))

    assert by_age("rows") == [("<1 year", 3), ("45+ years", 1)]
    assert by_age("events") == [("<1 year", 2), ("45+ years", 1)]
    assert by_age("persons") == [("<1 year", 1), ("45+ years", 1)]
    up = Scope("region", "Up")
    assert by_age("rows", up) == [("<1 year", 2)]
    assert by_age("events", up) == [("<1 year", 1)]
    with pytest.raises(ValueError):
        by_age("households")
    assert rows_of(deaths.deaths_by_age_sex(cases, places, persons, FLU, CODES)) == [("0-4", 0, 3)]


# Places, elements, quality -------------------------------------------------------------

def test_choices(spark, places):
    cases = fact(spark, [(1, 1, "2024-01-01", 2), (2, 1, "2024-01-09", 2), (3, 1, "2023-12-01", 3),
                         (4, 1, None, 1)])
    assert rows_of(choices.location_options(cases, places, FLU, districts=2)) == [
        (1, "national", "National"), (2, "region", "Down Region"), (3, "region", "Up Region"),
        (4, "district", "South District"), (5, "district", "North District")]
    assert rows_of(choices.hierarchical_locations(places)) == [
        (1, "National Level"), (2, "North District"), (3, "South District")]
    assert rows_of(choices.time_period_options(cases, FLU)) == [
        (2024, 1, "January", 2, "January 2024"), (2023, 12, "December", 1, "December 2023")]
    nested = choices.time_period_options(cases, FLU, nested=True).collect()
    assert [(row.year, [(m.month, m.name, m.cases) for m in row.months]) for row in nested] == [
        (2024, [(1, "January", 2)]), (2023, [(12, "December", 1)])]


def test_element_profiles(spark):
    cases = fact(spark, [(e, 1, "2024-01-01", 1) for e in (1, 2, 3)]
                 + [(1, 1, "2024-01-01", 1, "A", "Age", "7"), (2, 1, "2024-01-01", 1, "A", "Age", "9"),
                    (1, 1, "2024-01-01", 1, "A", "Age", None), (3, 1, "2024-01-01", 1, "A", "Age", "1"),
                    (1, 1, "2024-01-01", 1, "S", "SEX", "x" * 60), (9, 1, "2024-01-01", 1, "A", "Age", "5")])
    got = elements.profile_demographic_sample(cases, FLU, events=2, width=50)
    assert rows_of(got) == [("Age", 2, 2, "7 | 9"), ("SEX", 1, 1, "x" * 50)]
    assert rows_of(elements.profile_demographic_elements(cases, FLU)) == [("Age", 3, 3), ("SEX", 1, 1)]
    assert sorted(rows_of(elements.profile_demographic_values(cases, FLU)), key=str) == [
        ("Age", "1", 1), ("Age", "7", 1), ("Age", "9", 1), ("Age", None, 1), ("SEX", "x" * 60, 1)]
    assert rows_of(elements.profile_all_elements(cases, FLU, k=2)) == [("Age", 3), ("Diagnosis", 3)]


def test_element_profiles_deal_more_rows_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(elements, "TASK_ROWS", 20, raising=False)
    cases = fact(spark, [(e, 1, "2024-01-01", 1) for e in range(100)]
                 + [(e, 1, "2024-01-01", 1, "A", "Age", str(e % 9)) for e in range(200)]
                 + [(7, 1, "2024-01-01", 1, "A", "Age", "3")] * 50)
    rows = elements._of_events(cases, FLU, None)
    held = rows.groupBy(F.spark_partition_id()).agg(F.count_distinct("event_id").alias("n")).collect()
    assert len(held) > 4 and sum(row.n for row in held) == 100
    assert rows_of(elements.profile_all_elements(cases, FLU)) == [("Age", 100), ("Diagnosis", 100)]
    assert rows_of(elements.profile_demographic_elements(cases, FLU)) == [("Age", 100, 9)]
    values = elements.profile_demographic_values(cases, FLU)
    assert sum(row.event_count for row in values.collect()) == 101  # event 7 has two values


def test_quality_checks(spark, places):
    cases = fact(spark, [(1, 1, "2024-01-01", 1), (1, 1, "2024-01-02", 1), (2, 1, "2024-01-01", 1),
                         (2, 1, "2024-01-01", 1), (3, 1, "2024-01-01", 77), (3, 1, "2024-01-01", 77),
                         (4, 1, "2024-01-01", None), (5, 1, "2024-01-01", 1), (5, 2, "2024-01-01", 2)])
    assert sorted(rows_of(quality.dq_multi_date_events(cases, FLU))) == [(1, 2, 1, 1), (5, 1, 2, 2)]
    assert sorted(rows_of(quality.dq_orphan_keys(cases, places, FLU)), key=str) == [
        (77, 2, 1), (None, 1, 1)]
    persons = attributes(spark, [(1, "A", "1"), (1, "A", "1"), (1, "B", "1"), (2, "A", "x"),
                                 (2, "A", None), (2, "A", "y")])
    assert sorted(rows_of(quality.dq_duplicate_attributes(persons))) == [
        (1, "A", 2, 1), (2, "A", 3, 2)]
    shapes = spark.createDataFrame([("North District",), ("Lake",)], "name string")
    assert sorted(rows_of(quality.dq_unmatched_geo(shapes, places))) == [
        ("2 Test District", "hierarchy"), ("Lake", "map"), ("South District", "hierarchy"),
        ("Unknown", "hierarchy")]


def test_map_layer_gives_every_shape_a_value(spark, places):
    cases = fact(spark, [(i, 1, "2024-01-01", 1) for i in range(12)])
    shapes = spark.createDataFrame([("North District",), ("Lake",)], "name string")
    values = maps.map_cumulative_cases(cases, places, FLU)
    from caseframe.functions.bands import CUMULATIVE_CASES, CURRENT_RATE
    layer = maps.map_layer(shapes, values, "total_cases", CUMULATIVE_CASES)
    assert sorted(rows_of(layer)) == [("Lake", 0, 500), ("North District", 12, 500)]
    assert sorted(rows_of(maps.map_bins(layer, "value", CUMULATIVE_CASES))) == [
        ("Lake", 0, 500, 0, "0"), ("North District", 12, 500, 2, "10-49")]
    high = maps.map_layer(shapes, values, "total_cases", CURRENT_RATE)
    assert {row.scale_max for row in high.collect()} == {12}


# Whole-report properties ---------------------------------------------------------------

def test_copies_of_a_row_change_nothing(spark, places):
    rows = [(i, i % 7, f"2024-0{1 + i % 5}-1{i % 9}", 1 + i % 4) for i in range(60)]
    persons = attributes(spark, [(i, "SEX", "male" if i % 2 else "Female") for i in range(7)]
                         + [(i, "AGE", str(9 * i)) for i in range(7)]
                         + [(i, "OUT", "dead") for i in range(3)])
    once, thrice = fact(spark, rows), fact(spark, rows * 3)
    for report in (
            lambda f: weekly.weekly_table(f, FLU), lambda f: districts.top_districts(f, places, FLU),
            lambda f: summary.summary_stats(f, places, FLU),
            lambda f: weekly.weekly_by_sex(f, places, persons, FLU, CODES),
            lambda f: people.age_sex_distribution(f, places, persons, FLU, CODES),
            lambda f: deaths.deaths_by_age(f, places, persons, FLU, CODES, unit="events"),
            lambda f: rollup.daily_rollup(f, persons, FLU, CODES).orderBy("event_date", F.expr("2"))):
        assert sorted(map(str, rows_of(report(once)))) == sorted(map(str, rows_of(report(thrice))))


def test_totals_agree_across_reports(spark, places):
    rows = [(i, i, f"2024-0{1 + i % 5}-1{i % 9}", 1 + i % 2) for i in range(80)]
    cases, persons = fact(spark, rows), attributes(spark, [
        (i, "SEX", ("male", "female", "?")[i % 3]) for i in range(80)])
    total = 80
    by_sex = people.age_sex_distribution(cases, places, persons, FLU, CODES)
    assert sum(sum(row[1:]) for row in rows_of(by_sex)) == total
    assert rows_of(weekly.weekly_table(cases, FLU))[0][3] == total
    assert sum(row[1] for row in rows_of(maps.map_cumulative_cases(cases, places, FLU))) == total
    shares = rows_of(districts.district_total_share(cases, places, FLU))
    assert sum(row[2] for row in shares) == pytest.approx(100, abs=0.05)


def test_rollup_reports_equal_direct_ones(spark, places):
    rows = [(i, i, f"2024-0{1 + i % 5}-1{i % 9}", 1 + i % 4) for i in range(80)]
    rows += [outcome(i, "Died") for i in range(0, 80, 9)]
    cases, persons = fact(spark, rows), attributes(spark, [(i, "AGE", str(i)) for i in range(80)])
    rollup.require_additive(cases, FLU)
    daily = rollup.daily_rollup(cases, persons, FLU, CODES)
    assert rows_of(rollup.weekly_table_from_rollup(daily)) == rows_of(weekly.weekly_table(cases, FLU))
    assert rows_of(rollup.top_districts_from_rollup(daily, places)) == rows_of(
        districts.top_districts(cases, places, FLU))
    assert rows_of(rollup.map_cumulative_from_rollup(daily, places)) == rows_of(
        maps.map_cumulative_cases(cases, places, FLU))
    with pytest.raises(rollup.NotAdditive):
        rollup.require_additive(fact(spark, rows + [(5, 5, "2022-01-01", 1)]), FLU)


def test_large_dimensions_are_salted(spark, places, monkeypatch):
    rows = [(i % 50, i % 9, f"2024-0{1 + i % 5}-1{i % 9}", 1 + (i % 3 == 0) * (i % 4))
            for i in range(300)]
    cases = fact(spark, rows)
    persons = attributes(spark, [(i, "OUT", "dead") for i in range(4)]
                         + [(i, "AGE", "8") for i in range(9)])

    def reports():
        return [rows_of(districts.top_districts(cases, places, FLU)),
                rows_of(weekly.weekly_moving_average(cases, places, FLU)),
                rows_of(summary.summary_stats(cases, places, FLU)),
                rows_of(deaths.deaths_by_age(cases, places, persons, FLU, CODES,
                                             scope=Scope("region", "Up"))),
                rows_of(people.gender_distribution(cases, places, persons, FLU, CODES,
                                                   scope=Scope("region", "Up"))),
                rows_of(quality.dq_orphan_keys(cases, places, FLU))]

    broadcast = reports()
    monkeypatch.setattr(sizes, "within_rows", lambda table, limit=0: False)
    assert reports() == broadcast


def test_size_check_reads_no_further_than_its_limit(spark):
    table = spark.range(10)
    assert not sizes.within_rows(table, 5)
    assert sizes.within_rows(table, 10)
    assert sizes.within_rows(table, 11)
    assert not sizes.within_rows(table, 9)


@pytest.mark.parametrize("report", [
    lambda f, a, o: weekly.weekly_table(f, FLU),
    lambda f, a, o: weekly.weekly_table_year(f, FLU),
    lambda f, a, o: weekly.weekly_moving_average(f, o, FLU, fill_gaps=True),
    lambda f, a, o: weekly.weekly_by_sex(f, o, a, FLU, CODES),
    lambda f, a, o: weekly.district_epicurves(f, o, FLU),
    lambda f, a, o: weekly.district_weekly_share(f, o, FLU),
    lambda f, a, o: districts.top_districts(f, o, FLU),
    lambda f, a, o: districts.district_total_share(f, o, FLU),
    lambda f, a, o: districts.district_line_summary(f, o, FLU),
    lambda f, a, o: people.gender_distribution(f, o, a, FLU, CODES),
    lambda f, a, o: people.age_sex_rate(f, o, a, FLU, CODES),
    lambda f, a, o: people.age_sex_by_name(f, a, FLU),
    lambda f, a, o: people.demographic_breakdown(f, FLU),
    lambda f, a, o: deaths.deaths_by_age_sex(f, o, a, FLU, CODES),
    lambda f, a, o: maps.map_case_rate_21d(f, o, FLU),
    lambda f, a, o: elements.profile_demographic_elements(f, FLU),
    lambda f, a, o: rollup.daily_rollup(f, a, FLU, CODES),
])
def test_no_cases_give_no_rows(spark, places, report):
    assert report(fact(spark, []), attributes(spark, []), places).collect() == []


def test_no_cases_give_one_row_of_zeros(spark, places):
    none, nobody = fact(spark, []), attributes(spark, [])
    assert rows_of(summary.cases_last_24h(none, FLU)) == [(0,)]
    assert rows_of(summary.summary_stats(none, places, FLU)) == [(0, 0, 0, 0)]
    assert rows_of(deaths.total_deaths(none, nobody, FLU)) == [(0,)]
    assert rows_of(summary.executive_summary(none, places, nobody, FLU)) == [
        (0, 0, 0, 0.0, 0, None, 0, "Stable")]
    assert rows_of(deaths.mortality_summary(
        deaths.deaths_by_district(none, places, nobody, FLU, CODES))) == [(0, None, 0)]
