import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseframe.functions import bands, dates, ratios, text
from caseframe.model import ReportParams, Scope


def values(spark, inputs, kind, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    rows = frame.orderBy("i").select(*(column(F.col("v")) for column in columns)).collect()
    return [row[0] if len(columns) == 1 else tuple(row) for row in rows]


def test_epi_weeks_around_new_year(spark):
    days = [dt.date(2020, 12, 31), dt.date(2021, 1, 3), dt.date(2021, 1, 4), dt.date(2024, 12, 30)]
    got = values(spark, days, "date", dates.epi_year, dates.epi_week,
                 lambda d: dates.epi_year(d, iso_year=True), dates.week_start)
    assert got == [(2020, 53, 2020, dt.date(2020, 12, 28)), (2021, 53, 2020, dt.date(2020, 12, 28)),
                   (2021, 1, 2021, dt.date(2021, 1, 4)), (2024, 1, 2025, dt.date(2024, 12, 30))]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.dates(dt.date(1900, 1, 1), dt.date(2100, 12, 31)), min_size=50, max_size=80))
def test_weeks_agree_with_the_iso_calendar(spark, days):
    got = values(spark, days, "date", lambda d: dates.epi_year(d, iso_year=True), dates.epi_week,
                 dates.week_start)
    assert got == [(*day.isocalendar()[:2], day - dt.timedelta(days=day.weekday()))
                   for day in days]


@pytest.mark.parametrize("birth, reference, age", [
    ("2004-02-29", "2023-02-28", 18), ("2004-02-29", "2024-02-29", 20),
    ("2004-12-31", "2024-01-01", 19), ("2004-01-01", "2024-01-01", 20)])
def test_completed_years(spark, birth, reference, age):
    got = values(spark, [dt.date.fromisoformat(birth)], "date",
                 lambda b: dates.age_in_years(b, F.lit(dt.date.fromisoformat(reference))))
    assert got == [age]


def test_age_text(spark):
    inputs = ["2001-05-06", "2001-05-06T00:00", "06/05/2001", "31/31/2001", "37", "8 months",
              "3 weeks", "25 years", "25 years 3", "99999999999", "n/a", None]
    reference = F.lit(dt.date(2011, 5, 6))
    assert values(spark, inputs, "string", lambda v: text.age_from_text(v, reference)) == [
        10, 10, 10, None, 37, 0, 0, 25, 25, None, None, None]


def test_sex_text(spark):
    inputs = ["Male", "FEMALE", "m", "2", "female child", "other", None]
    M, W, U = text.MALE, text.FEMALE, text.UNKNOWN_SEX
    assert values(spark, inputs, "string", text.sex_by_substring) == [M, W, U, U, W, U, U]
    assert values(spark, inputs, "string", text.sex_by_word) == [M, W, U, U, U, U, U]
    assert values(spark, inputs, "string",
                  lambda v: text.sex_by_word(v, short_codes=True)) == [M, W, M, W, U, U, U]
    assert values(spark, inputs[:2], "string",
                  lambda v: text.sex_label(text.sex_by_substring(v))) == ["Male", "Female"]


def test_death_text(spark):
    got = values(spark, ["Yes", "no", "found DEAD", None], "string",
                 lambda v: text.death_attribute(F.lit("Cause of Death"), v),
                 lambda v: text.death_attribute(F.lit("Village"), v),
                 lambda v: text.death_outcome(F.lit("Case outcome"), v))
    assert got == [(True, False, False), (False, False, False), (True, False, False),
                   (None, False, None)]
    assert values(spark, ["Fatal", "died", "Recovered"], "string",
                  lambda v: text.death_outcome(F.lit("Final status"), v)) == [True, True, False]


def test_whole_numbers(spark):
    assert values(spark, ["7", "-7", "7 years", "99999999999", "", None], "string",
                  text.whole_number) == [7, None, None, None, None, None]


def test_age_bands(spark):
    scheme = bands.FIVE_BANDS
    assert values(spark, [-1, 0, 1, 4, 5, 14, 15, 44, 45, 120, None], "int",
                  lambda a: scheme.label(scheme.index(a))) == [
        "<1 year", "<1 year", "1-4 years", "1-4 years", "5-14 years", "5-14 years",
        "15-44 years", "15-44 years", "45+ years", "45+ years", "Unknown"]


@pytest.mark.parametrize("scheme", [bands.EIGHT_BANDS, bands.TEN_BANDS, bands.ELEVEN_BANDS])
def test_band_labels_cover_their_ages(spark, scheme):
    ages = list(range(0, 60))
    for age, label in zip(ages, values(spark, ages, "int", lambda a: scheme.label(scheme.index(a)))):
        low, _, high = label.rstrip("+").partition("-")
        assert int(low) <= age <= int(high or 200)


def test_value_classes_have_no_gaps(spark):
    classes = bands.ATTACK_RATE
    assert values(spark, [None, 0.0, 0.05, 4.95, 5.0, 10.99, 11.0, 15.95, 16.0, 20.95, 21.0],
                  "double", lambda v: classes.label(classes.index(v))) == [
        "0", "0", "0.1-4.9", "0.1-4.9", "5-10.9", "5-10.9", "11-15.9", "11-15.9", "16-20.9",
        "16-20.9", "21+"]
    counts = bands.CUMULATIVE_CASES
    assert values(spark, [0, 1, 9, 10, 49, 50, 99, 100, 499, 500], "bigint",
                  lambda v: counts.label(counts.index(v))) == [
        "0", "1-9", "1-9", "10-49", "10-49", "50-99", "50-99", "100-499", "100-499", "500+"]


def test_ratios_without_a_denominator(spark):
    frame = spark.sql("SELECT * FROM VALUES (3L, 0L), (3L, CAST(NULL AS BIGINT)), (3L, 8L) t(a, b)")
    a, b = F.col("a"), F.col("b")
    rows = frame.select(ratios.percent(a, b, 1), ratios.percent_or_zero(a, b, 1),
                        ratios.pct_change(a, b), ratios.rate(a, b)).collect()
    assert [tuple(row) for row in rows] == [
        (None, 0.0, None, None), (None, 0.0, None, None), (37.5, 37.5, -62.5, 37500.0)]


@pytest.mark.parametrize("params, scope", [
    (ReportParams(), Scope()),
    (ReportParams(year="2024"), Scope(year=2024)),
    (ReportParams(year="2024", month="all"), Scope(year=2024)),
    (ReportParams(year="2024", month="MAY"), Scope(year=2024, month=5)),
    (ReportParams(year=2024, month="sep"), Scope(year=2024, month=9)),
    (ReportParams(year="2024", month="12"), Scope(year=2024, month=12)),
    (ReportParams(year="2024", month="13"), Scope(year=2024)),
    (ReportParams(year="2024", month="soon"), Scope(year=2024)),
    (ReportParams(year="x", default_year=2020, month="2"), Scope(year=2020, month=2)),
    (ReportParams(location="national"), Scope()),
    (ReportParams(location="East Region"), Scope("region", "East")),
    (ReportParams(location="Lake District", year=2024), Scope("district", "Lake", year=2024)),
    (ReportParams(location="Lake"), Scope("district", "Lake")),
])
def test_report_parameters(params, scope):
    assert params.scope() == scope


def test_scope_periods():
    assert (Scope().first_day(), Scope().last_day()) == (None, None)
    leap = Scope(year=2024, month=2)
    assert (leap.first_day(), leap.last_day()) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    cut = Scope(year=2024, start=dt.date(2023, 5, 1), end=dt.date(2024, 3, 4))
    assert (cut.first_day(), cut.last_day()) == (dt.date(2024, 1, 1), dt.date(2024, 3, 4))
    with pytest.raises(ValueError):
        Scope(month=3)
    with pytest.raises(ValueError):
        Scope("region")
