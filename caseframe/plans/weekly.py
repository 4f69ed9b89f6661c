"""Epidemiological weeks: tables, running totals, moving averages, epi curves.

Events are counted with one shuffle on the event; windows that need all rows run
only on the weekly counts, a few hundred rows whatever the size of the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseframe.functions import ratios
from caseframe.functions.dates import epi_week, epi_year, week_number, week_start
from caseframe.functions.text import FEMALE, MALE, UNKNOWN_SEX, one_sex, sex_by_word
from caseframe.model import AttributeCodes, CaseDefinition, Scope
from caseframe.operators.cases import AsOf, case_rows, report_date, since
from caseframe.operators.places import (
    add_districts, add_places, at_place, name_districts, valid_district)
from caseframe.operators.totals import total_of
from caseframe.plans.districts import ranked_districts
from caseframe.schemas import DISTRICT_KEY, ORG_KEY, PERSON


def _known(by: str) -> str:
    if by not in ("weeks", "rows"):
        raise ValueError(f"by is 'weeks' or 'rows', not {by!r}")
    return by


def week_columns(by: str, iso_year: bool) -> list[Column]:
    """Year and epi week of a row, and with ``by="weeks"`` the week's number.

    A week goes by its Monday and has the year of its Thursday. Going by rows, the calendar year
    of each day stands beside its week: days at New Year are put to the week of the same number
    at the other end of the year.
    """
    day = F.col("event_date")
    monday = week_start(day)
    if _known(by) == "rows":
        return [epi_year(day, iso_year).alias("year"), epi_week(day).alias("epi_week")]
    return [epi_year(monday, True).alias("year"), epi_week(monday).alias("epi_week"),
            week_number(monday).alias("week_number")]


def weekly_counts(fact: DataFrame, definition: CaseDefinition, scope: Scope = Scope(),
                  iso_year: bool = False, by: str = "weeks") -> DataFrame:
    """Distinct events per year and epi week."""
    columns = week_columns(by, iso_year)
    rows = case_rows(fact, definition, scope).select("event_id", *columns)
    return (rows.groupBy(*(c for c in rows.columns if c != "event_id"))
            .agg(F.count_distinct("event_id").alias("weekly_cases")))


def with_running(weeks: DataFrame, compare: str) -> DataFrame:
    """Running total, and change against the week before, or after as ``compare`` says.

    Weeks with a number are compared by distance: there is no change after a week without
    cases. Weeks without one are compared with the neighbouring row.
    """
    if compare not in ("previous", "next"):
        raise ValueError(f"compare is 'previous' or 'next', not {compare!r}")
    if "week_number" in weeks.columns:
        in_time, step = Window.orderBy("week_number"), -1 if compare == "previous" else 1
        neighbour = F.sum("weekly_cases").over(in_time.rangeBetween(step, step))
    else:
        in_time = Window.orderBy("year", "epi_week")
        neighbour = (F.lag if compare == "previous" else F.lead)("weekly_cases").over(in_time)
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weeks.select(
        "year", "epi_week", "weekly_cases",
        F.sum("weekly_cases").over(so_far).alias("cumulative_cases"),
        ratios.pct_change(F.col("weekly_cases"), neighbour).alias("pct_change"))


def newest_weeks(weeks: DataFrame, keep: int) -> DataFrame:
    return weeks.orderBy(F.desc("year"), F.desc("epi_week")).limit(keep)


def weekly_table(fact: DataFrame, definition: CaseDefinition, *, weeks: int = 10,
                 scope: Scope = Scope(), compare: str = "previous",
                 iso_year: bool = False, by: str = "weeks") -> DataFrame:
    """Newest epi weeks with the running total since the first case.

    The change is against the week before; ``compare="next"`` takes the following
    week instead, which leaves the newest week without one. ``by="rows"`` compares with the
    row before, however long ago, and keeps the calendar year of each day unless
    ``iso_year`` is set.
    """
    counts = weekly_counts(fact, definition, scope, iso_year, by)
    return newest_weeks(with_running(counts, compare), weeks)


def weekly_table_year(fact: DataFrame, definition: CaseDefinition, *, year: int | None = None,
                      start=None, end=None, weeks: int = 10, compare: str = "previous",
                      iso_year: bool = False, by: str = "weeks") -> DataFrame:
    """Newest epi weeks of one calendar year; totals and changes run over these weeks only.

    Without a year, the last year with a case is taken; going by rows with ``iso_year``, the weeks
    that carry that year.
    """
    scope = Scope(year=year, start=start, end=end)
    if year is None and _known(by) == "weeks":
        first = report_date(fact, definition, None, lambda day: F.trunc(day, "year"), scope)
        fact = fact.filter(F.col("event_date") >= first)
    counts = weekly_counts(fact, definition, scope, iso_year, by)
    if year is None and by == "rows":
        last = report_date(fact, definition, None, F.year, scope)
        counts = counts.filter(F.col("year") == last)
    table = with_running(newest_weeks(counts, weeks), compare)
    return table.orderBy(F.desc("year"), F.desc("epi_week"))


def cases_per_week(fact: DataFrame, org: DataFrame, definition: CaseDefinition,
                   scope: Scope = Scope()) -> DataFrame:
    """Distinct events at listed places per Monday-based week."""
    rows = case_rows(fact, definition, scope).select(
        "event_id", ORG_KEY, week_start(F.col("event_date")).alias("week_start"))
    return (add_places(rows, org, (), at_place(scope))
            .groupBy("week_start")
            .agg(F.count_distinct("event_id").alias("weekly_cases")))


def fill_weeks(weeks: DataFrame) -> DataFrame:
    """Add the weeks without cases between the first and the last one."""
    ends = weeks.agg(F.min("week_start").alias("first"), F.max("week_start").alias("last"))
    calendar = (ends.filter(F.col("first").isNotNull())
                .select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 7 DAYS")))
                        .alias("week_start")))
    return (calendar.join(weeks, "week_start", "left")
            .select("week_start", F.coalesce("weekly_cases", F.lit(0)).alias("weekly_cases")))


def weekly_moving_average(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                          scope: Scope = Scope(), weeks: int = 20, span: int = 7,
                          fill_gaps: bool = False) -> DataFrame:
    """Newest weeks with the mean of each week and the six rows before it.

    Rows are weeks with cases; ``fill_gaps`` puts the empty weeks in first, so that the mean
    is that of seven weeks.
    """
    counts = cases_per_week(fact, org, definition, scope)
    if fill_gaps:
        counts = fill_weeks(counts)
    frame = Window.orderBy("week_start").rowsBetween(1 - span, Window.currentRow)
    return (counts
            .withColumn("moving_avg_7w", F.round(F.avg("weekly_cases").over(frame), 1))
            .orderBy(F.desc("week_start")).limit(weeks))


def weekly_by_sex(fact: DataFrame, org: DataFrame, attributes: DataFrame,
                  definition: CaseDefinition, codes: AttributeCodes, *,
                  scope: Scope = Scope(), weeks: int = 20) -> DataFrame:
    """Newest weeks with a case of known sex, distinct events by sex.

    An event counts for one person; a person whose sexes contradict has none. Cases are counted per person and week before
    they meet the attributes, so a person with very many events is one row a week
    in that join.
    """
    rows = (case_rows(fact, definition, scope).filter(F.col(PERSON).isNotNull())
            .select("event_id", PERSON, ORG_KEY,
                    week_start(F.col("event_date")).alias("week_start")))
    per_person = (add_places(rows, org, (), at_place(scope))
                  .groupBy("event_id", "week_start").agg(F.min(PERSON).alias(PERSON))
                  .groupBy(PERSON, "week_start").agg(F.count("*").alias("events")))
    value = F.col("attribute_value")
    known = (attributes.filter(F.col("attribute_id") == codes.sex)
             .select(F.col("entity_id").alias(PERSON), sex_by_word(value).alias("sex_code"))
             .filter(F.col("sex_code").isin(MALE, FEMALE))
             .groupBy(PERSON).agg(one_sex(F.col("sex_code")).alias("sex_code"))
             .filter(F.col("sex_code") != UNKNOWN_SEX))

    def of(code: int):
        return F.coalesce(F.sum(F.when(F.col("sex_code") == code, F.col("events"))), F.lit(0))

    return (per_person.join(known, PERSON)
            .groupBy("week_start")
            .agg(of(MALE).alias("male_cases"), of(FEMALE).alias("female_cases"))
            .orderBy(F.desc("week_start")).limit(weeks))


def _recent_or_scoped(fact, definition, scope: Scope, as_of: AsOf) -> DataFrame:
    """Case rows of the scope's period, or of the last twelve months without one."""
    rows = case_rows(fact, definition, scope)
    if scope.first_day() is None and scope.last_day() is None:
        rows = since(rows, fact, definition, as_of, months=12)
    return rows


def district_epicurves(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                       year: int | None = None, districts: int = 12,
                       as_of: AsOf = None) -> DataFrame:
    """Weekly cases of the districts with most cases, in the year or the last 12 months."""
    scope = Scope(year=year)
    top = ranked_districts(fact, org, definition, scope).limit(districts).select("district")
    rows = _recent_or_scoped(fact, definition, scope, as_of).select(
        "event_id", ORG_KEY, week_start(F.col("event_date")).alias("week_start"))
    weekly = (add_districts(rows, org, valid_district(), top)
              .groupBy(DISTRICT_KEY, "week_start")
              .agg(F.count_distinct("event_id").alias("weekly_cases")))
    return (name_districts(weekly, org)
            .select("district", "week_start", epi_week(F.col("week_start")).alias("epi_week"),
                    "weekly_cases")
            .orderBy("district", "week_start"))


def district_weekly_share(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                          scope: Scope = Scope(), districts: int = 5,
                          as_of: AsOf = None) -> DataFrame:
    """Share of each week's cases in the districts with most cases in the period."""
    rows = _recent_or_scoped(fact, definition, scope, as_of).select(
        "event_id", ORG_KEY, week_start(F.col("event_date")).alias("week_start"))
    weekly = (add_districts(rows, org, valid_district() & at_place(scope))
              .groupBy("week_start", DISTRICT_KEY)
              .agg(F.count_distinct("event_id").alias("cases")))
    totals = weekly.groupBy(DISTRICT_KEY).agg(F.sum("cases").alias("total"))
    top = (name_districts(totals, org).orderBy(F.desc("total"), "district").limit(districts)
           .select("district"))
    share = ratios.percent(F.col("cases"), total_of("cases", "week_start"), 2)
    return (name_districts(weekly.withColumn("proportion", share), org)
            .join(F.broadcast(top), "district", "left_semi")
            .select("week_start", "district", "proportion")
            .orderBy("week_start", "district"))
