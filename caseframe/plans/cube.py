"""Cases by district and week, by district, by week and in all, from one aggregation.

Reports of a period that go by district or week read the cube, a row per district and week at
most, so the case rows are gone through once for all of them. Distinct events do not add up over
weeks or districts; so of each event one row is marked as its first in its district, in its week
and in all, and every level of the grouping sets adds up its own marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseframe.functions import ratios
from caseframe.functions.dates import epi_week, week_start
from caseframe.model import CaseDefinition, Scope
from caseframe.operators.cases import case_rows
from caseframe.operators.places import add_districts, at_place, name_districts, valid_district
from caseframe.operators.totals import total_of
from caseframe.schemas import DISTRICT_KEY, ORG_KEY

#: Grouping ids of the levels: which of district and week are summed over.
DISTRICT_WEEKS, DISTRICTS, WEEKS, ALL = 0, 1, 2, 3


def case_cube(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
              scope: Scope = Scope()) -> DataFrame:
    """level, district number, week_start and distinct case events, at valid districts.

    Rows are one per event, district and week before they are counted; the marks need no
    shuffle but the one by event.
    """
    rows = case_rows(fact, definition, scope).select(
        "event_id", ORG_KEY, week_start(F.col("event_date")).alias("week_start"))
    placed = (add_districts(rows, org, valid_district() & at_place(scope))
              .groupBy("event_id", DISTRICT_KEY, "week_start").agg(F.count("*").alias("copies")))

    def first(*by: str):
        order = Window.partitionBy("event_id", *by).orderBy("week_start", DISTRICT_KEY)
        return F.when(F.row_number().over(order) == 1, 1)

    marked = placed.select(DISTRICT_KEY, "week_start", first(DISTRICT_KEY).alias("in_district"),
                           first("week_start").alias("in_week"), first().alias("in_all"))
    level = F.grouping_id(DISTRICT_KEY, "week_start").cast("int")
    counted = marked.groupingSets(
        [[DISTRICT_KEY, "week_start"], [DISTRICT_KEY], ["week_start"], []],
        DISTRICT_KEY, "week_start").agg(
        level.alias("level"), F.count("*").alias("rows"),
        *(F.count(mark).alias(mark) for mark in ("in_district", "in_week", "in_all")))
    cases = (F.when(F.col("level") == DISTRICT_WEEKS, F.col("rows"))
             .when(F.col("level") == DISTRICTS, F.col("in_district"))
             .when(F.col("level") == WEEKS, F.col("in_week")).otherwise(F.col("in_all")))
    return counted.select("level", DISTRICT_KEY, "week_start", cases.alias("cases"))


def at_level(cube: DataFrame, level: int) -> DataFrame:
    return cube.filter(F.col("level") == level).drop("level")


def weekly_cases(cube: DataFrame) -> DataFrame:
    """Cases per week at valid districts."""
    return (at_level(cube, WEEKS).select("week_start", F.col("cases").alias("weekly_cases"))
            .orderBy("week_start"))


def _leading(cube: DataFrame, org: DataFrame, districts: int) -> DataFrame:
    totals = at_level(cube, DISTRICTS).select(DISTRICT_KEY, "cases")
    return name_districts(totals, org).orderBy(F.desc("cases"), "district").limit(districts)


def district_total_share(cube: DataFrame, org: DataFrame, *, k: int = 5) -> DataFrame:
    """Districts with most cases and their share of the cases of all districts."""
    totals = at_level(cube, DISTRICTS).select(DISTRICT_KEY, "cases")
    shared = totals.withColumn("proportion", ratios.percent(F.col("cases"), total_of("cases"), 2))
    return name_districts(shared, org).orderBy(F.desc("cases"), "district").limit(k)


def district_weekly_share(cube: DataFrame, org: DataFrame, *, districts: int = 5) -> DataFrame:
    """Share of each week's cases in the districts with most cases of the cube."""
    weekly = at_level(cube, DISTRICT_WEEKS)
    weekly = weekly.withColumn("proportion", ratios.percent(
        F.col("cases"), total_of("cases", "week_start"), 2))
    top = _leading(cube, org, districts).select("district")
    return (name_districts(weekly, org).join(F.broadcast(top), "district", "left_semi")
            .select("week_start", "district", "proportion").orderBy("week_start", "district"))


def district_epicurves(cube: DataFrame, org: DataFrame, *, districts: int = 12) -> DataFrame:
    """Weekly cases of the districts with most cases of the cube.

    Districts that tie are taken by name, whatever their latest week.
    """
    top = _leading(cube, org, districts).select("district")
    return (name_districts(at_level(cube, DISTRICT_WEEKS), org)
            .join(F.broadcast(top), "district", "left_semi")
            .select("district", "week_start", epi_week(F.col("week_start")).alias("epi_week"),
                    F.col("cases").alias("weekly_cases"))
            .orderBy("district", "week_start"))
