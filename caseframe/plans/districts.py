"""District rankings, shares and reporting completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import ratios
from caseframe.functions.dates import week_start
from caseframe.model import CaseDefinition, Scope
from caseframe.operators.cases import AsOf, case_rows, report_date, since, since_hours, until
from caseframe.operators.names import Names
from caseframe.operators.outcomes import dead_events
from caseframe.operators.places import (
    add_districts, at_place, name_districts, valid_district)
from caseframe.operators.totals import total_of
from caseframe.schemas import DISTRICT_KEY, ORG_KEY

TOTAL = "TOTAL"


def district_events(fact: DataFrame, org: DataFrame, definition: CaseDefinition,
                    scope: Scope = Scope()) -> DataFrame:
    """One row per district and event, flagged for the latest week and the one before.

    The latest week is the ISO week of the last case. Flags are combined on the
    map side, so copies of a row do not travel.
    """
    monday = report_date(fact, definition, None, week_start, scope)
    day = F.col("event_date")
    rows = case_rows(fact, definition, scope).select(
        "event_id", ORG_KEY,
        (day >= monday).alias("in_last"),
        ((day >= F.date_sub(monday, 7)) & (day < monday)).alias("in_previous"))
    return (add_districts(rows, org, valid_district() & at_place(scope))
            .groupBy(DISTRICT_KEY, "event_id")
            .agg(F.max("in_last").alias("in_last"), F.max("in_previous").alias("in_previous")))


def _case_columns() -> list[Column]:
    return [F.count("*").alias("total_cases"),
            F.count_if("in_last").alias("cases_last_epiweek"),
            F.count_if("in_previous").alias("cases_previous")]


def _by_cases(districts: DataFrame) -> DataFrame:
    return districts.orderBy(F.desc("total_cases"), F.desc("cases_last_epiweek"), "district")


def ranked_districts(fact: DataFrame, org: DataFrame, definition: CaseDefinition,
                     scope: Scope = Scope()) -> DataFrame:
    """All districts with cases, most cases first."""
    counted = (district_events(fact, org, definition, scope)
               .groupBy(DISTRICT_KEY).agg(*_case_columns()))
    return _by_cases(name_districts(counted, org))


def top_districts(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                  scope: Scope = Scope(), k: int = 12,
                  outcome_elements: Sequence[str] | None = None,
                  names: Names | None = None, cases: DataFrame | None = None) -> DataFrame:
    """Districts with most cases: deaths, the latest epi week and its change.

    ``cases`` is a table of the case rows, if they need not be read from the fact again.
    """
    dead = dead_events(fact, outcome_elements, names).withColumn("died", F.lit(True))
    events = (district_events(fact if cases is None else cases, org, definition, scope)
              .join(dead, "event_id", "left")
              .withColumn("died", F.coalesce("died", F.lit(False))))
    counted = (events.groupBy(DISTRICT_KEY)
               .agg(*_case_columns(),
                    F.count_if("died").alias("total_deaths"),
                    F.count_if(F.col("died") & F.col("in_last")).alias("deaths_last_epiweek")))
    change = ratios.pct_change(F.col("cases_last_epiweek"), F.col("cases_previous"))
    return _by_cases(name_districts(counted, org).select(
        "district", "total_cases", "total_deaths", "cases_last_epiweek",
        "deaths_last_epiweek", change.alias("pct_change"))).limit(k)


def top_districts_totals(ranking: DataFrame) -> DataFrame:
    """A district ranking with one more row that sums the listed districts."""
    sums = ("total_cases", "total_deaths", "cases_last_epiweek", "deaths_last_epiweek")
    return (ranking.rollup("district")
            .agg(*(F.sum(name).alias(name) for name in sums),
                 F.max("pct_change").alias("change"), F.grouping("district").alias("is_total"))
            .select(F.when(F.col("is_total") == 1, TOTAL).otherwise(F.col("district"))
                    .alias("district"),
                    *sums,
                    F.when(F.col("is_total") == 0, F.col("change")).alias("pct_change"))
            .orderBy(F.col("district") == TOTAL, F.desc("total_cases"), "district"))


def district_total_share(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                         scope: Scope = Scope(), k: int = 5) -> DataFrame:
    """Districts with most cases and their share of the cases of all districts."""
    rows = case_rows(fact, definition, scope).select("event_id", ORG_KEY)
    counted = (add_districts(rows, org, valid_district() & at_place(scope))
               .groupBy(DISTRICT_KEY).agg(F.count_distinct("event_id").alias("cases")))
    share = ratios.percent(F.col("cases"), total_of("cases"), 2)
    return (name_districts(counted, org).withColumn("proportion", share)
            .orderBy(F.desc("cases"), "district").limit(k))


def district_reporting(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                       scope: Scope = Scope(), days: int | None = None,
                       hours: int | None = None, as_of: AsOf = None) -> DataFrame:
    """Districts in scope, and those with a case in the period, as counts and shares.

    Case rows are first cut to the places that occur in them, which leaves at most
    one row per place and task to shuffle.
    """
    rows = case_rows(fact, definition, scope)
    if days is not None:
        rows = since(rows, fact, definition, as_of, days=days)
    elif hours is not None:
        rows = since_hours(rows, fact, definition, hours, as_of)
    reporting = rows.select(ORG_KEY).distinct().withColumn("reports", F.lit(True))
    districts = org.filter(valid_district() & at_place(scope)).select(ORG_KEY, "district_name")
    counts = (districts.join(reporting, ORG_KEY, "left")
              .groupBy("district_name")
              .agg(F.max("reports").alias("reports"))
              .agg(F.count("*").alias("total_districts"),
                   F.count_if("reports").alias("districts_with_cases")))
    total, with_cases = F.col("total_districts"), F.col("districts_with_cases")
    return counts.select(
        total, with_cases,
        (total - with_cases).alias("districts_without_cases"),
        ratios.percent(with_cases, total, 1).alias("pct_with_cases"),
        ratios.percent(total - with_cases, total, 1).alias("pct_without_cases"))


def district_line_summary(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                          scope: Scope = Scope(), days: int = 30,
                          as_of: AsOf = None) -> DataFrame:
    """Per district, up to ``as_of``: all cases, recent cases, first and latest case."""
    fact = until(fact, as_of)
    first_day = report_date(fact, definition, as_of, lambda day: F.date_sub(day, days))
    recent = F.col("event_date") >= first_day
    rows = case_rows(fact, definition, scope).select("event_id", ORG_KEY, "event_date")
    events = (add_districts(rows, org, valid_district() & at_place(scope))
              .withColumn("recent", recent)
              .groupBy(DISTRICT_KEY, "event_id")
              .agg(F.max("recent").alias("recent"), F.min("event_date").alias("first"),
                   F.max("event_date").alias("latest")))
    counted = events.groupBy(DISTRICT_KEY).agg(
        F.count("*").alias("total_cases"), F.count_if("recent").alias("cases_last_30_days"),
        F.min("first").alias("first_case"), F.max("latest").alias("latest_case"))
    return (name_districts(counted, org)
            .orderBy(F.desc("total_cases"), "district"))
