"""One-row summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseframe.functions import ratios
from caseframe.model import CaseDefinition, Scope
from caseframe.operators.cases import AsOf, case_rows, report_date, since, until
from caseframe.operators.names import Names
from caseframe.operators.places import add_places, at_place
from caseframe.operators.totals import one_row
from caseframe.plans.deaths import total_deaths
from caseframe.plans.districts import ranked_districts
from caseframe.schemas import ORG_KEY


def cases_last_24h(fact: DataFrame, definition: CaseDefinition, *,
                   as_of: AsOf = None) -> DataFrame:
    """Events dated from the day before the report date on: two calendar days."""
    rows = since(case_rows(fact, definition), fact, definition, as_of, days=1)
    return rows.agg(F.count_distinct("event_id").alias("cases_24h"))


def summary_stats(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                  scope: Scope = Scope(), as_of: AsOf = None) -> DataFrame:
    """Total cases, affected districts, and cases of the last 7 and 30 days.

    Events are reduced to one row each before they are counted, which avoids
    expanding every row for each distinct count. Undated cases count in the total, cases
    dated after ``as_of`` in no figure.
    """
    fact = until(fact, as_of)

    def recent(days: int):
        return F.col("event_date") >= report_date(
            fact, definition, as_of, lambda last: F.date_sub(last, days))

    rows = case_rows(fact, definition, scope, dated=False)
    placed = add_places(rows.select("event_id", ORG_KEY, recent(7).alias("week"),
                                    recent(30).alias("month")), org, (), at_place(scope))
    events = (placed.groupBy("event_id")
              .agg(F.max("week").alias("week"), F.max("month").alias("month"))
              .agg(F.count("*").alias("total_cases"),
                   F.count_if("week").alias("cases_last_7_days"),
                   F.count_if("month").alias("cases_last_30_days")))
    places = rows.select(ORG_KEY).distinct()
    districts = (add_places(places, org, keep=at_place(scope))
                 .agg(F.count_distinct("district_name").alias("affected_districts")))
    return one_row(events, districts).select(
        "total_cases", "affected_districts", "cases_last_7_days", "cases_last_30_days")


def _week_trend(fact: DataFrame, definition: CaseDefinition) -> DataFrame:
    """All cases, and the direction from the week before to the newest week with cases.

    Weeks go by their Mondays, so they run on over a new year. Without cases in the week before
    there is nothing to compare with, and the trend is stable.
    """
    monday = F.date_trunc("week", "event_date").cast("date").alias("monday")
    weeks = (case_rows(fact, definition).select("event_id", monday).distinct()
             .groupBy("monday").agg(F.count("*").alias("weekly_cases")))
    newest = Window.orderBy(F.desc("monday"))
    weeks = (weeks.withColumn("place", F.row_number().over(newest))
             .withColumn("gap", F.datediff(F.max("monday").over(newest), "monday"))
             .agg(F.coalesce(F.sum("weekly_cases"), F.lit(0)).alias("total_cases"),
                  F.max(F.when(F.col("place") == 1, F.col("weekly_cases"))).alias("current"),
                  F.max(F.when(F.col("gap") == 7, F.col("weekly_cases"))).alias("before")))
    trend = (F.when(F.col("current") > F.col("before"), "Increasing")
             .when(F.col("current") < F.col("before"), "Decreasing")
             .otherwise("Stable"))
    return weeks.select("total_cases", trend.alias("trend"))


def executive_summary(fact: DataFrame, org: DataFrame, attributes: DataFrame,
                      definition: CaseDefinition, *, as_of: AsOf = None,
                      names: Names | None = None) -> DataFrame:
    """Headline figures: cases, new cases, deaths, fatality, districts, trend.

    ``affected_districts`` counts every district with cases. Nothing dated after ``as_of``
    counts in any figure.
    """
    fact = until(fact, as_of)
    best = F.min(F.struct(-F.col("total_cases"), -F.col("cases_last_epiweek"),
                          F.col("district"), F.col("total_cases")))
    ranked = ranked_districts(fact, org, definition).agg(
        F.count("*").alias("affected_districts"), best.alias("best")).select(
        "affected_districts", F.col("best.district").alias("top_district"),
        F.coalesce("best.total_cases", F.lit(0)).alias("top_district_cases"))
    fatality = ratios.percent_or_zero(F.col("total_deaths"), F.col("total_cases"), 2)
    return one_row(_week_trend(fact, definition),
                   cases_last_24h(fact, definition, as_of=as_of),
                   total_deaths(fact, attributes, definition, names=names),
                   ranked).select(
        "total_cases", F.col("cases_24h").alias("cases_last_24h"),
        F.col("total_deaths").alias("deaths"), fatality.alias("cfr_pct"),
        "affected_districts", "top_district", "top_district_cases", "trend")
