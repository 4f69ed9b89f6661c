"""Lists a report page offers for selection: places and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseframe.model import CaseDefinition
from caseframe.operators.cases import case_rows
from caseframe.operators.places import (
    UNKNOWN_REGION, add_districts, name_districts, valid_district)
from caseframe.schemas import DISTRICT_KEY, ORG_KEY


def _numbered(choices: DataFrame, *order) -> DataFrame:
    """Number the choices from one; a place list is short."""
    return choices.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def location_options(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                     national_label: str = "National", districts: int = 15,
                     keep: Column | None = None) -> DataFrame:
    """The nation, each region, then the districts with most cases, in this order.

    Districts are the valid ones; ``keep`` changes that.
    """
    rows = case_rows(fact, definition, dated=False).select("event_id", ORG_KEY)
    # One row out of a global aggregate, which holds whether or not a place exists.
    nation = org.agg(F.lit(1).alias("rank"), F.lit("national").alias("level"),
                     F.lit(0).cast("bigint").alias("cases"),
                     F.lit(national_label).alias("location"))
    regions = (org.filter(F.col("region_name").isNotNull()
                          & (F.col("region_name") != UNKNOWN_REGION))
               .select("region_name").distinct()
               .select(F.lit(2).alias("rank"), F.lit("region").alias("level"),
                       F.lit(0).cast("bigint").alias("cases"),
                       F.concat("region_name", F.lit(" Region")).alias("location")))
    counted = (add_districts(rows, org, valid_district() if keep is None else keep)
               .groupBy(DISTRICT_KEY).agg(F.count_distinct("event_id").alias("cases")))
    top = (name_districts(counted, org, "location")
           .orderBy(F.desc("cases"), "location").limit(districts)
           .select(F.lit(3).alias("rank"), F.lit("district").alias("level"), "cases", "location"))
    options = nation.unionByName(regions).unionByName(top)
    return (_numbered(options, "rank", F.desc("cases"), "location")
            .select("position", "level", "location").orderBy("position"))


def time_period_options(fact: DataFrame, definition: CaseDefinition, *,
                        nested: bool = False) -> DataFrame:
    """Months with cases, newest first; ``nested`` gives one row per year with its months."""
    day = F.col("event_date")
    months = (case_rows(fact, definition)
              .select("event_id", F.year(day).alias("year"), F.month(day).alias("month"))
              .groupBy("year", "month")
              .agg(F.count_distinct("event_id").alias("cases"))
              .withColumn("month_name",
                          F.date_format(F.make_date("year", "month", F.lit(1)), "MMMM"))
              .withColumn("display", F.concat_ws(" ", "month_name", F.col("year"))))
    if not nested:
        return (months.select("year", "month", "month_name", "cases", "display")
                .orderBy(F.desc("year"), F.desc("month")))
    entry = F.struct("month", F.col("month_name").alias("name"), "cases", "display")
    return (months.groupBy("year")
            .agg(F.sort_array(F.collect_list(entry), asc=False).alias("months"))
            .orderBy(F.desc("year")))


def hierarchical_locations(org: DataFrame, *, national_label: str = "National Level",
                           district_level: int = 3) -> DataFrame:
    """The national label, then the valid districts by name."""
    nation = org.agg(F.lit(1).alias("rank"), F.lit(national_label).alias("location"))
    districts = (org.filter((F.col("leaf_level") == district_level) & valid_district())
                 .select("district_name").distinct()
                 .select(F.lit(2).alias("rank"), F.col("district_name").alias("location")))
    return (_numbered(nation.unionByName(districts), "rank", "location")
            .select("position", "location").orderBy("position"))
