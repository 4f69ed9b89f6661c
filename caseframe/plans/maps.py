"""Values per district for maps, their classes and their scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseframe.functions import ratios
from caseframe.functions.bands import ValueClasses
from caseframe.model import CaseDefinition, Scope
from caseframe.operators.cases import AsOf, case_rows, since
from caseframe.operators.places import (
    add_districts, at_place, name_districts, valid_district)
from caseframe.schemas import DISTRICT_KEY, ORG_KEY


def district_cases(fact: DataFrame, org: DataFrame, definition: CaseDefinition, name: str, *,
                   scope: Scope = Scope(), days: int | None = None,
                   as_of: AsOf = None) -> DataFrame:
    """Distinct events per valid district, in column ``name``."""
    rows = case_rows(fact, definition, scope)
    if days is not None:
        rows = since(rows, fact, definition, as_of, days=days)
    counted = (add_districts(rows.select("event_id", ORG_KEY), org,
                             valid_district() & at_place(scope))
               .groupBy(DISTRICT_KEY).agg(F.count_distinct("event_id").alias(name)))
    return name_districts(counted, org)


def map_cumulative_cases(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                         scope: Scope = Scope()) -> DataFrame:
    """All cases per district."""
    return (district_cases(fact, org, definition, "total_cases", scope=scope)
            .orderBy(F.desc("total_cases"), "district"))


def map_cases_21d(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                  days: int = 21, as_of: AsOf = None) -> DataFrame:
    """Cases per district in the last 21 days."""
    name = f"cases_last_{days}_days"
    return (district_cases(fact, org, definition, name, days=days, as_of=as_of)
            .orderBy(F.desc(name), "district"))


def _with_rate(counts: DataFrame, cases: str, rate: str, floor: int,
               population: DataFrame | None) -> DataFrame:
    if population is None:
        name = rate.replace("rate_", "rate_proxy_")
        denominator = F.greatest(F.col(cases), F.lit(floor))
        rated = counts.withColumn(name, ratios.rate(F.col(cases), denominator))
    else:
        name = rate
        people = (population.groupBy(F.col("district_name").alias("district"))
                  .agg(F.sum("population").alias("people")))
        rated = (counts.join(people, "district", "left")
                 .withColumn(name, ratios.rate(F.col(cases), F.col("people"))).drop("people"))
    return rated.orderBy(F.desc_nulls_last(name), "district")


def map_attack_rate(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                    floor: int = 1000, population: DataFrame | None = None) -> DataFrame:
    """All cases per 100,000 by district.

    The proxy takes the cases themselves, at least ``floor``, as denominator; give a
    population (``district_name``, ``population``) for true rates.
    """
    counts = district_cases(fact, org, definition, "total_cases")
    return _with_rate(counts, "total_cases", "attack_rate_per_100k", floor, population)


def map_case_rate_21d(fact: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                      days: int = 21, as_of: AsOf = None, floor: int = 500,
                      population: DataFrame | None = None) -> DataFrame:
    """Cases of the last 21 days per 100,000 by district, as :func:`map_attack_rate`."""
    counts = district_cases(fact, org, definition, "current_cases", days=days, as_of=as_of)
    return _with_rate(counts, "current_cases", "current_rate_per_100k", floor, population)


def map_layer(shapes: DataFrame, values: DataFrame, value: str,
              classes: ValueClasses) -> DataFrame:
    """Every district on the map with its value, 0 if it has none, and the scale's end."""
    layer = (shapes.select("name")
             .join(values.select(F.col("district").alias("name"), value), "name", "left")
             .select("name", F.coalesce(value, F.lit(0)).alias("value")))
    largest = F.max("value").over(Window.partitionBy())
    return layer.withColumn("scale_max", F.greatest(F.lit(classes.scale_floor), largest))


def map_bins(layer: DataFrame, value: str, classes: ValueClasses) -> DataFrame:
    """The rows with the number and the label of their value's class."""
    index = classes.index(F.col(value))
    return (layer.withColumn("class_index", index)
            .withColumn("class_label", classes.label(F.col("class_index"))))
