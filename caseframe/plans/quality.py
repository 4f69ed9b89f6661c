"""Checks for data that makes counts ambiguous or drops rows without a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.model import CaseDefinition, Scope
from caseframe.operators.cases import case_rows
from caseframe.operators.places import named_district
from caseframe.operators.sifting import sift
from caseframe.operators.sizes import join_dimension
from caseframe.schemas import ORG_KEY, PERSON


def several_values(*columns: str) -> Column:
    """Aggregate: whether one of the columns has two values, by its least and its greatest."""
    several = F.lit(False)
    for name in columns or ("event_date", ORG_KEY, PERSON):
        several = several | F.coalesce(F.min(name) < F.max(name), F.lit(False))
    return several


def unruly_events(cases: DataFrame) -> DataFrame:
    """Ids of events whose case rows have several dates, places or persons.

    One aggregation, in fixed-width buffers.
    """
    return (cases.groupBy("event_id").agg(several_values().alias("several"))
            .filter("several").select("event_id"))


def is_additive(fact: DataFrame, definition: CaseDefinition) -> bool:
    """Whether every case event has one date, one place and one person at most."""
    return unruly_events(case_rows(fact, definition, dated=False)).isEmpty()


def dq_multi_date_events(fact: DataFrame, definition: CaseDefinition,
                         scope: Scope = Scope()) -> DataFrame:
    """Case events with several dates, places or persons.

    Such an event counts once in each of its weeks and districts, so totals over
    them exceed the number of events. Distinct values are counted for these events only.
    """
    day, org, person = F.col("event_date"), F.col(ORG_KEY), F.col(PERSON)
    rows = case_rows(fact, definition, scope, dated=False).select("event_id", day, org, person)
    unruly = unruly_events(rows)
    return (sift(rows, unruly, "event_id").join(unruly, "event_id", "left_semi").distinct()
            .groupBy("event_id")
            .agg(F.count_distinct(day).alias("dates"), F.count_distinct(org).alias("places"),
                 F.count_distinct(person).alias("persons")))


def dq_duplicate_attributes(attributes: DataFrame) -> DataFrame:
    """Persons with several rows for one attribute, and how many values differ."""
    per_value = (attributes.groupBy("entity_id", "attribute_id", "attribute_value")
                 .agg(F.count("*").alias("copies")))
    return (per_value.groupBy("entity_id", "attribute_id")
            .agg(F.sum("copies").alias("rows"),
                 F.count("attribute_value").alias("distinct_values"))
            .filter(F.col("rows") > 1))


def dq_orphan_keys(fact: DataFrame, org: DataFrame, definition: CaseDefinition) -> DataFrame:
    """Place keys of case rows that the hierarchy lacks, with rows and events."""
    per_key = (case_rows(fact, definition, dated=False)
               .groupBy(ORG_KEY, "event_id").agg(F.count("*").alias("copies"))
               .groupBy(ORG_KEY)
               .agg(F.sum("copies").alias("rows"), F.count("event_id").alias("events")))
    return join_dimension(per_key, org.select(ORG_KEY), org, ORG_KEY, "left_anti")


def dq_unmatched_geo(shapes: DataFrame, org: DataFrame) -> DataFrame:
    """District names that only the map or only the hierarchy knows."""
    on_map = shapes.select("name").distinct()
    listed = (org.filter(named_district()).select(F.col("district_name").alias("name"))
              .distinct())
    return (on_map.join(listed, "name", "left_anti").withColumn("only_in", F.lit("map"))
            .unionByName(listed.join(on_map, "name", "left_anti")
                         .withColumn("only_in", F.lit("hierarchy"))))
