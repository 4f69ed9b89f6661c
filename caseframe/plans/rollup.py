"""The daily roll-up: cases per day, place, sex, age and outcome, and reports on it.

The roll-up has one row per combination that occurs, whatever the number of
cases, so pages that refresh often read it instead of the fact. Its counts may be
added only for events with one date, place and person; :func:`exact_rollup` keeps the rows of
the others by id, and reports put both together. Sketches per day and place stand in for
distinct counts over any period where an estimate will do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import ratios
from caseframe.functions.bands import ELEVEN_BANDS, AgeScheme
from caseframe.functions.dates import week_start
from caseframe.functions.text import UNKNOWN_SEX, sex_label
from caseframe.model import AttributeCodes, CaseDefinition, Scope
from caseframe.operators.cases import case_rows, within
from caseframe.operators.names import Names
from caseframe.operators.outcomes import dead_events
from caseframe.operators.persons import join_traits_of_many, person_traits
from caseframe.operators.places import (
    add_districts, add_places, at_place, name_districts, valid_district)
from caseframe.operators.sifting import sift
from caseframe.plans.quality import is_additive, several_values, unruly_events
from caseframe.plans.weekly import newest_weeks, week_columns, with_running
from caseframe.schemas import DISTRICT_KEY, ORG_KEY, PERSON

#: Logarithm of the registers of a sketch: 4,096 give a standard error of 1.6 %.
SKETCH_SIZE = 12


@dataclass(frozen=True, eq=False)
class Rollup:
    """Counts that may be added, and the case rows of the events whose counts may not:
    event_id, event_date, place and died."""

    daily: DataFrame
    residual: DataFrame


class NotAdditive(ValueError):
    """Some events have several dates, places or persons; daily counts do not add up."""


def require_additive(fact: DataFrame, definition: CaseDefinition) -> None:
    if not is_additive(fact, definition):
        raise NotAdditive("see dq_multi_date_events for the events concerned")


def daily_rollup(fact: DataFrame, attributes: DataFrame, definition: CaseDefinition,
                 codes: AttributeCodes, *, scope: Scope = Scope(),
                 scheme: AgeScheme = ELEVEN_BANDS,
                 outcome_elements: Sequence[str] | None = None,
                 names: Names | None = None, only_additive: bool = False) -> DataFrame:
    """Cases per event date, place, age band, sex and whether the event tells a death.

    Events are reduced to one row each, their first by date, place and person, counted per
    person and day, and only then joined with the persons' traits. ``only_additive`` leaves
    out the events with several dates, places or persons.
    """
    first = F.min(F.struct("event_date", F.col(ORG_KEY).isNull(), ORG_KEY,
                           F.col(PERSON).isNull(), PERSON))
    several = several_values() if only_additive else F.lit(False)
    events = (case_rows(fact, definition, scope).groupBy("event_id")
              .agg(first.alias("first"), several.alias("several")).filter("not several")
              .select("event_id", *(F.col(f"first.{c}").alias(c)
                                    for c in ("event_date", ORG_KEY, PERSON))))
    dead = dead_events(fact, outcome_elements, names).withColumn("died", F.lit(True))
    per_person = (events.join(dead, "event_id", "left")
                  .groupBy(PERSON, "event_date", ORG_KEY,
                           F.coalesce("died", F.lit(False)).alias("died"))
                  .agg(F.count("*").alias("n")))
    traits = person_traits(attributes, sex=codes.sex, age=codes.age)
    sex = F.coalesce("sex_code", F.lit(UNKNOWN_SEX))
    return (join_traits_of_many(per_person, traits)
            .groupBy("event_date", ORG_KEY, scheme.index(F.col("age_years")).alias("band"),
                     sex.alias("sex_code"), "died")
            .agg(F.sum("n").alias("cases"))
            .select("event_date", ORG_KEY, scheme.label(F.col("band")).alias("age_group"),
                    sex_label(F.col("sex_code")).alias("sex"), "died", "cases"))


def period_of(grain: str) -> Column:
    """The day or month a row of the roll-up is filed under."""
    if grain == "day":
        return F.col("event_date")
    if grain == "month":
        return F.trunc("event_date", "month")
    raise ValueError(f"grain is 'day' or 'month', not {grain!r}")


def write_rollup(rollup: DataFrame, path: str, grain: str = "day") -> None:
    """Write the roll-up filed by period; periods that are not in it stay as they are.

    Days suit a roll-up that is refreshed all the time, months one that reaches back
    many years: a month of it is one small file.
    """
    (rollup.withColumn("period", period_of(grain)).repartition("period")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period").parquet(path))


def exact_rollup(fact: DataFrame, attributes: DataFrame, definition: CaseDefinition,
                 codes: AttributeCodes, *, scope: Scope = Scope(),
                 scheme: AgeScheme = ELEVEN_BANDS,
                 outcome_elements: Sequence[str] | None = None,
                 names: Names | None = None) -> Rollup:
    """A roll-up that gives the figures of the direct reports, whatever the data.

    Events with one date, place and person are counted beforehand. The others, which are few,
    are kept with all their rows.
    """
    daily = daily_rollup(fact, attributes, definition, codes, scope=scope, scheme=scheme,
                         outcome_elements=outcome_elements, names=names, only_additive=True)
    cases = case_rows(fact, definition, scope)
    unruly = unruly_events(cases)
    rows = (sift(cases.select("event_id", "event_date", ORG_KEY), unruly, "event_id")
            .join(unruly, "event_id", "left_semi").distinct())
    dead = (sift(dead_events(fact, outcome_elements, names), unruly, "event_id")
            .withColumn("died", F.lit(True)))
    residual = (rows.join(dead, "event_id", "left")
                .withColumn("died", F.coalesce("died", F.lit(False))))
    return Rollup(daily, residual)


def write_exact(rollup: Rollup, path: str, grain: str = "day") -> None:
    """Write both tables of a roll-up, filed by period."""
    write_rollup(rollup.daily, f"{path}/daily", grain)
    write_rollup(rollup.residual, f"{path}/residual", grain)


def read_exact(spark: SparkSession, path: str, like: Rollup) -> Rollup:
    """A written roll-up, with the columns of ``like``; a table without rows has no files."""
    def read(table: DataFrame, name: str) -> DataFrame:
        return spark.read.schema(table.schema).parquet(f"{path}/{name}")

    return Rollup(read(like.daily, "daily"), read(like.residual, "residual"))


def _together(rollup: DataFrame | Rollup, added: DataFrame, distinct, *by: str,
              name: str) -> DataFrame:
    """Sums of the daily counts, and distinct events of the residual, per ``by``."""
    sums = added.groupBy(*by).agg(F.sum("cases").alias(name))
    if not isinstance(rollup, Rollup):
        return sums
    others = (distinct(rollup.residual).groupBy(*by)
              .agg(F.count_distinct("event_id").alias(name)))
    return sums.unionByName(others).groupBy(*by).agg(F.sum(name).alias(name))


def _daily(rollup: DataFrame | Rollup) -> DataFrame:
    return rollup.daily if isinstance(rollup, Rollup) else rollup


def weekly_table_from_rollup(rollup: DataFrame | Rollup, *, weeks: int = 10,
                             compare: str = "previous", iso_year: bool = False,
                             by: str = "weeks") -> DataFrame:
    """The weekly table, read from the roll-up."""
    columns = week_columns(by, iso_year)
    added = _daily(rollup).select("cases", *columns)
    counts = _together(rollup, added, lambda rows: rows.select("event_id", *columns),
                       *(c for c in added.columns if c != "cases"), name="weekly_cases")
    return newest_weeks(with_running(counts, compare), weeks)


def map_cumulative_from_rollup(rollup: DataFrame | Rollup, org: DataFrame) -> DataFrame:
    """All cases per valid district, read from the roll-up."""
    def placed(rows: DataFrame) -> DataFrame:
        return (add_places(rows, org, keep=valid_district())
                .withColumnRenamed("district_name", "district"))

    per_place = _daily(rollup).groupBy(ORG_KEY).agg(F.sum("cases").alias("cases"))
    return (_together(rollup, placed(per_place),
                      lambda rows: placed(rows.select("event_id", ORG_KEY)), "district",
                      name="total_cases")
            .orderBy(F.desc("total_cases"), "district"))


def top_districts_from_rollup(rollup: DataFrame | Rollup, org: DataFrame, *,
                              k: int = 12) -> DataFrame:
    """The district ranking, read from the roll-up."""
    days = _daily(rollup).select("event_date")
    if isinstance(rollup, Rollup):
        days = days.union(rollup.residual.select("event_date"))
    monday = days.agg(week_start(F.max("event_date")).alias("monday")).scalar()
    week, cases = week_start(F.col("event_date")), F.col("cases")
    in_last, in_previous = week == monday, week == F.date_sub(monday, 7)
    counted = (_daily(rollup).select(ORG_KEY, "died", "cases", in_last.alias("in_last"),
                                     in_previous.alias("in_previous"))
               .groupBy(ORG_KEY, "died", "in_last", "in_previous")
               .agg(F.sum("cases").alias("cases")))
    counted = add_places(counted, org, keep=valid_district()).drop(ORG_KEY)
    if isinstance(rollup, Rollup):
        # An event is one case of each of its districts, in the last week if any row there is.
        rows = rollup.residual.select("event_id", ORG_KEY, "died", in_last.alias("in_last"),
                                      in_previous.alias("in_previous"))
        events = (add_places(rows, org, keep=valid_district()).groupBy("district_name", "event_id")
                  .agg(*(F.max(c).alias(c) for c in ("died", "in_last", "in_previous")))
                  .drop("event_id").withColumn("cases", F.lit(1).cast("bigint")))
        counted = counted.unionByName(events)

    def of(when=F.lit(True)):
        return F.coalesce(F.sum(F.when(when, cases)), F.lit(0))

    died, last = F.col("died"), F.col("in_last")
    counted = (counted.groupBy(F.col("district_name").alias("district"))
               .agg(of().alias("total_cases"), of(died).alias("total_deaths"),
                    of(last).alias("cases_last_epiweek"),
                    of(last & died).alias("deaths_last_epiweek"),
                    of(F.col("in_previous")).alias("cases_previous")))
    change = ratios.pct_change(F.col("cases_last_epiweek"), F.col("cases_previous"))
    return (counted.withColumn("pct_change", change)
            .orderBy(F.desc("total_cases"), F.desc("cases_last_epiweek"), "district").limit(k)
            .drop("cases_previous"))


def daily_sketches(fact: DataFrame, definition: CaseDefinition, *, scope: Scope = Scope(),
                   size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of the events and persons of each day and place.

    They can be united over any days and places, which distinct counts can not.
    """
    return (case_rows(fact, definition, scope).groupBy("event_date", ORG_KEY)
            .agg(F.hll_sketch_agg("event_id", F.lit(size)).alias("events"),
                 F.hll_sketch_agg(PERSON, F.lit(size)).alias("persons")))


def unique_by_district(source: DataFrame, org: DataFrame, definition: CaseDefinition, *,
                       scope: Scope = Scope(), unique: str = "exact") -> DataFrame:
    """Distinct events and persons of the period per valid district.

    ``unique="exact"`` counts the rows of the fact ``source``; ``unique="sketch"`` estimates from
    :func:`daily_sketches`, whose error does not grow with the period.
    """
    keep = valid_district() & at_place(scope)
    if unique == "exact":
        rows = case_rows(source, definition, scope).select("event_id", PERSON, ORG_KEY)
        placed = add_districts(rows, org, keep)
        counts = [placed.groupBy(DISTRICT_KEY).agg(F.count_distinct(column).alias(name))
                  for column, name in (("event_id", "events"), (PERSON, "persons"))]
        counted = counts[0].join(counts[1], DISTRICT_KEY)
    elif unique == "sketch":
        counted = add_districts(within(source, scope).drop("event_date"), org, keep).groupBy(
            DISTRICT_KEY).agg(*(F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name)
                                for name in ("events", "persons")))
    else:
        raise ValueError(f"unique is 'exact' or 'sketch', not {unique!r}")
    return name_districts(counted, org).orderBy(F.desc("events"), "district")
