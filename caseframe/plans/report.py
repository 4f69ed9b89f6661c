"""A whole situation report: the tables of all its sections for one request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from caseframe.functions import bands
from caseframe.model import AttributeCodes, CaseDefinition, Scope
from caseframe.operators.cases import AsOf, is_case
from caseframe.plans import cube, deaths, districts, maps, people, summary, weekly
from caseframe.sources.tables import Star, spread_by
from caseframe.sources.workdir import new_folder


def keep_cases(fact: DataFrame, definition: CaseDefinition) -> DataFrame:
    """The case rows alone, kept by the executors for several reports to start from.

    Serves as the fact of every report that needs no other data element. Lost parts
    are read again from the fact. Call ``unpersist`` on it when done.
    """
    return fact.filter(is_case(definition)).persist(StorageLevel.MEMORY_AND_DISK)


def write_cases(fact: DataFrame, definition: CaseDefinition) -> DataFrame:
    """The case rows alone, as a table of their own in the shared folder.

    Like :func:`keep_cases`, but nothing of it is lost with an executor. Rows are sorted by date,
    so reports for a period skip row groups.
    """
    cases = spread_by(fact.filter(is_case(definition)), "event_date", "event_id")
    return _written(cases.sortWithinPartitions("event_date"), "cases")


def _written(frame: DataFrame, purpose: str) -> DataFrame:
    path = new_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def situation_report(star: Star, definition: CaseDefinition, codes: AttributeCodes, *,
                     scope: Scope = Scope(), as_of: AsOf = None,
                     outcome_elements: Sequence[str] | None = None,
                     cases: DataFrame | None = None,
                     shapes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sections of a report by name; each is computed when it is read.

    The summary, the weekly and district tables and the maps cover all cases, the other
    sections the scope. ``cases`` is the result of :func:`keep_cases`, or else they are written
    to a table first: the fact is scanned for them once, whatever sections are read, and then
    for outcomes only. With ``shapes`` the map sections have a row for every shape, with its
    class.
    """
    fact, org, persons = star.fact, star.org, star.attributes
    few = write_cases(fact, definition) if cases is None else cases
    people_of = (few, org, persons, definition, codes)
    ranking = districts.top_districts(fact, org, definition, outcome_elements=outcome_elements,
                                      names=star.names, cases=few)
    sections = {
        "executive_summary": summary.executive_summary(few, org, persons, definition,
                                                       as_of=as_of, names=star.names),
        "weekly_table": weekly.weekly_table(few, definition),
        "age_sex_percentages": people.age_sex_percentages(
            people.age_sex_distribution(*people_of)),
        "top_districts": districts.top_districts_totals(ranking),
        "reporting": districts.district_reporting(few, org, definition, scope=scope),
        "reporting_21d": districts.district_reporting(few, org, definition, scope=scope,
                                                      days=21, as_of=as_of),
        "reporting_24h": districts.district_reporting(few, org, definition, scope=scope,
                                                      hours=24, as_of=as_of),
        "weekly_moving_average": weekly.weekly_moving_average(few, org, definition, scope=scope),
        "weekly_by_sex": weekly.weekly_by_sex(few, org, persons, definition, codes, scope=scope),
        "district_epicurves": weekly.district_epicurves(few, org, definition, year=scope.year,
                                                        as_of=as_of),
        "district_weekly_share": weekly.district_weekly_share(few, org, definition, scope=scope,
                                                              as_of=as_of),
        "district_total_share": districts.district_total_share(few, org, definition, scope=scope),
        "gender_distribution": people.gender_distribution(*people_of, scope=scope),
        "age_sex_rate": people.age_sex_rate(*people_of, scope=scope),
        "deaths_by_district": deaths.deaths_by_district(*people_of, scope=scope),
        "deaths_by_age": deaths.deaths_by_age(*people_of, scope=scope),
        "deaths_by_age_sex": deaths.deaths_by_age_sex(*people_of, scope=scope),
    }
    if scope.year is not None:
        # One period for all: shares are read from a cube of it, counted once.
        counted = _written(cube.case_cube(few, org, definition, scope=scope), "cube")
        sections["district_weekly_share"] = cube.district_weekly_share(counted, org)
        sections["district_total_share"] = cube.district_total_share(counted, org)
    layers = {
        "map_cumulative_cases": (maps.map_cumulative_cases(few, org, definition),
                                 "total_cases", bands.CUMULATIVE_CASES),
        "map_cases_21d": (maps.map_cases_21d(few, org, definition, as_of=as_of),
                          "cases_last_21_days", bands.RECENT_CASES),
        "map_attack_rate": (maps.map_attack_rate(few, org, definition),
                            "attack_rate_proxy_per_100k", bands.ATTACK_RATE),
        "map_case_rate_21d": (maps.map_case_rate_21d(few, org, definition, as_of=as_of),
                              "current_rate_proxy_per_100k", bands.CURRENT_RATE),
    }
    for name, (values, value, classes) in layers.items():
        sections[name] = values if shapes is None else maps.map_bins(
            maps.map_layer(shapes, values, value, classes), "value", classes)
    return sections
