"""Every report as a query over the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions.bands import (
    ATTACK_RATE, CUMULATIVE_CASES, CURRENT_RATE, RECENT_CASES)
from caseframe.model import ReportParams, Scope
from caseframe.plans import (
    choices, cube, deaths, districts, elements, maps, people, quality, rollup, summary, weekly)
from caseframe.operators.places import named_district
from caseframe.plans.report import situation_report
from caseframe.sources.geojson import read_shapes
from caseframe.sources.tables import Star
from caseframe.sources.workdir import new_folder
from caseframe.streaming import live
from caseframe.streaming.snapshot import Snapshot
from checks.star import (
    BORN, CODES, RETURNED, URGENT, Tables, fact_of, geojson_of, tables, written_star)

Query = Callable[[SparkSession, str], DataFrame]

ASIA = Scope("region", "Asia", year=1997)
NATION_5 = Scope("district", "nation_5")
MARCH_1996 = Scope(year=1996, month=3)
ASIA_1998 = Scope("region", "Asia", year=1998)
SPRING = Scope(start=dt.date(1999, 3, 1), end=dt.date(1999, 6, 15))
BACK_THEN = dt.date(1998, 6, 30)
MARCH_REQUEST = ReportParams(year="1996", month="mar", location="Asia Region")
ASIA_REQUEST = ReportParams(year="1997", month="all", location="Asia Region")


def _on(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(tables(spark, sf_dir))


def _layer(t: Tables, values: DataFrame, value: str, classes) -> DataFrame:
    return maps.map_bins(maps.map_layer(t.shapes, values, value, classes), "value", classes)


def _top(t: Tables, **options) -> DataFrame:
    return districts.top_districts(t.fact, t.org, URGENT, **options)


def _ages(t: Tables, **options) -> DataFrame:
    return people.age_sex_distribution(t.fact, t.org, t.attributes, URGENT, CODES, **options)


def _rollup(t: Tables) -> DataFrame:
    return rollup.daily_rollup(t.fact, t.attributes, URGENT, CODES)


def _exact_rollup(t: Tables) -> rollup.Rollup:
    return rollup.exact_rollup(t.visits, t.attributes, RETURNED, CODES)


REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    # one-row summaries
    "cases_last_24h": lambda t: summary.cases_last_24h(t.fact, URGENT),
    "summary_stats": lambda t: summary.summary_stats(t.fact, t.org, URGENT),
    "summary_stats_between": lambda t: summary.summary_stats(
        t.fact, t.org, URGENT, scope=SPRING, as_of=dt.date(1999, 5, 31)),
    "summary_stats_visits": lambda t: summary.summary_stats(t.visits, t.org, RETURNED),
    "executive_summary": lambda t: summary.executive_summary(
        t.fact, t.org, t.attributes, URGENT),
    "executive_summary_as_of": lambda t: summary.executive_summary(
        t.fact, t.org, t.attributes, URGENT, as_of=dt.date(1998, 6, 30)),
    # weeks
    "weekly_table": lambda t: weekly.weekly_table(t.fact, URGENT, by="rows"),
    "weekly_table_next": lambda t: weekly.weekly_table(
        t.fact, URGENT, compare="next", by="rows"),
    "weekly_table_iso_year": lambda t: weekly.weekly_table(
        t.fact, URGENT, weeks=400, iso_year=True, by="rows"),
    "weekly_table_visits": lambda t: weekly.weekly_table(
        t.visits, RETURNED, weeks=60, by="rows"),
    "weekly_table_year": lambda t: weekly.weekly_table_year(
        t.fact, URGENT, year=1997, by="rows"),
    "weekly_table_last_year": lambda t: weekly.weekly_table_year(t.fact, URGENT, by="rows"),
    "weekly_table_year_bounds": lambda t: weekly.weekly_table_year(
        t.fact, URGENT, year=1999, start=SPRING.start, end=SPRING.end, compare="next",
        by="rows"),
    "weekly_table_weeks": lambda t: weekly.weekly_table(t.fact, URGENT, weeks=400),
    "weekly_table_gaps": lambda t: weekly.weekly_table(t.fact, BORN, weeks=400),
    "weekly_table_gaps_next": lambda t: weekly.weekly_table(
        t.fact, BORN, weeks=400, compare="next"),
    "weekly_table_year_weeks": lambda t: weekly.weekly_table_year(t.fact, URGENT, year=1997),
    "weekly_table_last_year_weeks": lambda t: weekly.weekly_table_year(t.fact, URGENT, weeks=60),
    "weekly_moving_average": lambda t: weekly.weekly_moving_average(t.fact, t.org, URGENT),
    "weekly_moving_average_region": lambda t: weekly.weekly_moving_average(
        t.fact, t.org, URGENT, scope=ASIA),
    "weekly_moving_average_filled": lambda t: weekly.weekly_moving_average(
        t.fact, t.org, URGENT, scope=NATION_5, weeks=100, fill_gaps=True),
    "weekly_by_sex": lambda t: weekly.weekly_by_sex(
        t.fact, t.org, t.attributes, URGENT, CODES),
    "weekly_by_sex_region": lambda t: weekly.weekly_by_sex(
        t.fact, t.org, t.attributes, URGENT, CODES, scope=ASIA),
    "weekly_by_sex_conflicts": lambda t: weekly.weekly_by_sex(
        t.fact, t.org, t.conflicts, URGENT, CODES),
    "district_epicurves": lambda t: weekly.district_epicurves(t.fact, t.org, URGENT),
    "district_epicurves_year": lambda t: weekly.district_epicurves(
        t.fact, t.org, URGENT, year=1998),
    "district_weekly_share": lambda t: weekly.district_weekly_share(t.fact, t.org, URGENT),
    "district_weekly_share_month": lambda t: weekly.district_weekly_share(
        t.fact, t.org, URGENT, scope=MARCH_1996),
    # districts
    "top_districts": _top,
    "top_districts_year": lambda t: _top(t, scope=Scope(year=1998)),
    "top_districts_visits": lambda t: districts.top_districts(t.visits, t.org, RETURNED),
    "top_districts_totals": lambda t: districts.top_districts_totals(_top(t)),
    "district_total_share": lambda t: districts.district_total_share(t.fact, t.org, URGENT),
    "district_total_share_month": lambda t: districts.district_total_share(
        t.fact, t.org, URGENT, scope=MARCH_1996),
    "district_reporting": lambda t: districts.district_reporting(t.fact, t.org, URGENT),
    "district_reporting_region": lambda t: districts.district_reporting(
        t.fact, t.org, URGENT, scope=Scope("region", "Asia", year=1996, month=3)),
    "district_reporting_21d": lambda t: districts.district_reporting(
        t.fact, t.org, URGENT, days=21),
    "district_reporting_24h": lambda t: districts.district_reporting(
        t.fact, t.org, URGENT, hours=24),
    "district_reporting_request": lambda t: districts.district_reporting(
        t.fact, t.org, URGENT, scope=MARCH_REQUEST.scope()),
    "district_line_summary": lambda t: districts.district_line_summary(t.fact, t.org, URGENT),
    "district_line_summary_visits": lambda t: districts.district_line_summary(
        t.visits, t.org, RETURNED, as_of=dt.date(2000, 6, 30)),
    # places and periods to choose from
    "location_options": lambda t: choices.location_options(
        t.fact, t.org, URGENT, keep=named_district()),
    "location_options_valid": lambda t: choices.location_options(t.fact, t.org, URGENT),
    "time_period_options": lambda t: choices.time_period_options(t.fact, URGENT),
    "time_period_options_nested": lambda t: choices.time_period_options(
        t.fact, URGENT, nested=True).select("year", F.concat_ws(
            ", ", F.transform("months", lambda m: m["display"])).alias("months")),
    "hierarchical_locations": lambda t: choices.hierarchical_locations(t.org),
    # age and sex
    "age_sex_by_name": lambda t: people.age_sex_by_name(t.fact, t.attributes, URGENT),
    "demographic_breakdown": lambda t: people.demographic_breakdown(t.fact, URGENT),
    "demographic_breakdown_between": lambda t: people.demographic_breakdown(
        t.fact, URGENT, scope=SPRING, as_of=dt.date(2000, 2, 29)),
    "gender_distribution": lambda t: people.gender_distribution(
        t.fact, t.org, t.attributes, URGENT, CODES),
    "gender_distribution_region": lambda t: people.gender_distribution(
        t.fact, t.org, t.attributes, URGENT, CODES, scope=ASIA),
    "gender_distribution_conflicts": lambda t: people.gender_distribution(
        t.fact, t.org, t.conflicts, URGENT, CODES),
    "age_sex_distribution": _ages,
    "age_sex_distribution_district": lambda t: _ages(t, scope=NATION_5),
    "age_sex_percentages": lambda t: people.age_sex_percentages(_ages(t)),
    "age_sex_rate": lambda t: people.age_sex_rate(
        t.fact, t.org, t.attributes, URGENT, CODES),
    "age_sex_rate_population": lambda t: people.age_sex_rate(
        t.fact, t.org, t.attributes, URGENT, CODES, scope=Scope(year=1999),
        population=t.population),
    # deaths
    "total_deaths": lambda t: deaths.total_deaths(t.fact, t.attributes, URGENT),
    "deaths_by_district_text": lambda t: deaths.deaths_by_district_text(
        t.fact, t.org, t.attributes, URGENT, keep=named_district()),
    "deaths_by_district": lambda t: deaths.deaths_by_district(
        t.fact, t.org, t.attributes, URGENT, CODES, keep=named_district()),
    "deaths_by_district_valid": lambda t: deaths.deaths_by_district(
        t.fact, t.org, t.attributes, URGENT, CODES),
    "deaths_by_district_region": lambda t: deaths.deaths_by_district(
        t.fact, t.org, t.attributes, URGENT, CODES, scope=ASIA_1998, keep=named_district()),
    "deaths_by_age": lambda t: deaths.deaths_by_age(
        t.fact, t.org, t.attributes, URGENT, CODES),
    "deaths_by_age_region": lambda t: deaths.deaths_by_age(
        t.fact, t.org, t.attributes, URGENT, CODES, scope=ASIA_1998),
    "deaths_by_age_persons": lambda t: deaths.deaths_by_age(
        t.fact, t.org, t.attributes, URGENT, CODES, unit="persons"),
    "deaths_by_age_sex": lambda t: deaths.deaths_by_age_sex(
        t.fact, t.org, t.attributes, URGENT, CODES),
    "deaths_by_age_sex_visits": lambda t: deaths.deaths_by_age_sex(
        t.visits, t.org, t.attributes, RETURNED, CODES, unit="events"),
    "mortality_summary": lambda t: deaths.mortality_summary(deaths.deaths_by_district(
        t.fact, t.org, t.attributes, URGENT, CODES, keep=named_district())),
    "mortality_summary_valid": lambda t: deaths.mortality_summary(deaths.deaths_by_district(
        t.fact, t.org, t.attributes, URGENT, CODES)),
    # maps
    "map_cumulative_cases": lambda t: maps.map_cumulative_cases(t.fact, t.org, URGENT),
    "map_cumulative_cases_visits": lambda t: maps.map_cumulative_cases(
        t.visits, t.org, RETURNED),
    "map_cases_21d": lambda t: maps.map_cases_21d(t.fact, t.org, URGENT),
    "map_cases_21d_as_of": lambda t: maps.map_cases_21d(
        t.fact, t.org, URGENT, as_of=BACK_THEN),
    "map_attack_rate": lambda t: maps.map_attack_rate(t.fact, t.org, URGENT),
    "map_attack_rate_population": lambda t: maps.map_attack_rate(
        t.fact, t.org, URGENT, population=t.population),
    "map_case_rate_21d": lambda t: maps.map_case_rate_21d(t.fact, t.org, URGENT),
    "map_layer": lambda t: maps.map_layer(
        t.shapes, maps.map_cumulative_cases(t.fact, t.org, URGENT), "total_cases",
        CUMULATIVE_CASES),
    "map_bins": lambda t: _layer(
        t, maps.map_cumulative_cases(t.fact, t.org, URGENT), "total_cases", CUMULATIVE_CASES),
    "map_bins_21d": lambda t: _layer(
        t, maps.map_cases_21d(t.fact, t.org, URGENT), "cases_last_21_days", RECENT_CASES),
    "map_bins_attack_rate": lambda t: _layer(
        t, maps.map_attack_rate(t.fact, t.org, URGENT, population=t.population),
        "attack_rate_per_100k", ATTACK_RATE),
    "map_bins_case_rate": lambda t: _layer(
        t, maps.map_case_rate_21d(t.fact, t.org, URGENT, days=365, population=t.population),
        "current_rate_per_100k", CURRENT_RATE),
    # data elements and data quality
    "profile_demographic_elements": lambda t: elements.profile_demographic_elements(
        t.fact, URGENT),
    "profile_demographic_values": lambda t: elements.profile_demographic_values(t.fact, URGENT),
    "profile_demographic_sample": lambda t: elements.profile_demographic_sample(t.fact, URGENT),
    "profile_all_elements": lambda t: elements.profile_all_elements(t.fact, URGENT),
    "profile_all_sample": lambda t: elements.profile_all_elements(t.fact, URGENT, events=50),
    "dq_multi_date_events": lambda t: quality.dq_multi_date_events(t.visits, RETURNED),
    "dq_duplicate_attributes": lambda t: quality.dq_duplicate_attributes(
        t.contacts.unionByName(t.attributes)),
    "dq_orphan_keys": lambda t: quality.dq_orphan_keys(t.visits, t.org, RETURNED),
    "dq_unmatched_geo": lambda t: quality.dq_unmatched_geo(t.shapes, t.org),
    # the cube
    "weekly_cases_from_cube": lambda t: cube.weekly_cases(
        cube.case_cube(t.visits, t.org, RETURNED)),
    "district_total_share_from_cube": lambda t: cube.district_total_share(
        cube.case_cube(t.fact, t.org, URGENT, scope=MARCH_1996), t.org),
    "district_weekly_share_from_cube": lambda t: cube.district_weekly_share(
        cube.case_cube(t.fact, t.org, URGENT, scope=MARCH_1996), t.org),
    "district_epicurves_from_cube": lambda t: cube.district_epicurves(
        cube.case_cube(t.visits, t.org, RETURNED, scope=Scope(year=1997)), t.org),
    # the roll-up
    "daily_rollup": _rollup,
    "weekly_table_from_rollup": lambda t: rollup.weekly_table_from_rollup(
        _rollup(t), by="rows"),
    "map_cumulative_from_rollup": lambda t: rollup.map_cumulative_from_rollup(
        _rollup(t), t.org),
    "top_districts_from_rollup": lambda t: rollup.top_districts_from_rollup(
        _rollup(t), t.org),
    "weekly_table_visits_from_rollup": lambda t: rollup.weekly_table_from_rollup(
        _exact_rollup(t), weeks=60, by="rows"),
    "map_cumulative_visits_from_rollup": lambda t: rollup.map_cumulative_from_rollup(
        _exact_rollup(t), t.org),
    "top_districts_visits_from_rollup": lambda t: rollup.top_districts_from_rollup(
        _exact_rollup(t), t.org),
    "unique_by_district": lambda t: rollup.unique_by_district(t.visits, t.org, RETURNED),
    "unique_by_district_month": lambda t: rollup.unique_by_district(
        t.visits, t.org, RETURNED, scope=MARCH_1996),
}


#: Reports that find elements or attributes by name, over a star with dictionaries.
STAR_REPORTS: dict[str, Callable[[Star], DataFrame]] = {
    "total_deaths_star": lambda s: deaths.total_deaths(
        s.fact, s.attributes, URGENT, names=s.names),
    "deaths_by_district_text_star": lambda s: deaths.deaths_by_district_text(
        s.fact, s.org, s.attributes, URGENT, names=s.names, keep=named_district()),
    "age_sex_by_name_star": lambda s: people.age_sex_by_name(
        s.fact, s.attributes, URGENT, names=s.names),
    "top_districts_star": lambda s: districts.top_districts(
        s.fact, s.org, URGENT, names=s.names),
    "top_districts_totals_star": lambda s: districts.top_districts_totals(
        districts.top_districts(s.fact, s.org, URGENT, names=s.names)),
    "demographic_breakdown_star": lambda s: people.demographic_breakdown(
        s.fact, URGENT, scope=SPRING, as_of=dt.date(2000, 2, 29), names=s.names),
    "executive_summary_star": lambda s: summary.executive_summary(
        s.fact, s.org, s.attributes, URGENT, names=s.names),
    "daily_rollup_star": lambda s: rollup.daily_rollup(
        s.fact, s.attributes, URGENT, CODES, names=s.names),
}


def _on_star(build: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(written_star(spark, sf_dir))


@lru_cache(maxsize=8)
def _report(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All sections of the report for a request, over the written star."""
    return situation_report(written_star(spark, sf_dir), URGENT, CODES,
                            scope=ASIA_REQUEST.scope())


def _section(name: str) -> Query:
    return lambda spark, sf_dir: _report(spark, sf_dir)[name]


def shapes_from_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "geojson")
    geojson_of(spark.read.parquet(f"{sf_dir}/nation.parquet"), path)
    return read_shapes(spark, path)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a stream; the pattern takes a single file as well as a folder.

    A stream keeps the number of state partitions it starts with, so it gets a session
    of its own with one per core.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    schema = session.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return session.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def live_epi_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = live.live_epi_curve(_stream(spark, sf_dir, "events"), F.col("event_type") == "error")
    return live.settled(spark, curve)


def live_rolling_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = live.live_rolling_24h(_stream(spark, sf_dir, "events"), F.col("event_type") == "error")
    return (live.settled(spark, counts)
            .select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "cases_24h"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = Snapshot(new_folder(spark, "snapshot"), tables(spark, sf_dir).attributes,
                        URGENT, CODES, grain="month")
    snapshot.follow(fact_of(_stream(spark, sf_dir, "orders")))
    return snapshot.table(spark)


def live_snapshot_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.weekly_table_from_rollup(_snapshot(spark, sf_dir), by="rows")


def live_snapshot_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.top_districts_from_rollup(_snapshot(spark, sf_dir), tables(spark, sf_dir).org)


def live_snapshot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.map_cumulative_from_rollup(_snapshot(spark, sf_dir), tables(spark, sf_dir).org)


def queries() -> dict[str, Query]:
    named = {name: _on(build) for name, build in REPORTS.items()}
    named |= {name: _on_star(build) for name, build in STAR_REPORTS.items()}
    named |= {f"report_{name}": _section(name) for name in (
        "weekly_moving_average", "weekly_by_sex", "gender_distribution", "top_districts")}
    named["shapes_from_geojson"] = shapes_from_geojson
    named |= {"live_epi_curve": live_epi_curve, "live_rolling_24h": live_rolling_24h,
              "live_snapshot_weekly": live_snapshot_weekly,
              "live_snapshot_districts": live_snapshot_districts,
              "live_snapshot_map": live_snapshot_map}
    return named
