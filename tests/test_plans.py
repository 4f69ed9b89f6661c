"""The physical plans: what is shuffled, what is broadcast, and that Spark does the work."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caseframe.operators import sizes
from caseframe.operators.sifting import sift
from caseframe.operators.persons import person_traits
from caseframe.plans import districts, maps, people, weekly
from checks.queries import REPORTS, STAR_REPORTS
from checks.star import URGENT, tables, written_star
from tests.test_sources import plan_of

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def star(spark):
    return tables(spark, SF_DIR)


def shuffles(plan):
    """Keys of the hash exchanges, column numbers left out."""
    keys = re.findall(r"Arguments: hashpartitioning\((.*?), \d+\)", plan)
    return [tuple(sorted(re.sub(r"#\d+L?", "", key) for key in found.split(", "))) for found in keys]


@pytest.mark.parametrize("name", [
    "executive_summary", "top_districts", "weekly_by_sex", "district_epicurves", "age_sex_by_name",
    "demographic_breakdown", "deaths_by_age_sex", "profile_demographic_elements", "daily_rollup",
    "map_bins_attack_rate", "location_options"])
def test_no_python_and_no_cross_product_of_tables(star, name):
    plan = plan_of(REPORTS[name](star))
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_event_traits_meet_in_one_shuffle(star):
    """Traits are sifted where they are read; nothing but the grouping goes by the event."""
    plan = plan_of(people.event_traits(star.fact, URGENT, F.lit("2001-01-01").cast("date")))
    assert [keys for keys in shuffles(plan) if "event_id" in keys] == [("event_id",)]
    assert "SortMergeJoin" not in plan


def test_person_traits_need_one_shuffle_and_no_join(star):
    plan = plan_of(person_traits(star.attributes, sex="SEX", age="AGE", outcome="OUTCOME"))
    assert shuffles(plan) == [("tracked_entity_instance_id",)]
    assert "Join" not in plan and "SortAggregate" not in plan


def test_case_rows_are_shuffled_once_by_event_and_district_number(star):
    plan = plan_of(maps.map_cumulative_cases(star.fact, star.org, URGENT))
    assert [keys for keys in shuffles(plan) if "event_id" in keys or "o_orderkey" in keys] == [
        ("district_key", "event_id")]


def test_ranking_never_joins_raw_case_rows_with_outcomes(star):
    plan = plan_of(districts.top_districts(star.fact, star.org, URGENT))
    assert ("district_key", "event_id") in shuffles(plan)
    assert plan.count("Expand") == 0


def test_other_elements_are_not_read(star):
    plan = plan_of(weekly.weekly_counts(star.fact, URGENT))
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.MULTILINE)) == 1
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan


def test_large_hierarchies_are_not_broadcast(star, monkeypatch):
    monkeypatch.setattr(sizes, "within_rows", lambda table, limit=0: False)
    rows = star.fact.select("event_id", "dim_org_hierarchy_key")
    joined = sizes.join_dimension(rows, star.org.hint("merge"), star.org, "dim_org_hierarchy_key")
    assert ("dim_org_hierarchy_key", "salt") in shuffles(plan_of(joined))


NAMED = {"data_element_id": ("top_districts_star", "top_districts_totals_star", "daily_rollup_star",
                             "demographic_breakdown_star"),
         "attribute_id": ("total_deaths_star", "deaths_by_district_text_star", "age_sex_by_name_star",
                          "executive_summary_star")}


def scans(plan, folder):
    """Partition filters of the scans of a folder of the written star."""
    found = re.findall(r"Scan parquet.*?(?=\n\n)", plan, re.DOTALL)
    return [s.split("PartitionFilters: [")[1].split("]\n")[0] if "PartitionFilters" in s else ""
            for s in found if f"/{folder}]" in s]


@pytest.mark.parametrize(("column", "name"), [(c, n) for c, names in NAMED.items() for n in names])
def test_names_prune_the_folders_of_the_star(spark, column, name):
    plan = plan_of(STAR_REPORTS[name](written_star(spark, SF_DIR)))
    for filters in scans(plan, "fact_event" if column == "data_element_id" else "entity_attr"):
        assert column in filters
    assert "dynamicpruning" in plan


def test_case_rows_of_traits_are_pruned_by_element_and_year(spark):
    star = written_star(spark, SF_DIR)
    plan = plan_of(STAR_REPORTS["demographic_breakdown_star"](star))
    filters = scans(plan, "fact_event")
    assert len(filters) >= 2 and all("data_element_id" in f for f in filters)
    assert sum("event_year" in f for f in filters) >= 1 and " OR " not in "".join(filters)


def test_sift_keeps_all_wanted_rows_and_few_others(spark):
    """Cases are one event in a hundred: of the others hardly any gets to the shuffle."""
    rows = spark.range(200_000).select(F.col("id").alias("event_id"), F.lit("x").alias("value"))
    rows = rows.unionByName(spark.createDataFrame([(None, "y")], "event_id long, value string"))
    keys = spark.range(0, 200_000, 100).select(F.col("id").alias("event_id"))
    passed = sift(rows, keys, "event_id")
    assert passed.columns == ["event_id", "value"]
    assert passed.join(keys, "event_id", "left_semi").count() == 2_000
    assert passed.count() <= 1.1 * 2_000
    assert sift(rows, keys.limit(0), "event_id").count() == 0


def test_star_without_dictionaries_gives_the_same(spark):
    star = written_star(spark, SF_DIR)
    assert star.names is not None
    with_names = people.age_sex_by_name(star.fact, star.attributes, URGENT, names=star.names)
    assert with_names.collect() == people.age_sex_by_name(star.fact, star.attributes, URGENT).collect()
