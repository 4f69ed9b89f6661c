"""Stars derived from the test tables; ``checks/oracles.py`` has the same in SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.model import AttributeCodes, CaseDefinition
from caseframe.operators.places import number_districts
from caseframe.schemas import DISTRICT_KEY, ORG_KEY, PERSON
from caseframe.sources.tables import Star, read_star, write_star
from caseframe.sources.workdir import new_folder

URGENT = CaseDefinition("DX", "1-URGENT")
RETURNED = CaseDefinition("DX", "R")
BORN = CaseDefinition("DOB", "1975-02-15")
CODES = AttributeCodes(sex="SEX", age="AGE", outcome="OUTCOME")


@dataclass(frozen=True)
class Tables:
    """Two event facts, person attributes, places, map shapes and population.

    ``fact`` has one date and place per event. ``visits`` is unruly: its events have
    several dates, places and persons, and some of its place keys are unknown; the
    outcomes are those of ``fact``.
    ``contacts`` holds repeated attributes, ``conflicts`` sexes that contradict for some persons.
    """

    fact: DataFrame
    visits: DataFrame
    attributes: DataFrame
    contacts: DataFrame
    conflicts: DataFrame
    org: DataFrame
    shapes: DataFrame
    population: DataFrame


def fact_of(orders: DataFrame) -> DataFrame:
    """Four data elements per order, as an entity-attribute-value fact."""
    key = F.col("o_orderkey")
    year = (1950 + key % 45).cast("string")
    day = (10 + key % 19).cast("string")
    died = (F.col("o_orderstatus") == "F") & (key % 10 == 3)
    birth = (F.when(key % 5 == 0, F.concat(year, F.lit("-02-"), day))
             .when(key % 5 == 1, F.concat(day, F.lit("/07/"), year))
             .when(key % 5 == 2, (key % 70).cast("string"))
             .when(key % 5 == 3, F.concat((1 + key % 11).cast("string"), F.lit(" months")))
             .otherwise(F.concat((key % 60).cast("string"), F.lit(" years"))))
    sex = (F.when(key % 7 == 0, "n/a").when(key % 7 == 1, "MALE").when(key % 7 == 2, "Female")
           .when(key % 7 == 3, "male").otherwise("female"))

    def element(code: str, name: str, value: Column) -> DataFrame:
        return orders.select(
            key.alias("event_id"),
            F.when(key % 97 != 0, F.col("o_custkey")).alias(PERSON),
            F.when(key % 101 != 0, F.col("o_orderdate").cast("date")).alias("event_date"),
            F.floor(F.sqrt(key % 625)).cast("int").alias(ORG_KEY),
            F.lit(code).alias("data_element_id"),
            F.lit(name).alias("data_element_display_name"),
            value.alias("data_value"))

    return (element("DX", "Diagnosis", F.col("o_orderpriority"))
            .unionByName(element("OUT", "Case outcome",
                                 F.when(died, "Died").otherwise("Recovered")))
            .unionByName(element("DOB", "Date of birth", birth))
            .unionByName(element("SEX", "Sex of patient", sex)))


def visits_of(lineitem: DataFrame) -> DataFrame:
    """One diagnosis row per line item: the lines of an order are one event."""
    return lineitem.select(
        F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias(PERSON),
        F.col("l_shipdate").cast("date").alias("event_date"),
        (F.col("l_suppkey") % 30).cast("int").alias(ORG_KEY),
        F.lit("DX").alias("data_element_id"),
        F.lit("Diagnosis").alias("data_element_display_name"),
        F.col("l_returnflag").alias("data_value"))


def attributes_of(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    sex = (F.when(key % 5 == 0, "Male").when(key % 5 == 1, "Female").when(key % 5 == 2, "male")
           .when(key % 5 == 3, "FEMALE").otherwise("other"))

    def attribute(code: str, name: str, value: Column) -> DataFrame:
        return customer.select(
            key.alias("entity_id"), F.lit(code).alias("attribute_id"),
            F.lit(name).alias("display_name"), value.alias("attribute_value"))

    age = F.when(key % 13 == 0, "n/a").otherwise((key % 71).cast("string"))
    outcome = F.when(key % 11 == 0, "Dead").otherwise("Alive")
    return (attribute("AGE", "Age in years", age)
            .unionByName(attribute("SEX", "Sex", sex))
            .unionByName(attribute("OUTCOME", "Outcome (death)", outcome)))


def contacts_of(orders: DataFrame) -> DataFrame:
    """An attribute row per order: most customers have several."""
    return orders.select(
        F.col("o_custkey").alias("entity_id"), F.lit("STATUS").alias("attribute_id"),
        F.lit("Contact status").alias("display_name"),
        F.col("o_orderstatus").alias("attribute_value"))


def conflicts_of(orders: DataFrame) -> DataFrame:
    """A sex per order: some orders of a customer tell another one."""
    male = (F.col("o_custkey") % 2 == 0) != (F.col("o_orderkey") % 13 == 0)
    return orders.select(
        F.col("o_custkey").alias("entity_id"), F.lit("SEX").alias("attribute_id"),
        F.lit("Sex").alias("display_name"),
        F.when(male, "Male").otherwise("female").alias("attribute_value"))


def org_of(nation: DataFrame, region: DataFrame) -> DataFrame:
    key = F.col("n_nationkey")
    name = (F.when(key == 24, "Unknown").when(key == 23, "1 Test District")
            .otherwise(F.concat("n_name", F.lit(" District"))))
    districts = (nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
                 .select(key.alias(ORG_KEY), name.alias("district_name"),
                         F.col("r_name").alias("region_name"), F.lit(3).alias("leaf_level")))
    nationwide = nation.agg(
        F.lit(-1).alias(ORG_KEY), F.lit("National").alias("district_name"),
        F.lit(None).cast("string").alias("region_name"), F.lit(1).alias("leaf_level"))
    return districts.unionByName(nationwide)


def shapes_of(nation: DataFrame) -> DataFrame:
    """Map shapes: some districts have none, and some shapes have no district."""
    key = F.col("n_nationkey")
    name = (F.when(key == 22, "Lake District")
            .otherwise(F.concat("n_name", F.lit(" District"))))
    return nation.select(
        name.alias("name"), F.lit('{"type":"Point"}').alias("geometry"))


def population_of(customer: DataFrame) -> DataFrame:
    """People by district, sex and age band, counted from the customers' balances."""
    key = F.col("c_custkey")
    return (customer.groupBy(
        F.concat(F.lit("NATION_"), F.col("c_nationkey"), F.lit(" District"))
        .alias("district_name"),
        F.when(key % 2 == 0, "Male").otherwise("Female").alias("sex"),
        F.when(key % 3 == 0, "0-4").when(key % 3 == 1, "5-14").otherwise("50+")
        .alias("age_group"))
        .agg((F.count("*") * 1000).alias("population")))


def geojson_of(nation: DataFrame, path: str) -> None:
    """The districts as one GeoJSON text, a point for each."""
    key = F.col("n_nationkey")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.concat("n_name", F.lit(" District")).alias("name")).alias("properties"),
        F.when(key % 5 != 0, F.struct(F.lit("Point").alias("type"), F.array(key, key + 1)
                                      .alias("coordinates"))).alias("geometry"))
    features = F.sort_array(F.collect_list(feature)).alias("features")
    (nation.agg(features).select(F.to_json(F.struct(
        F.lit("FeatureCollection").alias("type"), "features"), {"ignoreNullFields": "false"}))
     .write.text(path))


@lru_cache(maxsize=8)
def written_star(spark: SparkSession, sf_dir: str) -> Star:
    """The fact, attributes and places of :func:`tables`, written as a star and read back."""
    given = tables(spark, sf_dir)
    path = new_folder(spark, "star")
    write_star(Star(given.fact, given.attributes, given.org.drop(DISTRICT_KEY)), path)
    return read_star(spark, path)


@lru_cache(maxsize=8)
def tables(spark: SparkSession, sf_dir: str) -> Tables:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders, customer, nation = read("orders"), read("customer"), read("nation")
    fact = fact_of(orders)
    outcomes = fact.filter(F.col("data_element_id") == "OUT")
    return Tables(
        fact=fact, visits=visits_of(read("lineitem")).unionByName(outcomes),
        attributes=attributes_of(customer), contacts=contacts_of(orders),
        conflicts=conflicts_of(orders),
        org=number_districts(org_of(nation, read("region"))).cache(), shapes=shapes_of(nation),
        population=population_of(customer))
