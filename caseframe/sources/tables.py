"""The star as Parquet, laid out for the filters every report starts with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.operators.names import (
    ATTRIBUTE_ID, ATTRIBUTE_NAME, ELEMENT_ID, ELEMENT_NAME, Names)
from caseframe.schemas import DIM_ORG, ENTITY_ATTR, FACT_EVENT


@dataclass(frozen=True)
class Star:
    """The three tables of the warehouse, and its dictionaries of names if it has them."""

    fact: DataFrame
    attributes: DataFrame
    org: DataFrame
    names: Names | None = None


def read_star(spark: SparkSession, path: str) -> Star:
    """Read a star written by :func:`write_star`; the year column is found as a partition.

    A star without dictionaries is read without names.
    """
    def read(schema: T.StructType, name: str) -> DataFrame:
        # Partition columns come last in files; the schema's order is kept.
        return spark.read.schema(schema).parquet(f"{path}/{name}").select(schema.fieldNames())

    def dictionary(schema: T.StructType, table: str, *columns: str) -> DataFrame:
        fields = T.StructType([schema[c] for c in columns])
        return spark.read.schema(fields).parquet(f"{path}/{table}_names")

    try:
        names = Names(dictionary(FACT_EVENT, "fact_event", ELEMENT_ID, ELEMENT_NAME),
                      dictionary(ENTITY_ATTR, "entity_attr", ATTRIBUTE_ID, ATTRIBUTE_NAME))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        names = None
    with_year = T.StructType([*FACT_EVENT.fields, T.StructField("event_year", T.IntegerType())])
    return Star(read(with_year, "fact_event"), read(ENTITY_ATTR, "entity_attr"),
                read(DIM_ORG, "dim_org"), names)


def spread_by(rows: DataFrame, *keys: str, files: int | None = None) -> DataFrame:
    """Spread rows over ranges of the keys; equal keys are split by the rows' numbers.

    A key with a third of all rows thus goes to many tasks, next to one another.
    """
    numbered = rows.withColumn("row_number", F.monotonically_increasing_id())
    ranges = (*keys, "row_number")
    spread = (numbered.repartitionByRange(files, *ranges) if files
              else numbered.repartitionByRange(*ranges))
    return spread.drop("row_number")


def write_names(rows: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    """Write the dictionary of a table, each id with each of its names once.

    Rows that are added bring their names along; a name may then be there twice.
    """
    rows.select(*columns).distinct().coalesce(1).write.mode(mode).parquet(f"{path}_names")


def write_fact(fact: DataFrame, path: str, *, files: int | None = None,
               mode: str = "overwrite") -> None:
    """Write the fact by data element and year.

    Rows are spread by ranges of element, year and event, so that an element with a third
    of all rows is written by many tasks, and sorted by value and date within a file,
    so that a case definition and a period skip row groups. The dictionary of element names
    is written beside it, and first, so that no reader finds rows that it does not know.
    """
    write_names(fact, path, ELEMENT_ID, ELEMENT_NAME, mode=mode)
    order = ("data_element_id", "event_year")
    rows = fact.withColumn("event_year", F.year("event_date"))
    (spread_by(rows, *order, "event_id", files=files)
     .sortWithinPartitions(*order, "data_value", "event_date")
     .write.mode(mode).partitionBy(*order).parquet(path))


def write_attributes(attributes: DataFrame, path: str, *, files: int | None = None,
                     mode: str = "overwrite") -> None:
    """Write the person attributes by attribute, each spread over ranges of persons.

    Their dictionary of names is written beside them, and first.
    """
    write_names(attributes, path, ATTRIBUTE_ID, ATTRIBUTE_NAME, mode=mode)
    keys = ("attribute_id", "entity_id")
    (spread_by(attributes, *keys, files=files).sortWithinPartitions(*keys)
     .write.mode(mode).partitionBy("attribute_id").parquet(path))


def write_star(star: Star, path: str, *, files: int | None = None) -> None:
    write_fact(star.fact, f"{path}/fact_event", files=files)
    write_attributes(star.attributes, f"{path}/entity_attr", files=files)
    star.org.write.mode("overwrite").parquet(f"{path}/dim_org")
