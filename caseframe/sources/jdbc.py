"""Reading the star from a relational warehouse.

Only a source: run it once to land the tables with ``write_star``, then report from
Parquet. Reads are split on a numeric column, one query per slice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameReader, SparkSession


@dataclass(frozen=True)
class Slices:
    """How a table is read in parallel: ranges of a numeric column."""

    column: str
    lower: int
    upper: int
    count: int


@dataclass(frozen=True)
class Warehouse:
    """Connection of a JDBC database; ``options`` take user, driver and the like."""

    url: str
    options: dict[str, str] = field(default_factory=dict, repr=False)
    fetch_size: int = 10_000

    def reader(self, spark: SparkSession, table: str,
               slices: Slices | None = None) -> DataFrameReader:
        reader = (spark.read.format("jdbc").options(**self.options)
                  .option("url", self.url).option("dbtable", table)
                  .option("fetchsize", self.fetch_size))
        if slices:
            reader = (reader.option("partitionColumn", slices.column)
                      .option("lowerBound", slices.lower).option("upperBound", slices.upper)
                      .option("numPartitions", slices.count))
        return reader

    def table(self, spark: SparkSession, table: str,
              slices: Slices | None = None) -> DataFrame:
        return self.reader(spark, table, slices).load()
