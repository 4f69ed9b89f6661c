"""District shapes from a GeoJSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = """
    features ARRAY<STRUCT<
        properties: STRUCT<name: STRING>,
        geometry: STRING>>
"""


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``geometry`` (as JSON text) of every feature with a name.

    The schema is given, so the file is read once; a feature collection is one JSON
    document and the only thing here that a single task reads whole.
    """
    collection = spark.read.schema(FEATURES).option("multiLine", True).json(path)
    return (collection.select(F.explode("features").alias("feature"))
            .select(F.col("feature.properties.name").alias("name"),
                    F.col("feature.geometry").alias("geometry"))
            .filter(F.col("name").isNotNull()))
