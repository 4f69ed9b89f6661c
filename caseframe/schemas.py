"""Schemas of the tables the operators read."""

from pyspark.sql import types as T

ORG_KEY = "dim_org_hierarchy_key"
PERSON = "tracked_entity_instance_id"
DISTRICT_KEY = "district_key"

FACT_EVENT = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField(PERSON, T.LongType(), True),
    T.StructField("event_date", T.DateType(), True),
    T.StructField(ORG_KEY, T.IntegerType(), True),
    T.StructField("data_element_id", T.StringType(), False),
    T.StructField("data_element_display_name", T.StringType(), True),
    T.StructField("data_value", T.StringType(), True),
])

ENTITY_ATTR = T.StructType([
    T.StructField("entity_id", T.LongType(), False),
    T.StructField("attribute_id", T.StringType(), False),
    T.StructField("display_name", T.StringType(), True),
    T.StructField("attribute_value", T.StringType(), True),
])

DIM_ORG = T.StructType([
    T.StructField(ORG_KEY, T.IntegerType(), False),
    T.StructField("district_name", T.StringType(), True),
    T.StructField("region_name", T.StringType(), True),
    T.StructField("leaf_level", T.IntegerType(), False),
])

POPULATION = T.StructType([
    T.StructField("district_name", T.StringType(), True),
    T.StructField("sex", T.StringType(), True),
    T.StructField("age_group", T.StringType(), True),
    T.StructField("population", T.LongType(), True),
])
