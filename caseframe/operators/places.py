"""Places: which count as districts, and how cases get theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseframe.model import Scope
from caseframe.operators.sizes import join_dimension
from caseframe.schemas import DISTRICT_KEY, ORG_KEY

# Names that are no real district.
UNKNOWN_DISTRICTS = ("Unknown", "Unknown District")
TEST_MARK = "Test District"
UNKNOWN_REGION = "unknown"


def named_district() -> Column:
    return F.col("district_name").isNotNull()


def valid_district() -> Column:
    """A named district that is neither a placeholder nor a test site."""
    name = F.col("district_name")
    return name.isNotNull() & ~name.isin(*UNKNOWN_DISTRICTS) & ~name.contains(TEST_MARK)


def at_place(scope: Scope) -> Column:
    """Places of the scope; the name is plain text, not a pattern."""
    if not scope.has_place:
        return F.lit(True)
    column = "region_name" if scope.level == "region" else "district_name"
    return F.lower(F.col(column)).contains(scope.place.lower())


def add_places(rows: DataFrame, org: DataFrame, names: tuple[str, ...] = ("district_name",),
               keep: Column | None = None) -> DataFrame:
    """Rows with the names of their place; rows of places not kept fall away."""
    places = (org if keep is None else org.filter(keep)).select(ORG_KEY, *names)
    return join_dimension(rows, places, org, ORG_KEY)


def number_districts(org: DataFrame) -> DataFrame:
    """The hierarchy with a number per district: the least key among its places.

    Reports do this on the way; a hierarchy that is kept in memory can have it done.
    """
    if DISTRICT_KEY in org.columns:
        return org
    least = F.min(ORG_KEY).over(Window.partitionBy("district_name"))
    return org.withColumn(DISTRICT_KEY, least)


def add_districts(rows: DataFrame, org: DataFrame, keep: Column,
                  listed: DataFrame | None = None) -> DataFrame:
    """Rows with the number of their district in place of the place's key.

    Cases are grouped and shuffled by that number; names come back in
    :func:`name_districts`, when one row per district is left. ``listed`` is a short
    list of district names, and rows of other districts never get to the shuffle.
    """
    places = number_districts(org).filter(keep)
    if listed is not None:
        names = F.broadcast(listed.toDF("district_name"))
        places = places.join(names, "district_name", "left_semi")
    return join_dimension(rows, places.select(ORG_KEY, DISTRICT_KEY), org, ORG_KEY).drop(ORG_KEY)


def name_districts(counts: DataFrame, org: DataFrame, name: str = "district") -> DataFrame:
    """Counts by district number, with the district's name in its place."""
    names = org.select(F.col(ORG_KEY).alias(DISTRICT_KEY), F.col("district_name").alias(name))
    named = join_dimension(counts, names, org, DISTRICT_KEY)
    return named.select(name, *(c for c in counts.columns if c != DISTRICT_KEY))


def only_places(rows: DataFrame, org: DataFrame, scope: Scope) -> DataFrame:
    """Rows at the scope's places; a national scope keeps rows of unlisted places too."""
    if not scope.has_place:
        return rows
    return add_places(rows, org, (), at_place(scope))
