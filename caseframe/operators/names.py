"""Data elements and attributes found by their names.

A star has a dictionary per table: each id with each of its names. What a name must hold is first
asked of the dictionary, so the scan of the rows, which are filed by id, opens the folders of the
found ids only, and never those of the other ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.operators.sizes import join_dimension

ELEMENT_ID, ELEMENT_NAME = "data_element_id", "data_element_display_name"
ATTRIBUTE_ID, ATTRIBUTE_NAME = "attribute_id", "display_name"


@dataclass(frozen=True, eq=False)
class Names:
    """The dictionaries of a star: (data_element_id, data_element_display_name) of the fact, and
    (attribute_id, display_name) of the person attributes."""

    elements: DataFrame
    attributes: DataFrame


def _named(rows: DataFrame, dictionary: DataFrame | None, key: str, name: str,
           told: Callable[[Column], Column]) -> DataFrame:
    named = rows.filter(told(F.col(name)))
    if dictionary is None:
        return named
    ids = dictionary.filter(told(F.col(name))).select(key).distinct()
    return join_dimension(named, ids, dictionary, key, "left_semi")


def elements_named(fact: DataFrame, told: Callable[[Column], Column],
                   names: Names | None) -> DataFrame:
    """Rows whose element name is as ``told`` asks; without dictionaries all rows are read."""
    return _named(fact, names and names.elements, ELEMENT_ID, ELEMENT_NAME, told)


def attributes_named(attributes: DataFrame, told: Callable[[Column], Column],
                     names: Names | None) -> DataFrame:
    """Rows whose attribute name is as ``told`` asks; without dictionaries all rows are read."""
    return _named(attributes, names and names.attributes, ATTRIBUTE_ID, ATTRIBUTE_NAME, told)
