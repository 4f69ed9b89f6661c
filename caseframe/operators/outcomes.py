"""Deaths recorded on events and on persons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.functions.text import (
    death_attribute, death_outcome, is_death_attribute, is_outcome_element)
from caseframe.operators.names import Names, attributes_named, elements_named
from caseframe.schemas import PERSON


def dead_events(fact: DataFrame, outcome_elements: Sequence[str] | None = None,
                names: Names | None = None) -> DataFrame:
    """Events with an outcome element that tells a death, one row each.

    Elements are found by name; their ids, given or from the dictionaries, let the scan skip
    the others.
    """
    rows = elements_named(fact, is_outcome_element, names)
    if outcome_elements:
        rows = rows.filter(F.col("data_element_id").isin(list(outcome_elements)))
    told = death_outcome(F.col("data_element_display_name"), F.col("data_value"))
    return rows.filter(told).select("event_id").distinct()


def dead_persons(attributes: DataFrame, names: Names | None = None) -> DataFrame:
    """Persons with an attribute about death that says so, one row each."""
    told = death_attribute(F.col("display_name"), F.col("attribute_value"))
    return attributes_named(attributes, is_death_attribute, names).filter(told).select(F.col("entity_id").alias(PERSON)).distinct()
