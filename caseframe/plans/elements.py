"""Profiles of the data elements that case events carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions.text import DEMOGRAPHIC_WORDS, mentions
from caseframe.model import CaseDefinition
from caseframe.operators.cases import case_rows

#: Rows that a task holds, on average, when rows meet their events.
TASK_ROWS = 1_000_000


def sample_events(fact: DataFrame, definition: CaseDefinition, events: int) -> DataFrame:
    """The case events with the lowest ids, so that a sample can be repeated."""
    return (case_rows(fact, definition, dated=False).select("event_id").distinct()
            .orderBy("event_id").limit(events))


def _of_events(fact: DataFrame, definition: CaseDefinition, events: int | None,
               told: Column | None = None) -> DataFrame:
    """Rows of all case events, or of a sample of that many; ``told`` picks out rows.

    The rows of all events are counted and dealt by event to so many tasks that none holds more of
    them as the fact grows; their shuffled bytes do not tell, as ids and names shrink to little.
    """
    rows = fact if told is None else fact.filter(told)
    if events is None:
        chosen = case_rows(fact, definition, dated=False).select("event_id")
        tasks = rows.count() // TASK_ROWS + 1
        if tasks > 1:
            chosen = chosen.repartition(tasks, "event_id").hint("shuffle_hash")
        return rows.join(chosen, "event_id", "left_semi")
    sample = sample_events(fact, definition, events)
    # The greatest id of the sample reaches the scan, which skips the files beyond it.
    up_to_sample = F.col("event_id") <= sample.agg(F.max("event_id")).scalar()
    return rows.filter(up_to_sample).join(F.broadcast(sample), "event_id", "left_semi")


def _demographic(fact: DataFrame, definition: CaseDefinition, events: int | None,
                 words: tuple[str, ...]) -> DataFrame:
    return _of_events(fact, definition, events, mentions(F.col("data_element_display_name"), words))


def profile_demographic_elements(fact: DataFrame, definition: CaseDefinition, *,
                                 words: tuple[str, ...] = DEMOGRAPHIC_WORDS) -> DataFrame:
    """Elements whose name hints at age or sex, over all case events: events, distinct values."""
    rows = _demographic(fact, definition, None, words)
    events = rows.groupBy("data_element_display_name").agg(
        F.count_distinct("event_id").alias("event_count"))
    values = (rows.select("data_element_display_name", "data_value").distinct()
              .groupBy("data_element_display_name").agg(F.count("data_value").alias("unique_values")))
    return (events.join(values, "data_element_display_name")
            .orderBy(F.desc("event_count"), "data_element_display_name"))


def profile_demographic_values(fact: DataFrame, definition: CaseDefinition, *,
                               words: tuple[str, ...] = DEMOGRAPHIC_WORDS) -> DataFrame:
    """The values of those elements, whole and one to a row, with their case events."""
    return (_demographic(fact, definition, None, words)
            .groupBy("data_element_display_name", "data_value")
            .agg(F.count_distinct("event_id").alias("event_count")))


def profile_demographic_sample(fact: DataFrame, definition: CaseDefinition, *,
                               events: int = 100,
                               words: tuple[str, ...] = DEMOGRAPHIC_WORDS,
                               width: int | None = None, separator: str = " | ") -> DataFrame:
    """The same over a sample of case events, with the values as one line.

    Values are made distinct before they are listed, so the list is built from one row per
    value and not per event; ``width`` cuts them.
    """
    rows = _demographic(fact, definition, events, words)
    counted = rows.groupBy("data_element_display_name").agg(
        F.count_distinct("event_id").alias("event_count"))
    values = rows.select("data_element_display_name", "data_value").distinct()
    value = "data_value" if width is None else f"substr(data_value, 1, {int(width)})"
    sample = F.expr(f"listagg(DISTINCT {value}, '{separator}') WITHIN GROUP (ORDER BY {value})")
    listed = values.groupBy("data_element_display_name").agg(
        F.count("data_value").alias("unique_values"), sample.alias("sample_values"))
    return (counted.join(listed, "data_element_display_name")
            .orderBy(F.desc("event_count"), "data_element_display_name"))


def profile_all_elements(fact: DataFrame, definition: CaseDefinition, *,
                         events: int | None = None, k: int = 20) -> DataFrame:
    """Elements that most case events carry, over all of them or a sample."""
    return (_of_events(fact, definition, events)
            .groupBy("data_element_display_name")
            .agg(F.count_distinct("event_id").alias("event_count"))
            .orderBy(F.desc("event_count"), "data_element_display_name").limit(k))
