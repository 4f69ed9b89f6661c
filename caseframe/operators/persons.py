"""Persons: their first events and their attributes.

Attributes come as one row per person and attribute. They are normalised to
integers and flags before they are grouped, so a single hash aggregation on the
person replaces one join per attribute, and repeated rows of a person can not
multiply the cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.functions.text import coded_death, one_sex, sex_by_substring, whole_number
from caseframe.model import CaseDefinition, Scope
from caseframe.operators.cases import case_rows, in_period
from caseframe.operators.places import only_places
from caseframe.schemas import ORG_KEY, PERSON

#: Persons whose traits are broadcast at most, and rows from which a person is one of them.
FREQUENT_PERSONS = 1_000
FREQUENT_ROWS = 100_000


def first_events(fact: DataFrame, org: DataFrame, definition: CaseDefinition,
                 scope: Scope = Scope()) -> DataFrame:
    """Incident cases: the first case date of each person at each place.

    The period applies to that first date. Grouping combines on the map side, so
    a person with very many rows is cut to one row per place and task.
    """
    rows = case_rows(fact, definition).select(PERSON, ORG_KEY, "event_date")
    firsts = (only_places(rows, org, scope)
              .groupBy(PERSON, ORG_KEY)
              .agg(F.min("event_date").alias("first_event_date")))
    period = in_period(scope, "first_event_date")
    return firsts if period is None else firsts.filter(period)


def join_traits(rows: DataFrame, traits: DataFrame) -> DataFrame:
    """Rows with the traits of their person, NULL where there are none.

    Rows without a person go round the join, so no task gets all of them for one key.
    """
    known = rows.filter(F.col(PERSON).isNotNull()).join(traits, PERSON, "left")
    return known.unionByName(rows.filter(F.col(PERSON).isNull()), allowMissingColumns=True)


def join_traits_of_many(rows: DataFrame, traits: DataFrame, most: int = FREQUENT_PERSONS,
                        least: int = FREQUENT_ROWS) -> DataFrame:
    """As :func:`join_traits`, for rows of which a few persons may have very many.

    Persons with at least so many rows, at most ``most`` of them, are found by a count that every
    task cuts to a short list; their traits are broadcast, and their rows stay where they are.
    """
    known = rows.filter(F.col(PERSON).isNotNull())
    frequent = (known.groupBy(PERSON).agg(F.count("*").alias("rows_of_person"))
                .filter(F.col("rows_of_person") >= least)
                .orderBy(F.desc("rows_of_person"), PERSON).limit(most).select(PERSON))
    few = known.join(F.broadcast(frequent), PERSON, "left_anti")
    many = known.join(F.broadcast(frequent), PERSON, "left_semi")
    theirs = traits.join(F.broadcast(frequent), PERSON, "left_semi")
    return (few.join(traits, PERSON, "left")
            .unionByName(many.join(F.broadcast(theirs), PERSON, "left"))
            .unionByName(rows.filter(F.col(PERSON).isNull()), allowMissingColumns=True))


def person_traits(attributes: DataFrame, *, sex: str | None = None, age: str | None = None,
                  outcome: str | None = None) -> DataFrame:
    """One row per person with the asked traits: ``sex_code``, ``age_years``, ``dead``.

    Of several ages the least counts; sexes that contradict are Unknown; for the outcome,
    any that says dead.
    """
    value = F.col("attribute_value")
    code = F.col("attribute_id")
    told, traits = [], []
    if sex:
        told.append(F.when((code == sex) & value.isNotNull(), sex_by_substring(value))
                    .alias("sex_code"))
        traits.append(one_sex(F.col("sex_code")).alias("sex_code"))
    if age:
        told.append(F.when(code == age, whole_number(value)).alias("age_years"))
        traits.append(F.min("age_years").alias("age_years"))
    if outcome:
        told.append(((code == outcome) & F.coalesce(coded_death(value), F.lit(False)))
                    .alias("dead"))
        traits.append(F.max("dead").alias("dead"))
    return (attributes.filter(code.isin([c for c in (sex, age, outcome) if c]))
            .select(F.col("entity_id").alias(PERSON), *told)
            .groupBy(PERSON).agg(*traits))
