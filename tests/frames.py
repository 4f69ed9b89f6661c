"""Hand-written stars for tests."""

import datetime as dt

from caseframe.model import AttributeCodes, CaseDefinition
from caseframe.schemas import DIM_ORG, ENTITY_ATTR, FACT_EVENT

FLU = CaseDefinition("DX", "flu")
CODES = AttributeCodes(sex="SEX", age="AGE", outcome="OUT", death_sex="SEX2")


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


def fact(spark, rows):
    """Rows of (event, person, date, org[, element id, element name, value])."""
    full = [(e, p, day(d), o, *(rest or ("DX", "Diagnosis", "flu")))
            for e, p, d, o, *rest in rows]
    return spark.createDataFrame(full, FACT_EVENT)


def attributes(spark, rows):
    """Rows of (person, attribute id, value[, name])."""
    full = [(p, a, rest[0] if rest else a, v) for p, a, v, *rest in rows]
    return spark.createDataFrame(full, ENTITY_ATTR)


def org(spark, rows=((1, "North District", "Up"), (2, "South District", "Down"),
                     (3, "Unknown", "Down"), (4, "2 Test District", "Up"), (5, None, None))):
    return spark.createDataFrame([(k, d, r, 3) for k, d, r in rows], DIM_ORG)


def rows_of(frame):
    return [tuple(row) for row in frame.collect()]
