"""Case rows of the event fact, and the periods they are limited to.

Every filter here compares a plain column with a literal or a scalar subquery,
so it reaches the Parquet scan; years and months are date ranges for the same
reason. A fact table laid out by ``event_year`` is pruned by that column too.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.model import CaseDefinition, Scope

AsOf = dt.date | dt.datetime | str | None


def is_case(definition: CaseDefinition) -> Column:
    return ((F.col("data_element_id") == definition.element_id)
            & (F.col("data_value") == definition.value))


def in_period(scope: Scope, day: str = "event_date") -> Column | None:
    """Date-range predicate of the scope, or None when the period is open."""
    bounds = []
    if scope.first_day():
        bounds.append(F.col(day) >= F.lit(scope.first_day()))
    if scope.last_day():
        bounds.append(F.col(day) <= F.lit(scope.last_day()))
    if not bounds:
        return None
    return bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]


def _prune_years(rows: DataFrame, first: Column | None, last: Column | None) -> DataFrame:
    if "event_year" in rows.columns:
        if first is not None:
            rows = rows.filter(F.col("event_year") >= F.year(first))
        if last is not None:
            rows = rows.filter(F.col("event_year") <= F.year(last))
    return rows


def within(rows: DataFrame, scope: Scope) -> DataFrame:
    """Rows whose event date falls in the scope's period."""
    period = in_period(scope)
    if period is None:
        return rows
    first, last = scope.first_day(), scope.last_day()
    return _prune_years(rows.filter(period),
                        None if first is None else F.lit(first),
                        None if last is None else F.lit(last))


def case_rows(fact: DataFrame, definition: CaseDefinition, scope: Scope = Scope(),
              dated: bool = True) -> DataFrame:
    """Fact rows that are cases in the scope's period; not yet one row per event."""
    rows = fact.filter(is_case(definition))
    if dated:
        rows = rows.filter(F.col("event_date").isNotNull())
    return within(rows, scope)


def until(fact: DataFrame, as_of: AsOf) -> DataFrame:
    """Rows that are not dated after the day; without a day, all."""
    if as_of is None:
        return fact
    day = F.col("event_date")
    return fact.filter(day.isNull() | (day <= F.lit(as_of).cast("date")))


def report_date(fact: DataFrame, definition: CaseDefinition, as_of: AsOf = None,
                move: Callable[[Column], Column] = lambda day: day,
                scope: Scope = Scope()) -> Column:
    """The date a report is drawn up for, moved by ``move``.

    It is the given date, or else the last case date as a scalar subquery: the
    moved value is computed inside it, so that a comparison with an event date is
    still pushed into the scan when the subquery has run.
    """
    if as_of is not None:
        return move(F.lit(as_of).cast("date"))
    last = case_rows(fact, definition, scope).agg(
        move(F.max("event_date")).alias("report_date"))
    return last.scalar()


def since(rows: DataFrame, fact: DataFrame, definition: CaseDefinition, as_of: AsOf = None,
          *, days: int = 0, months: int = 0) -> DataFrame:
    """Rows from some days or months before the report date up to that date.

    The first day counts in, so one day back covers two calendar days.
    """
    def back(day: Column) -> Column:
        return F.date_sub(F.add_months(day, -months), days)

    first = report_date(fact, definition, as_of, back)
    rows = _prune_years(rows.filter(F.col("event_date") >= first), first, None)
    if as_of is not None:
        rows = rows.filter(F.col("event_date") <= F.lit(as_of).cast("date"))
    return rows


def since_hours(rows: DataFrame, fact: DataFrame, definition: CaseDefinition,
                hours: int, as_of: AsOf = None) -> DataFrame:
    """Rows from some hours before the report time; a date counts as its midnight.

    So the bound is a date, the first one whose midnight is in time, and reaches the scan.
    """
    def back(moment: Column) -> Column:
        start = moment.cast("timestamp") - F.make_interval(hours=F.lit(hours))
        day = start.cast("date")
        return F.when(start > day.cast("timestamp"), F.date_add(day, 1)).otherwise(day)

    if as_of is not None:
        end = F.lit(as_of).cast("timestamp")
        first, last = back(end), end.cast("date")
        rows = rows.filter(F.col("event_date") <= last)
    else:
        first, last = report_date(fact, definition, None, back), None
    return _prune_years(rows.filter(F.col("event_date") >= first), first, last)
