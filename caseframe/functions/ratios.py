"""Shares, rates and changes; a zero denominator gives null, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def percent_or_zero(part: Column, whole: Column, digits: int) -> Column:
    return F.coalesce(percent(part, whole, digits), F.lit(0.0))


def pct_change(current: Column, previous: Column) -> Column:
    """Change against the previous count in percent; null without a previous count."""
    return percent(current - previous, previous, 1)


def rate(cases: Column, denominator: Column, per: int = 100_000) -> Column:
    return F.round(F.try_divide(cases * F.lit(float(per)), denominator), 2)
