"""Calendar expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    """Monday of the ISO week, in plain date arithmetic (no time zone involved)."""
    return F.date_sub(day, F.weekday(day))


def week_number(monday: Column) -> Column:
    """Weeks since a fixed Monday: neighbours differ by one, also across a new year."""
    return F.floor(F.datediff(monday, F.lit("1900-01-01").cast("date")) / 7).cast("int")


def epi_week(day: Column) -> Column:
    """ISO-8601 week number."""
    return F.weekofyear(day)


def epi_year(day: Column, iso_year: bool = False) -> Column:
    """Calendar year paired with the ISO week, or the ISO week's own year."""
    return F.year(F.date_add(week_start(day), 3)) if iso_year else F.year(day)


def age_in_years(birth: Column, reference: Column) -> Column:
    """Completed years between two dates; a 29 February birthday waits for 1 March."""
    before_birthday = (F.month(reference) * 100 + F.dayofmonth(reference)
                       < F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(reference) - F.year(birth) - before_birthday.cast("int")
