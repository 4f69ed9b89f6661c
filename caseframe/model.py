"""Parameters shared by every report: what a case is, whom and where to count."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

MONTHS = ("January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December")


@dataclass(frozen=True)
class CaseDefinition:
    """A fact row is a case when this data element holds this value."""

    element_id: str
    value: str


@dataclass(frozen=True)
class AttributeCodes:
    """Attribute ids of a person's sex, age and outcome.

    ``death_sex`` is the sex attribute to use among deaths, for registries that
    record it under a second id; it falls back to ``sex``.
    """

    sex: str
    age: str
    outcome: str
    death_sex: str | None = None

    @property
    def sex_of_deaths(self) -> str:
        return self.death_sex or self.sex


# The case definition and attribute ids of the measles registry.
MEASLES = CaseDefinition("qIlO7yEpiVv", "Measles (B05.0_B05.9)")
MEASLES_CODES = AttributeCodes(
    sex="Rq4qM2wKYFL",
    age="UezutfURtQG",
    outcome="ulE2j2pFgDl",
    death_sex="FZzQbW8AWVd",
)


@dataclass(frozen=True)
class Scope:
    """Place and period a report is limited to.

    ``place`` is matched as a case-insensitive part of the region or district
    name, whichever ``level`` says. ``start`` and ``end`` are inclusive and
    narrow the year and month further.
    """

    level: str = "national"
    place: str | None = None
    year: int | None = None
    month: int | None = None
    start: dt.date | None = None
    end: dt.date | None = None

    def __post_init__(self) -> None:
        if self.level not in ("national", "region", "district"):
            raise ValueError(f"unknown level {self.level!r}")
        if self.level != "national" and not self.place:
            raise ValueError(f"level {self.level!r} needs a place")
        if self.month is not None and self.year is None:
            raise ValueError("a month needs a year")
        if self.month is not None and not 1 <= self.month <= 12:
            raise ValueError(f"month {self.month} is not in 1-12")

    @property
    def has_place(self) -> bool:
        return self.level != "national"

    def first_day(self) -> dt.date | None:
        """First day of the period, or None when it is open to the left."""
        days = [self.start] if self.start else []
        if self.year is not None:
            days.append(dt.date(self.year, self.month or 1, 1))
        return max(days, default=None)

    def last_day(self) -> dt.date | None:
        """Last day of the period, or None when it is open to the right."""
        days = [self.end] if self.end else []
        if self.year is not None:
            following = (dt.date(self.year + 1, 1, 1) if self.month in (None, 12)
                         else dt.date(self.year, self.month + 1, 1))
            days.append(following - dt.timedelta(days=1))
        return min(days, default=None)


@dataclass(frozen=True)
class ReportParams:
    """Text parameters of a report request, turned into a :class:`Scope`.

    ``month`` takes ``all``, 1-12, a month name or its first three letters; other
    text means all months, as does ``month=None``. A year that is no number
    falls back to ``default_year``. ``location`` is ``national``, or a name that
    ends in "Region" or "District"; any other name is taken as a district.
    """

    year: str | int | None = None
    month: str | int | None = None
    location: str | None = None
    default_year: int | None = None

    def year_number(self) -> int | None:
        try:
            return int(self.year)
        except (TypeError, ValueError):
            return self.default_year

    def month_number(self) -> int | None:
        text = str(self.month or "all").strip().lower()
        if text.isdigit():
            return int(text) if 1 <= int(text) <= 12 else None
        for number, name in enumerate(MONTHS, start=1):
            if text in (name.lower(), name[:3].lower()):
                return number
        return None

    def scope(self) -> Scope:
        year = self.year_number()
        month = self.month_number() if year is not None else None
        place = (self.location or "national").strip()
        if place.lower() in ("", "national"):
            return Scope(year=year, month=month)
        for level in ("region", "district"):
            if place.lower().endswith(f" {level}"):
                return Scope(level, place[: -len(level) - 1].strip(), year, month)
        return Scope("district", place, year, month)
