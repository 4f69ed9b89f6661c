"""Age bands and value classes, kept as an index until the result is labelled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


@dataclass(frozen=True)
class AgeScheme:
    """Adjacent bands, each with its label and the age in years it starts at."""

    bands: tuple[tuple[str, int], ...]

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(label for label, _ in self.bands)

    @property
    def unknown_index(self) -> int:
        return len(self.bands) + 1

    def index(self, age: Column) -> Column:
        """1-based band number; the number after the last band means unknown."""
        number = F.lit(1)
        for position, (_, start) in enumerate(self.bands[1:], start=2):
            number = F.when(age >= start, position).otherwise(number)
        return F.when(age.isNull(), self.unknown_index).otherwise(number)

    def label(self, index: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.labels + (UNKNOWN,))), index)


# The age schemes of the reports.
EIGHT_BANDS = AgeScheme((
    ("0-4", 0), ("5-9", 5), ("10-14", 10), ("15-19", 15),
    ("20-29", 20), ("30-39", 30), ("40-49", 40), ("50+", 50)))
ELEVEN_BANDS = AgeScheme((
    ("0-4", 0), ("5-9", 5), ("10-14", 10), ("15-19", 15), ("20-24", 20), ("25-29", 25),
    ("30-34", 30), ("35-39", 35), ("40-44", 40), ("45-49", 45), ("50+", 50)))
TEN_BANDS = AgeScheme((
    ("0-4", 0), ("5-14", 5), ("15-19", 15), ("20-24", 20), ("25-29", 25),
    ("30-34", 30), ("35-39", 35), ("40-44", 40), ("45-49", 45), ("50+", 50)))
FIVE_BANDS = AgeScheme((
    ("<1 year", 0), ("1-4 years", 1), ("5-14 years", 5),
    ("15-44 years", 15), ("45+ years", 45)))


@dataclass(frozen=True)
class ValueClasses:
    """Half-open classes of a map value; a missing value or zero is class "0"."""

    classes: tuple[tuple[str, float], ...]
    scale_floor: int

    def index(self, value: Column) -> Column:
        number = F.lit(1)
        for position, (_, start) in enumerate(self.classes[1:], start=2):
            number = F.when(value >= start, position).otherwise(number)
        return F.when(F.coalesce(value, F.lit(0)) > 0, number).otherwise(0)

    def label(self, index: Column) -> Column:
        names = ("0",) + tuple(name for name, _ in self.classes)
        return F.element_at(F.array(*map(F.lit, names)), index + 1)


# Map classes and the least upper end of each colour scale.
CUMULATIVE_CASES = ValueClasses(
    (("1-9", 1), ("10-49", 10), ("50-99", 50), ("100-499", 100), ("500+", 500)), 500)
RECENT_CASES = ValueClasses((("1-9", 1), ("10-49", 10), ("50+", 50)), 50)
ATTACK_RATE = ValueClasses(
    (("0.1-4.9", 0), ("5-10.9", 5), ("11-15.9", 11), ("16-20.9", 16), ("21+", 21)), 25)
CURRENT_RATE = ValueClasses((("0.1-4.9", 0), ("5-10.9", 5), ("11+", 11)), 11)
