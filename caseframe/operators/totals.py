"""Small helpers over results that are already down to weeks or districts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_of(value: str | Column, *by: str) -> Column:
    """Sum over the whole result, or over its rows with equal ``by`` columns."""
    return F.sum(value).over(Window.partitionBy(*by))


def one_row(*frames: DataFrame) -> DataFrame:
    """Lay single-row results side by side."""
    first, *rest = frames
    for frame in rest:
        first = first.crossJoin(F.broadcast(frame))
    return first
