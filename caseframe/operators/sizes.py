"""Joins with tables that are usually small, and the check that they are."""

from __future__ import annotations

import time
from typing import NamedTuple
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a broadcast table may have. Both are counted, as rows may be wide.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20
SALTS = 32
# How long a size that was found is relied on: a table may grow under its DataFrame.
RECHECK_SECONDS = 300.0


class Checked(NamedTuple):
    """Rows and bytes found when no more than ``limit + 1`` rows were read, and when."""

    limit: int
    rows: int
    size: int
    at: float


_checked: WeakKeyDictionary[DataFrame, Checked] = WeakKeyDictionary()


def _width(field: T.StructField) -> Column:
    """Bytes of a value: those of a text, of a nested value as JSON, eight of any other."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return F.lit(8)


def within_rows(table: DataFrame, limit: int = BROADCAST_ROWS,
                most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the table has at most ``limit`` rows and ``most_bytes`` bytes.

    No more rows than that are read. The answer is kept with the DataFrame for some minutes, so
    reports that share a dimension check it once.
    """
    known = _checked.get(table)
    now = time.monotonic()
    if known is None or now - known.at > RECHECK_SECONDS or (
            known.limit < limit and known.rows > known.limit):
        width = sum(map(_width, table.schema.fields), F.lit(0))
        found = (table.limit(limit + 1).select(width.cast("bigint").alias("width"))
                 .agg(F.count("*").alias("rows"), F.sum("width").alias("size")).first())
        known = _checked[table] = Checked(limit, found["rows"], found["size"] or 0, now)
    return known.rows <= limit and known.size <= most_bytes


def join_dimension(rows: DataFrame, table: DataFrame, small_from: DataFrame, key: str,
                   how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``rows`` with a dimension, whose key many rows may share.

    ``table`` holds a part of ``small_from``, the table whose rows and bytes are checked. Within
    the limits it is broadcast and the rows stay where they are. Beyond it both
    sides are shuffled on the key and a salt, each dimension row once per salt, so
    a place with a third of all rows is spread over many tasks. Either way gives the
    same rows; equal ones are all kept.
    """
    if within_rows(small_from, limit):
        return rows.join(F.broadcast(table), key, how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    salted = rows.withColumn("salt", salt)
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "salt"], how).drop("salt")
