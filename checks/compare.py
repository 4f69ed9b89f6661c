"""Compare a report with its SQL: same columns, same rows whatever their order."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import queries

TEST_TABLES = ("region", "nation", "customer", "orders", "lineitem", "events")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TEST_TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple((type(row[i]).__name__, _plain(row[i])) for i in order) for row in rows)


def differences(spark: SparkSession, connection: duckdb.DuckDBPyConnection, name: str,
                sf_dir: str) -> str | None:
    """What differs between report and SQL, or None."""
    frame = queries()[name](spark, sf_dir)
    answer = connection.execute(ORACLES[name])
    expected_columns = [column[0] for column in answer.description]
    if sorted(frame.columns) != sorted(expected_columns):
        return f"columns {sorted(frame.columns)} and {sorted(expected_columns)}"
    got = _bag(frame.columns, frame.collect())
    expected = _bag(expected_columns, answer.fetchall())
    if got == expected:
        return None
    return (f"only in Spark {list((got - expected).items())[:3]}, "
            f"only in SQL {list((expected - got).items())[:3]}")
