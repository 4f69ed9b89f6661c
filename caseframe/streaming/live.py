"""Streaming counterparts of the weekly curve and the 24-hour count.

Streams have no exact distinct count, so events are deduplicated by id within the
watermark and then counted in panes, a week or an hour long. Rows later than that are
dropped here and come in with the next batch snapshot. The session time zone must be
UTC: window edges are UTC instants.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseframe.sources.workdir import new_folder

UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00")
PANES = "pane_start timestamp, pane_end timestamp, cases bigint"
HOURS = 24


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"streams need the session time zone UTC, not {zone}")


def unique_cases(stream: DataFrame, case: Column, *, time: str = "ts",
                 key: str = "event_id", lateness: str = "2 days") -> DataFrame:
    """Case events of a stream, each id once within the watermark."""
    require_utc(stream.sparkSession)
    return (stream.filter(case)
            .select(key, F.col(time).cast("timestamp").alias(time))
            .withWatermark(time, lateness)
            .dropDuplicatesWithinWatermark([key]))


def _panes(cases: DataFrame, pane: Column) -> DataFrame:
    return (cases.groupBy(pane.alias("pane")).agg(F.count("*").alias("cases"))
            .select(F.col("pane.start").alias("pane_start"), F.col("pane.end").alias("pane_end"),
                    "cases"))


@dataclass(frozen=True, eq=False)
class LiveCount:
    """Cases per pane of a stream, and the result that is read from the panes.

    Panes that the watermark has passed are appended to the table once and leave the state:
    the file sink logs the files of each batch by its number, so a batch that runs again adds
    nothing, and readers see whole batches only. Panes that are still open are read from the
    state. So the state holds the panes within the watermark, however long the stream runs.
    """

    panes: DataFrame
    result: Callable[[DataFrame], DataFrame]

    def follow(self, folder: str) -> None:
        """Take in what the stream's sources hold now; call again for more."""
        query = (self.panes.writeStream.format("parquet").outputMode("append")
                 .option("path", f"{folder}/closed")
                 .option("checkpointLocation", f"{folder}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    def table(self, spark: SparkSession, folder: str) -> DataFrame:
        """The result as it stands after the last batch; empty before the first."""
        return self.result(closed_panes(spark, folder).unionByName(open_panes(spark, folder)))


def closed_panes(spark: SparkSession, folder: str) -> DataFrame:
    """The panes that no event can change any more."""
    if not _has_batches(spark, folder):
        return spark.createDataFrame([], PANES)
    return spark.read.schema(PANES).parquet(f"{folder}/closed")


def open_panes(spark: SparkSession, folder: str) -> DataFrame:
    """The panes in the state of the last batch."""
    if not _has_batches(spark, folder):
        return spark.createDataFrame([], PANES)
    checkpoint = f"{folder}/checkpoint"
    counting = (spark.read.format("state-metadata").load(checkpoint)
                .filter(F.col("operatorName") == "stateStoreSave").first())
    state = (spark.read.format("statestore").option("operatorId", counting["operatorId"])
             .load(checkpoint))
    pane = F.col("key")[state.schema["key"].dataType.names[0]]
    return state.select(pane["start"].alias("pane_start"), pane["end"].alias("pane_end"),
                        F.col("value")["count"].alias("cases"))


def _has_batches(spark: SparkSession, folder: str) -> bool:
    """Whether a batch was committed; the log of commits is a file per batch."""
    commits = f"{folder}/checkpoint/commits"
    try:
        return not spark.read.text(commits, pathGlobFilter="[0-9]*").isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def live_epi_curve(stream: DataFrame, case: Column, *, time: str = "ts",
                   key: str = "event_id", lateness: str = "2 days") -> LiveCount:
    """Cases per Monday-based week: week_start, weekly_cases."""
    # The epoch was a Thursday; four days later weeks start on Monday.
    week = F.window(time, "7 days", startTime="4 days")
    cases = unique_cases(stream, case, time=time, key=key, lateness=lateness)
    return LiveCount(_panes(cases, week), lambda panes: panes.select(
        F.col("pane_start").cast("date").alias("week_start"),
        F.col("cases").alias("weekly_cases")))


def live_rolling_24h(stream: DataFrame, case: Column, *, time: str = "ts",
                     key: str = "event_id", lateness: str = "2 days") -> LiveCount:
    """Cases in each 24-hour window with any, a window ending every hour: window_end, cases_24h.

    The stream counts hours, so an event is in one pane; windows are put together from the
    hours when the result is read.
    """
    cases = unique_cases(stream, case, time=time, key=key, lateness=lateness)
    return LiveCount(_panes(cases, F.window(time, "1 hour")), rolling_day)


def rolling_day(panes: DataFrame, hours: int = HOURS) -> DataFrame:
    """Sums over the hourly panes of so many hours up to each hour, where there are cases."""
    counted = panes.select(F.floor(F.unix_seconds("pane_end") / 3600).alias("hour"), "cases")
    ends = counted.agg(F.min("hour").alias("first"), (F.max("hour") + hours - 1).alias("last"))
    every = (ends.filter(F.col("first").isNotNull())
             .select(F.explode(F.sequence("first", "last")).alias("hour")))
    frame = Window.orderBy("hour").rangeBetween(1 - hours, 0)
    return (every.join(counted, "hour", "left")
            .select("hour", F.sum("cases").over(frame).alias("cases_24h"))
            .filter(F.col("cases_24h") > 0)
            .select(F.timestamp_seconds(F.col("hour") * 3600).alias("window_end"), "cases_24h"))


def settled(spark: SparkSession, live: LiveCount, folder: str | None = None) -> DataFrame:
    """The whole result over what the stream's sources hold now."""
    folder = folder or new_folder(spark, "live")
    live.follow(folder)
    return live.table(spark, folder)
