"""A daily roll-up that follows a stream of fact rows.

The rows of an event are filed under every period in which it is a case, whatever date they bear
themselves; rows of events without a case wait in loose files by a hash of the event. An index by
the same hash tells where an event is filed. So a refresh reads the index buckets of the events
it brings and the periods that it counts anew, and no other landed row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.model import AttributeCodes, CaseDefinition
from caseframe.operators.cases import case_rows
from caseframe.plans.rollup import daily_rollup, period_of, write_rollup
from caseframe.sources.tables import spread_by

#: Buckets of the index; more keep a refresh with few events small, and cost a file each.
BUCKETS = 64

INDEX = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("filed", T.StringType())])


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None],
                  checkpoint: str) -> None:
    """Process what the sources hold now, batch by batch, then stop."""
    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _kept(frame: DataFrame, path: str) -> DataFrame:
    """The frame, written to a path that the same batch may write again, and read from there."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Snapshot:
    """A roll-up in a folder, brought up to date batch by batch.

    A batch writes under its number and reads what lower numbers wrote, so one that was cut off
    can simply be run again. Rows are written before the index names them. Of each event that a
    batch touches, every period in which it is or was a case is counted anew, from rows that are
    all filed there; so an outcome that comes late, without a date or dated elsewhere still
    reaches its case. Nothing is taken from the roll-up itself.
    """

    def __init__(self, folder: str, attributes: DataFrame, definition: CaseDefinition,
                 codes: AttributeCodes, grain: str = "day", buckets: int = BUCKETS) -> None:
        self.rows = f"{folder}/rows"
        self.index = f"{folder}/index"
        self.rollup = f"{folder}/rollup"
        self.steps = f"{folder}/steps"
        self.checkpoint = f"{folder}/checkpoint"
        self.attributes = attributes
        self.definition = definition
        self.codes = codes
        self.grain = grain
        self.buckets = buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("event_id"), F.lit(self.buckets)).cast("int")

    def read(self, like: DataFrame, table: str, column: str, values: list, before: int) -> DataFrame:
        """Rows of the folders of some values that batches up to a number wrote."""
        schema = T.StructType([*like.schema.fields, T.StructField(column, T.StringType()),
                               T.StructField("batch", T.IntegerType())])
        folders = [f"{table}/{column}={value}" for value in values]
        reader = like.sparkSession.read.schema(schema).option("basePath", table)
        return reader.parquet(*folders).filter(F.col("batch") <= before).select(like.columns)

    def _write(self, rows: DataFrame, table: str, column: str, number: int) -> None:
        (spread_by(rows, column, "event_id").withColumn("batch", F.lit(number))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(column, "batch").parquet(table))

    def refresh(self, batch: DataFrame, number: int) -> None:
        spark, steps = batch.sparkSession, f"{self.steps}/batch={number}"
        batch = _kept(batch, f"{steps}/rows")
        touched = _kept(batch.select("event_id", self._bucket().alias("bucket")).distinct(),
                        f"{steps}/events")
        buckets = [row.bucket for row in touched.select("bucket").distinct().collect()]
        if not buckets:
            return
        index = spark.createDataFrame([], INDEX)
        # An empty entry in each bucket: the folders are there to be read.
        marks = spark.createDataFrame([(None, None, b) for b in buckets], "event_id long, filed string, bucket int")
        self._write(marks, self.index, "bucket", number)
        known = _kept(self.read(index, self.index, "bucket", buckets, number - 1)
                      .join(touched, "event_id", "left_semi").distinct(), f"{steps}/known")
        places = [row.filed for row in known.select("filed").distinct().collect()]
        whole = batch
        if places:
            old = self.read(batch, self.rows, "filed", places, number - 1)
            whole = old.join(touched, "event_id", "left_semi").unionByName(batch).distinct()
        homes = (case_rows(whole, self.definition)
                 .select("event_id", period_of(self.grain).cast("string").alias("filed")).distinct())
        loose = (touched.join(homes, "event_id", "left_anti")
                 .select("event_id", F.concat(F.lit("loose-"), "bucket").alias("filed")))
        filed = _kept(homes.unionByName(loose), f"{steps}/filed")
        # Where an event is filed already, only its new rows are added.
        added = (whole.join(filed.join(known, ["event_id", "filed"], "left_anti"), "event_id")
                 .unionByName(batch.join(filed.join(known, ["event_id", "filed"], "left_semi"), "event_id")))
        self._write(added, self.rows, "filed", number)
        entries = filed.join(known, ["event_id", "filed"], "left_anti").withColumn("bucket", self._bucket())
        self._write(entries.unionByName(marks), self.index, "bucket", number)
        self._recount(batch, filed, number)

    def _recount(self, batch: DataFrame, filed: DataFrame, number: int) -> None:
        """Count the periods of the events anew; there are as many as days or months at most."""
        periods = [row.filed for row in filed.filter(~F.col("filed").startswith("loose-"))
                   .select("filed").distinct().collect()]
        if not periods:
            return
        held = self.read(batch, self.rows, "filed", periods, number)
        rollup = daily_rollup(held, self.attributes, self.definition, self.codes)
        # An event counts on one day, which a new row of it can move: every period gets
        # a row that says 0, as a write without rows would leave its old ones.
        counted = rollup.withColumn("period", period_of(self.grain))
        days = filed.sparkSession.createDataFrame([(p,) for p in periods], "period string").select(
            F.col("period").cast("date").alias("period"))
        empty = days.select(F.col("period").alias("event_date"), F.lit(0).alias("cases"))
        recounted = (counted.join(F.broadcast(days), "period", "left_semi").drop("period")
                     .unionByName(empty, allowMissingColumns=True))
        write_rollup(recounted, self.rollup, self.grain)

    def table(self, spark) -> DataFrame:
        """The roll-up as it stands."""
        return spark.read.parquet(self.rollup).filter("cases > 0").drop("period")

    def follow(self, stream: DataFrame) -> None:
        """Take in what the stream's sources hold now; call again for more."""
        run_available(stream, self.refresh, self.checkpoint)
