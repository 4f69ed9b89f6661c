"""What the operators share: kept tables, the import path of tasks, slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.sources.workdir import new_folder

#: Characters that separate words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the bitmap that `only_ids` sends to all tasks: at most 16 MB, however many the ids are.
FILTER_BITS = 2**27
#: Bits of it for each id, so that one other row in 32 passes by chance, in buckets as the bitmap
#: functions of Spark have them; and bits that it has at least.
BITS_PER_ID, BUCKET_BITS, LEAST_BITS = 32, 32_768, 2**20
#: Bytes of an Arrow batch in `small_batches`; a longer row is a batch of its own.
BATCH_BYTES = 2_000_000


def keep(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, written to a new table in the shared folder and read from there.

    Later steps neither repeat its work nor lose it with an executor.
    """
    path = new_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written herein passes to Python tasks in Arrow batches of few bytes.

    An executor holds a batch several times over, in the JVM and in the worker, for each task that
    runs. The session's own limit holds again afterwards.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def giving_back(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task, after which Arrow gives the memory that it keeps for later batches back.

    Workers outlive their tasks, idle ones count as much as those at work.
    """
    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()

    return run


def ship(spark: SparkSession) -> None:
    """Let Python tasks import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *paths])


def only_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose doc_id is among `ids`, a kept table with that one column.

    A bitmap of hashed ids is broadcast first, so that hardly any other row is shuffled with its
    text. It may let rows through, the more the more ids there are; the join decides.
    """
    return split_ids(rows, ids, key)[0].join(ids, key, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not among `ids`, a kept table with that one column.

    Only rows that the bitmap of `only_ids` lets through are shuffled; the others stay where
    they are. `rows` should be a table, as it is read twice. Rows without a key stay.
    """
    likely, others = split_ids(rows, ids, key)
    return others.unionByName(likely.join(ids, key, "left_anti"))


def bitmap(ids: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """A bitmap of the ids, whose size follows their number, and the bit of a key in it, from 1.

    It has a row for each bucket with a bit. The driver holds it several times over while it is
    broadcast.
    """
    bits = max(LEAST_BITS, -(-ids.count() * BITS_PER_ID // BUCKET_BITS) * BUCKET_BITS)
    place = F.pmod(F.xxhash64(key), F.lit(min(bits, FILTER_BITS))) + 1
    return (ids.select(F.bitmap_bucket_number(place).alias("_bucket"),
                       F.bitmap_bit_position(place).alias("_at"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))), place


def split_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows whose key is in the bitmap of the ids, and the others, none of which is an id's."""
    bits, place = bitmap(ids, key)
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10)
    is_set = F.expr("cast(shiftleft(1, cast(_at % 8 as int)) as int)").bitwiseAND(
        byte.cast("int")) != 0
    placed = (rows.withColumn("_bucket", F.bitmap_bucket_number(place))
              .withColumn("_at", F.bitmap_bit_position(place)))
    likely = placed.join(F.broadcast(bits), "_bucket").filter(is_set).select(rows.columns)
    others = (placed.join(F.broadcast(bits), "_bucket", "left")
              .filter(~F.coalesce(is_set, F.lit(False))).select(rows.columns))
    return likely, others


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bytes_in(column: pa.Array) -> int:
    """UTF-8 bytes of a string column."""
    return column.buffers()[2].size if column.buffers()[2] else 0


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about that many bytes of text, one row at least."""
    import numpy as np

    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    share = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) // most
    starts = np.flatnonzero(np.diff(share, prepend=-1))
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(start), int(end - start))
