"""Mix sources to target weights, with a bound on how often a source is repeated.

Sources share the total size by weight. A source never gives more than `epochs` times its own
size: it is clamped there and the excess goes to the others by weight, until none is above. What
that comes to is read off the sources in the order of bound / weight, in one pass of integer sums.

A source's target over its size is its number of epochs: every document is taken as often as its
whole part says, and the rest by a seeded systematic sample. Sources are dealt to buckets of
bounded size by a hash; in a bucket documents stand in the order of their size, and the sample
takes evenly spaced ones, so each bucket comes near its share of words. No Python in tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseframe.llm.shared import WORD, keep, text_or_empty

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
#: Documents of a source that are sampled together, on average.
BUCKET_ROWS = 4_000
#: Parts into which rows are dealt where they meet the figures of their source.
SALTS = 32


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, number of words and own hash of every row, and its column `row`."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("source").cast("string").alias("source"),
                       F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size"),
                       F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                                   F.md5(text_or_empty())).alias("own"),
                       (F.col(row) if row else F.lit(None).cast("bigint")).alias("row"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            epochs: int = EPOCHS) -> DataFrame:
    """Target of each source: totals (source, source_size, rows) with target and epochs.

    Sources by code point, null last, have the weights in turn. Windows without partitions run
    here over one row per source.
    """
    common = math.lcm(*weights)
    name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), turn + 1)
    each = totals.select("source", "source_size", "rows", weight.alias("w"),
                         (F.col("source_size") * epochs).alias("bound"))
    tight = Window.orderBy(F.col("bound") * F.expr(f"{common} div w"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.select("*", F.coalesce(F.sum("bound").over(before), F.lit(0)).alias("taken_before"),
                       F.sum("w").over(after).alias("w_after"),
                       F.sum("source_size").over(tight.rowsBetween(
                           Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    above = (F.col("bound").cast("double") * F.col("w_after").cast("double")
             < F.col("w").cast("double") * (F.col("total") - F.col("taken_before")).cast("double"))
    each = each.withColumn("clamped", above)
    whole = Window.partitionBy(F.lit(0))
    free = F.sum(F.when(~F.col("clamped"), F.col("w"))).over(whole)
    left = F.first("total").over(whole) - F.coalesce(
        F.sum(F.when(F.col("clamped"), F.col("bound"))).over(whole), F.lit(0))
    shared = F.col("w").cast("double") * left.cast("double") / free.cast("double")
    target = F.when(F.col("clamped"), F.col("bound").cast("double")).otherwise(shared)
    each = each.withColumn("target", target)
    return each.select("source", "source_size", "rows", "target", F.coalesce(
        F.try_divide(F.col("target"), F.col("source_size").cast("double")),
        F.lit(0.0)).alias("epochs"))


def _uniform(*parts: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the parts and the seed only."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
          seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
          row: str | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken of every row of docs.

    `docs` has doc_id, text and source; other columns are ignored, but for the one that `row`
    names, which comes back as `row`. A null text has size 0, a null source is a source of its
    own, the last. Documents without words add nothing but are sampled like others. Rows that
    repeat an id are documents of their own, dealt by id and text; those that repeat both are
    of equal order in the sample. All sources empty, or an empty table: all targets 0, or no
    rows.
    """
    rows = keep(sizes(docs, row), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"),
                                        F.count("*").alias("rows"))
    figures = keep(targets(totals, weights, epochs), "targets")
    salted = figures.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    name = F.coalesce("source", F.lit(""))
    salt = F.pmod(F.xxhash64("own"), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("_salt", salt).alias("r").join(
        salted.alias("f"), F.expr("r._salt = f._salt and r.source <=> f.source")).select(
        "r.doc_id", "r.source", "r.size", "r.own", "r.row", "f.source_size", "f.rows", "f.target", "f.epochs")
    buckets = F.expr(f"cast(1 + (rows - 1) div {bucket_rows} as bigint)")
    own = F.floor(_uniform(F.lit("bucket"), F.col("own"), seed=seed) * buckets)
    rows = rows.withColumn("bucket", own)
    order = Window.partitionBy("source", "bucket").orderBy(
        "size", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col("own"))), "own")
    begin = _uniform(F.lit("start"), name, F.col("bucket").cast("string"), seed=seed)
    whole = F.floor("epochs")
    part = F.col("epochs") - whole
    place = F.row_number().over(order)
    extra = F.floor(place * part + begin) - F.floor((place - 1) * part + begin)
    return rows.select(
        "doc_id", "size", "source", "source_size", "target", "row",
        F.least(whole + extra, F.lit(epochs)).cast("bigint").alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))
