"""Rows that may join, picked out before they are shuffled.

The keys of the small side become a blocked Bloom filter: a key has one block and a few bits in
it. Blocks are broadcast, so each row of the large side is tested where it was read. Rows with
other keys come through by chance only; the join or grouping that follows decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block, as the bitmap functions of Spark have them, in 64-bit words.
BLOCK_BITS = 32_768
WORDS = BLOCK_BITS // 64
#: Bits that a key sets, and bits of the filter for each key: one row in 1,800 passes by chance.
PROBES, BITS_PER_KEY = 4, 24
#: Blocks at most, 64 MB in all. From 22 million keys on the filter lets more rows pass.
MOST_BLOCKS = 16_384


def _places(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(BLOCK_BITS)) for probe in range(PROBES)]


def _is_set(place: Column) -> Column:
    """Whether the bit is set; the bytes of a word are in reverse order."""
    byte, bit = F.floor((place % 64) / 8), place % 8
    word = F.get("_words", F.floor(place / 64).cast("int"))
    return F.getbit(word, (56 - byte * 8 + bit).cast("int")) == 1


def sift(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is not among ``keys``; none that is gets lost.

    The size of the filter follows the number of keys, up to a fixed bound.
    """
    counted = F.ceil(F.approx_count_distinct(key) * BITS_PER_KEY / BLOCK_BITS)
    blocks = keys.agg(F.greatest(F.lit(1), F.least(counted, F.lit(MOST_BLOCKS)))
                      .cast("bigint").alias("blocks")).scalar()
    block = F.pmod(F.xxhash64(key), blocks).alias("_block")
    bits = (keys.filter(F.col(key).isNotNull()).select(block, F.explode(F.array(*_places(key))).alias("_at"))
            .groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits")))
    words = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.conv(
        F.hex(F.substring("_bits", w * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))
    filled = bits.select("_block", words.alias("_words"))
    hit = reduce(Column.__and__, map(_is_set, _places(key)))
    return (rows.filter(F.col(key).isNotNull()).select("*", block)
            .join(F.broadcast(filled), "_block").filter(hit).select(rows.columns))
