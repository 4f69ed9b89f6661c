"""Exact duplicates, found through a minimal perfect hash over the digests of earlier documents.

Two texts are equal when they are identical after each run of spaces became one space. The key is
the SHA-256 of that form. Earlier ("historical") digests are dealt to shards by their own bits;
each shard holds a minimal perfect hash, and in the order of its slots the full digests, the
documents that stay and the group sizes. A lookup compares all 32 bytes, so a digest that is not a
member is told apart from one that is; those form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.shared import SPACE_RUN, keep, ship, text_or_empty

#: Digests that a shard holds on average.
SHARD_DIGESTS = 16_384
#: Bits of a level for each digest that is not yet placed.
GAMMA = 2
LEVELS = 96

DIGESTS = "doc_id bigint, digest binary, historical boolean"
INDEX = ("shard bigint, sizes array<bigint>, bits array<binary>, digests binary, "
         "winners binary, known binary, counts binary")


def digests(docs: DataFrame, historical) -> DataFrame:
    """doc_id, digest of the normalised text, and whether the row belongs to the history."""
    normal = F.regexp_replace(text_or_empty(), SPACE_RUN, " ")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.unhex(F.sha2(normal, 256)).alias("digest"),
                       F.coalesce(historical, F.lit(False)).alias("historical"))


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level puts digests, given as four unsigned words each."""
    x = words[:, level % 4] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def _words(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u8").reshape(-1, 4)


def build(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits and the slot of each digest; digests must be distinct.

    A level gives a bit to every digest that is alone in its place; the others go on to the next.
    The slot is the number of set bits before the digest's own bit over all levels.
    """
    levels, slots, left, before = [], np.empty(len(words), np.int64), np.arange(len(words)), 0
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("digests of a shard are not distinct")
        at = _position(words[left], len(levels), GAMMA * len(left))
        bits = np.bincount(at, minlength=GAMMA * len(left)) == 1
        alone = bits[at]
        slots[left[alone]] = before + np.cumsum(bits)[at[alone]] - 1
        levels.append(bits)
        before += int(bits.sum())
        left = left[~alone]
    return levels, slots


def find(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The only slot that a digest can have; -1 where no level has its bit."""
    slots, left, before = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        at = _position(words[left], level, len(bits))
        hit = bits[at]
        slots[left[hit]] = before + np.cumsum(bits)[at[hit]] - 1
        before += int(bits.sum())
        left = left[~hit]
    return slots


def _blob(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and which of them are not null."""
    column = column.combine_chunks()
    return (np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), dtype="<i8"),
            np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool))


def _build_shard(table: pa.Table) -> pa.Table:
    words = _words(_blob(table["digest"]))
    levels, slots = build(words)
    order = np.argsort(slots)
    winners, known = _numbers(table["winner"])
    counts, _ = _numbers(table["n"])
    return pa.table({
        "shard": table["shard"].slice(0, 1), "sizes": [[len(bits) for bits in levels]],
        "bits": [[np.packbits(bits).tobytes() for bits in levels]],
        "digests": [words[order].tobytes()], "winners": [winners[order].tobytes()],
        "known": [known[order].tobytes()], "counts": [counts[order].tobytes()]})


def _empty(schema: str) -> pa.Table:
    kinds = {"binary": pa.binary(), "bigint": pa.int64()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in fields})


GROUPS = "digest binary, keep_id bigint, group_size bigint"


def _look_up(groups: pa.Table, index: pa.Table) -> pa.Table:
    """Groups of a shard: members merged into their slots, the other slots, and nonmembers."""
    out = [_empty(GROUPS)]
    new = _words(_blob(groups["digest"]))
    ids, known = _numbers(groups["winner"])
    counts, _ = _numbers(groups["n"])
    member = np.zeros(len(new), bool)
    if index.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
                  for b, n in zip(row["bits"], row["sizes"])]
        old = _words(row["digests"])
        winners = np.frombuffer(row["winners"], "<i8").copy()
        held = np.frombuffer(row["known"], bool).copy()
        sizes = np.frombuffer(row["counts"], "<i8").copy()
        slots = find(levels, new)
        member = slots >= 0
        member[member] = (old[slots[member]] == new[member]).all(axis=1)
        at, own = slots[member], known[member]
        sizes[at] += counts[member]
        winners[at] = np.where(~own, winners[at], np.where(
            held[at], np.minimum(winners[at], ids[member]), ids[member]))
        held[at] |= own
        out.append(_groups(old, winners, held, sizes))
    out.append(_groups(new[~member], ids[~member], known[~member], counts[~member]))
    return pa.concat_tables(out)


def _groups(words, ids, known, sizes) -> pa.Table:
    flat = np.ascontiguousarray(words).tobytes()
    return pa.table({
        "digest": pa.array([flat[k:k + 32] for k in range(0, len(flat), 32)], pa.binary()),
        "keep_id": pa.array(ids, pa.int64(), mask=~known), "group_size": pa.array(sizes, pa.int64())})


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest, which a hot digest reaches through partial sums, with its shard."""
    shard = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("bigint") % shards
    return (rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("n"))
            .select(shard.alias("shard"), "digest", "winner", "n"))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The minimal perfect hash over the distinct digests of rows, one row per shard."""
    return _dealt(rows, shards).groupBy("shard").applyInArrow(_build_shard, INDEX)


def merge_groups(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All groups of equal texts of the rows and the index: digest, keep_id, group_size."""
    new = _dealt(rows, shards)
    return (new.groupBy("shard").cogroup(index.groupBy("shard"))
            .applyInArrow(lambda groups, slots: _look_up(groups, slots), GROUPS))


def exact_duplicates(docs: DataFrame, historical) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every row of docs (doc_id, text).

    `historical` is a condition on docs: those rows came before and fill the index, the others
    are looked up. The split changes no result, only which rows are built in and which looked up.

    Null texts count as empty. A null doc_id never stays while its group has another; a group of
    null ids only has a null keep_id and stays as it is. Rows that repeat an id and text are each
    counted, and share kept. Other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = keep(digests(docs, historical), "digests")
    shards = rows.count() // SHARD_DIGESTS + 1
    index = keep(build_index(rows.filter("historical"), shards), "digest-index")
    groups = merge_groups(rows.filter("not historical"), index, shards)
    return (rows.select("doc_id", "digest").join(groups, "digest")
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"))
