"""Pack documents into sequences of a fixed number of tokens.

Token ids come from a public byte-level vocabulary. Documents are cut only if they are longer than
a sequence. Pieces are dealt to shards of bounded size by a hash of their ids; in a shard the longest
arrive first, and each goes to the fullest open sequence that has room (best fit). The number of
open sequences is fixed; a bitset with a bit for each amount of free space finds the best one, and
when one too many is open the fullest closes.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.shared import giving_back, keep, ship, slices, small_batches

LENGTH = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
#: Marks that are a pre-token of their own after letters, at the end of a chunk.
ENDS = tuple(",.!?;:")
#: Sequences that a shard may have open, and pieces that a shard holds on average.
OPEN_BINS = 32_768
SHARD_PIECES = 65_536
#: Distinct chunks whose ids a task remembers, about 250 bytes each.
REMEMBERED = 200_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class Ids(dict):
    """Chunk of text to its token ids as little-endian words; unknown chunks are tokenized.

    Pre-tokens never reach over a space into the word before it, so a text may be cut before
    each single space that a visible character follows. A chunk that starts with white space, is
    empty or holds a special token marks a text that is not cut: its value is None.
    """

    def __init__(self, encoding, lead: str):
        super().__init__()
        self.encode, self.lead = encoding.encode_ordinary, lead
        self.merge = encoding._encode_single_piece

    def __missing__(self, chunk: str) -> bytes | None:
        if SPECIAL in chunk or self.lead and (not chunk or chunk[0].isspace()):
            return None
        if len(self) > REMEMBERED:
            self.clear()
        if chunk.isalpha():  # a single pre-token
            ids = self.merge(self.lead + chunk)
        elif chunk[-1:] in ENDS and chunk[:-1].isalpha():
            ids = [*self.merge(self.lead + chunk[:-1]), *self.merge(chunk[-1])]
        else:
            ids = self.encode(self.lead + chunk)
        found = self[chunk] = array("I", ids).tobytes()
        return found


class Encoder:
    """Token ids of whole texts as the vocabulary of `tokenizers` defines them.

    The merges of ordinary chunks run in tiktoken over the same vocabulary as ranks, several times
    as fast; texts that can not be cut into chunks go to `tokenizers` as they are, which is loaded
    at the first of them.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        units = {shown: bytes([b]) for b, shown in _visible().items()}
        ranks = {b"".join(units[c] for c in token): number
                 for token, number in vocabulary.items() if token != SPECIAL}
        encoding = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN,
                                     mergeable_ranks=ranks, special_tokens={})
        self.bare, self.spaced = Ids(encoding, ""), Ids(encoding, " ")

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return (self.bare[first] if first else b"") + b"".join(
                map(self.spaced.__getitem__, rest))
        except TypeError:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes()


def _visible() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def pieces_of(ids: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and CRC of each piece; only the first of several may be short."""
    total = len(ids) // 4
    starts = [0, *range(total % length or length, total, length)]
    for start, end in zip(starts, [*starts[1:], total]):
        yield start, end - start, zlib.crc32(ids[4 * start:4 * end])


def tokenized(docs: DataFrame, path: str | None = None, length: int = LENGTH,
              end: int = END) -> DataFrame:
    """Pieces of every row of docs (doc_id, text)."""
    stop = np.array([end], dtype="<u4").tobytes()

    def cut(batches):
        from public_tokenizers import path as place

        # An encoder of the task's own: what it remembers goes with the task, not with the worker.
        ids_of = Encoder(path or place(VOCABULARY))
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                rows = [(key, number, *piece)
                        for key, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist())
                        for number, piece in enumerate(
                            pieces_of(ids_of(text or "") + stop, length))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, kind) for values, kind in zip(
                        zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        giving_back(cut), PIECES)


def best_fit(lengths: np.ndarray, size: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in order of arrival."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, count, opened = 0, 0, 0
    for k, need in enumerate(lengths.tolist()):
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            opened -= 1
        else:
            room, number = size, count
            count += 1
        sequence[k], offset[k] = number, size - room
        room -= need
        if room:
            by_room[room].append(number)
            rooms |= 1 << room
            opened += 1
            if opened > bins:  # the fullest closes
                least = (rooms & -rooms).bit_length() - 1
                by_room[least].pop()
                if not by_room[least]:
                    rooms &= ~(1 << least)
                opened -= 1
    return sequence, offset


def pack(pieces: DataFrame, length: int = LENGTH, bins: int = OPEN_BINS,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset; `pieces` should be a kept table, as it is read twice."""
    shards = pieces.count() // shard_pieces + 1
    columns = pieces.columns

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((name, "ascending") for name in (
            "_h", "doc_id", "piece"))])
        numbers, offsets = best_fit(table["length"].to_numpy(), length, bins)
        shard = table["_shard"][0].as_py()
        return table.select(columns).append_column(
            "sequence_id", pa.array(numbers * shards + shard, pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64()))

    # Rows without an id, or with one id, are told apart by what is in them.
    hashed = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    return (pieces.withColumn("_h", hashed).withColumn("_shard", F.pmod("_h", F.lit(shards)))
            .groupBy("_shard").applyInArrow(place, PACKED))


def packed_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Every piece of every row of docs (doc_id, text) with its place in a sequence.

    A null text is an empty one: it has the closing id only. Rows that repeat an id are documents
    of their own; a null doc_id stays null. Other columns are ignored, an empty table gives an
    empty result. Pieces of equal length are told apart by the hash, doc_id and piece number.
    """
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession):
        pieces = keep(tokenized(docs, path, length), "pieces")
    return pack(pieces, length)
