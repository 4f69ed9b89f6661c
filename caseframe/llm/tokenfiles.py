"""Token ids of documents in Parquet files that can be read in part.

A row is a document: its id, the file's number, the ids in the file before it (`offset`) and up to
its end (`stop`), their CRC, and the ids as a list. Rows are in ascending doc_id order from file to file.
Ids are dictionary encoded (or delta encoded), the ascending numbers delta encoded; row groups and
pages are small and carry page indexes, so a filter on doc_id or offset reads few pages of the
ids, and the numbers alone can be read without them. A catalogue has a row per file with the ids
before it in all files. Spark's own committer writes the files, so a lost task leaves nothing.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseframe.llm.shared import keep, ship, slices
from caseframe.operators.sizes import join_dimension
from caseframe.sources.tables import spread_by
from caseframe.sources.workdir import new_folder

END = 2
VOCABULARY = "word_bpe_49k.json"
#: Marks that are a pre-token of their own after letters, at the end of a chunk.
ENDS = tuple(",.!?;:")
#: Distinct pre-tokens whose ids a worker remembers, and distinct chunks of other texts.
REMEMBERED = 500_000
#: Bytes of text that are encoded at once; the more, the fewer chunks are looked at again.
SLICE = 8_000_000
#: Bytes of a row group and of a page, rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 16 * 2**20, 128 * 2**10, 1_000

ENCODED = "doc_id bigint, n_tokens bigint, crc32 bigint, ids binary"
STORED = "file int, doc_id bigint, offset bigint, stop bigint, crc32 bigint, tokens array<int>"
READ = "file int, doc_id bigint, offset bigint, stop bigint, ids_crc32 bigint, intact boolean"

# The pre-token pattern of the vocabulary for lower-case text of ASCII and Latin-1
# letters, and the characters of such text.
_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch


class Encoder:
    """Ids of whole texts by a vocabulary of `tokenizers`, equal pre-tokens encoded once.

    The pre-tokens of plain texts are found here and go to the model one by one. White space is
    dropped by the vocabulary and no step of it looks over a space, so plain texts are split there
    and each distinct chunk of a call is looked at once. Other texts are cut at
    single spaces; chunks that are not plain, and those that may hold a special token, go through
    the whole tokenizer. Ids have two bytes if the vocabulary allows it, else four.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4"
        self.pre_tokens = PreTokens(self.tokenizer.model, self.kind)
        self.chunks: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        text = text.lower()
        if text.isalpha():  # a single pre-token
            return self.pre_tokens[text]
        if text[-1:] in ENDS and text[:-1].isalpha():
            return self.pre_tokens[text[:-1]] + self.pre_tokens[text[-1]]
        return b"".join(map(self.pre_tokens.__getitem__, _PRE_TOKENS.findall(text)))

    def _plain_texts(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return iter(())
        chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        first, coded = chunks.offsets, chunks.flatten().dictionary_encode()
        del chunks
        known = self.pre_tokens.get
        own = [known(chunk) or self._plain(chunk) for chunk in _strings(coded.dictionary)]
        ids = pa.array(own, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[first.to_numpy()].tolist()
        flat = memoryview(ids.buffers()[2] or b"")
        return (bytes(flat[start:end]) for start, end in zip(ends, ends[1:]))

    def _cut(self, text: str) -> bytes:
        chunks = text.split(" ")
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        new = list({c for c in chunks if c not in self.chunks})
        plain = [c for c in new if _PLAIN(c) and "<|" not in c]
        self.chunks.update(zip(plain, map(self._plain, plain)))
        others = [c for c in new if c not in self.chunks]
        found = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        self.chunks.update((c, np.array(e.ids, self.kind).tobytes()) for c, e in zip(others, found))
        return b"".join(map(self.chunks.__getitem__, chunks))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian."""
        if len(self.pre_tokens) > REMEMBERED:
            self.pre_tokens.clear()
        plain = [bool(_PLAIN(text)) and "<|" not in text for text in texts]
        found = self._plain_texts(list(compress(texts, plain)))
        return [next(found) if is_plain else self._cut(text) for text, is_plain in zip(texts, plain)]


def _strings(chunks: pa.Array) -> list[str]:
    """The chunks, none of which has a space, by way of one string; to_pylist makes a scalar of each."""
    if not len(chunks):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks)
    return pc.binary_join(whole, pa.scalar(" ", chunks.type))[0].as_py().split(" ")


class PreTokens(dict):
    """Pre-token of plain text to its ids; unknown ones go to the model."""

    def __init__(self, model, kind: str):
        super().__init__()
        self.model, self.code = model, "H" if kind == "<u2" else "I"
        self.visible = {ord(c): "".join(_shown(b) for b in c.encode())
                        for c in map(chr, range(0xC0, 0x100))}

    def __missing__(self, text: str) -> bytes:
        shown = text if text.isascii() else text.translate(self.visible)
        found = self[text] = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found


def _shown(byte: int) -> str:
    """The character that stands for a byte of 0x80 or more in a byte-level vocabulary."""
    return chr(byte) if byte > 160 and byte != 173 else chr(
        256 + 34 + (byte - 128 if byte < 161 else 33))


def encoded(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """The ids of every row of docs (doc_id, text), with the closing id, their number and CRC."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from public_tokenizers import path as place

        encoder = Encoder(path or place(VOCABULARY))
        stop = np.array([end], encoder.kind).tobytes()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = [found + stop for found in encoder(part["text"].to_pylist())]
                wide = np.frombuffer(b"".join(ids), encoder.kind).astype("<u4")
                counts = np.array([len(x) for x in ids], np.int64) // len(stop)
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(ends - counts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(counts), pa.array(crcs, pa.int64()),
                     pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "crc32", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, ENCODED)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one file with the file's number, the ids before them in it, and their ids as a list."""
    file, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch, "ids", 8_000_000):
            counts, ids = part["n_tokens"].to_numpy(), part["ids"].to_pylist()
            kind = "<u2" if len(ids[0]) == 2 * counts[0] else "<u4"
            flat = np.frombuffer(b"".join(ids), kind).astype(np.int32)
            within = np.concatenate(([0], np.cumsum(counts)))
            ends = before + within[1:]
            before = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), file, np.int32)), part["doc_id"],
                 pa.array(ends - counts), pa.array(ends), part["crc32"],
                 pa.ListArray.from_arrays(pa.array(within, pa.int32()), pa.array(flat))],
                names=["file", "doc_id", "offset", "stop", "crc32", "tokens"])


def write_tokens(tokens: DataFrame, path: str, *, encoding: str = "dictionary",
                 row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS,
                 files: int | None = None) -> None:
    """Write ids as `encoded` gives them, and the catalogue, to a new folder.

    `tokens` should be a kept table, as it is read twice. Equal doc_ids lie next to one another, in
    order of their length and CRC, and may spread over files; null ones come first.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is 'dictionary' or 'delta', not {encoding!r}")
    order = ("doc_id", "n_tokens", "crc32")
    (spread_by(tokens, *order, files=files).sortWithinPartitions(*order)
     .mapInArrow(_numbered, STORED)
     .write.options(**{
         "compression": "zstd", "parquet.writer.version": "v2",
         "parquet.enable.dictionary": "false",
         "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
         "parquet.block.size": row_group, "parquet.page.size": page,
         "parquet.page.row.count.limit": page_rows})
     .parquet(f"{path}/tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    (_stored(tokens.sparkSession, path).groupBy("file")
     .agg(F.count("*").alias("documents"), F.max("stop").alias("n_tokens"),
          F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
     .withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
     .write.parquet(f"{path}/files"))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(f"{path}/tokens")


def _catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/files")


def _with_start(rows: DataFrame, path: str) -> DataFrame:
    """Rows with `n_tokens`, and `start`, the ids of all documents before theirs."""
    bases = _catalogue(rows.sparkSession, path).select("file", "base")
    return (join_dimension(rows, bases, bases, "file")
            .withColumn("start", F.col("base") + F.col("offset"))
            .withColumn("n_tokens", F.col("stop") - F.col("offset"))
            .drop("file", "base", "offset", "stop"))


def read_metadata(spark: SparkSession, path: str, keep_rows: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, crc32 and start of documents; the ids are not read."""
    rows = _stored(spark, path).drop("tokens")
    return _with_start(rows if keep_rows is None else rows.filter(keep_rows), path)


def read_documents(spark: SparkSession, path: str, first_id: int, last_id: int) -> DataFrame:
    """Documents with an id from first_id to last_id, with their ids; other pages are skipped."""
    return _with_start(_stored(spark, path).filter(F.col("doc_id").between(first_id, last_id)), path)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids at the places from first up to last of all files, cut out of their documents.

    The catalogue tells which files hold them, at most a row per file that the range touches; the
    places in those files are pushed to the scan.
    """
    ends = F.col("base") + F.col("n_tokens")
    held = (_catalogue(spark, path).filter((F.col("base") < last) & (ends > first))
            .agg(F.min_by("file", "base").alias("file"), F.max_by("file", "base").alias("last_file"),
                 F.min("base").alias("base"), F.max("base").alias("last_base")).first())
    rows = _stored(spark, path)
    if held["file"] is None:
        return _with_start(rows.filter(F.lit(False)), path)
    file, offset = F.col("file"), F.col("offset")
    rows = (rows.filter(file.between(held["file"], held["last_file"]))
            .filter((file != held["last_file"]) | (offset < last - held["last_base"]))
            .filter((file != held["file"]) | (F.col("stop") > first - held["base"])))
    begin = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    end = F.least(F.lit(last) - F.col("start"), F.col("n_tokens"))
    return (_with_start(rows, path)
            .withColumn("tokens", F.slice("tokens", (begin + 1).cast("int"), (end - begin).cast("int")))
            .withColumn("start", F.greatest("start", F.lit(first)))
            .withColumn("n_tokens", F.size("tokens").cast("bigint")))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch["tokens"]
        values = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<i4")
        ends = tokens.offsets.to_numpy()
        found = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        stops = batch["offset"].to_numpy() + np.diff(ends)
        intact = (stops == batch["stop"].to_numpy()) & (found == batch["crc32"].to_numpy())
        yield pa.RecordBatch.from_arrays(
            [batch["file"], batch["doc_id"], batch["offset"], pa.array(stops),
             pa.array(found, pa.int64()), pa.array(intact, pa.bool_())],
            names=["file", "doc_id", "offset", "stop", "ids_crc32", "intact"])


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, counted from the ids themselves.

    A document whose ids are not those that were written ends the job with an error.
    """
    ship(spark)
    checked = _stored(spark, path).mapInArrow(_checksums, READ)
    wrong = F.raise_error(F.concat(F.lit("damaged ids of document "), F.col("doc_id").cast("string")))
    checked = checked.withColumn("stop", F.when(F.col("intact"), F.col("stop")).otherwise(
        wrong.cast("bigint")))
    return _with_start(checked.drop("intact"), path).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text), write the files to the shared folder and read them back.

    A null or empty text has the closing id only. Rows that repeat an id are documents of their
    own, next to one another; documents without an id come first. Texts of any length are one row;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    write_tokens(keep(encoded(docs, path), "token-ids"), folder)
    return read_checked(spark, folder)
