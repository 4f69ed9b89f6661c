"""Write pages as WARC archives and read them back.

A record is a gzip member of its own. Of records with equal payloads one is a response and the
others are revisits that name it. The reader goes through an archive once: it inflates member by
member with a bounded buffer, takes exactly as many bytes of a block as its Content-Length says
and checks the digest that the record carries. What a revisit is a copy of is looked up in the
response that it names, whose digest must be the one that the revisit states.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.llm.shared import keep, ship, split_ids
from caseframe.operators.sizes import join_dimension
from caseframe.sources.workdir import new_folder

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Rows of an archive on average, bytes that the reader takes from a file at once.
ARCHIVE_ROWS = 8192
CHUNK = 1 << 18
LEVEL = 6

RECORDS = ("record_id string, page_id bigint, payload_bytes bigint, payload_digest string, "
           "record_type string, refers string, archive string")


class DamagedArchive(ValueError):
    """An archive ends early, or a record does not hold what its header says."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, copy: int = 0) -> str:
    """The same row has the same record id whenever it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}>"


def record(headers: dict[str, str], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()),
                         f"Content-Length: {len(block)}".encode()])
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class _Stream:
    """The inflated bytes of an archive, taken piece by piece; knows where members end."""

    def __init__(self, file: BinaryIO, chunk: int = CHUNK):
        self.file, self.chunk = file, chunk
        self.raw, self.ready, self.inflate = b"", bytearray(), None

    def fill(self) -> bool:
        """Inflate some more of the member; False at its end."""
        if self.inflate is None or self.inflate.eof:
            return False
        if self.inflate.unconsumed_tail:
            raw = self.inflate.unconsumed_tail
        else:
            raw = self.raw or self.file.read(self.chunk)
            self.raw = b""
            if not raw:
                raise DamagedArchive("the archive ends within a record")
        self.ready += self.inflate.decompress(raw, self.chunk)
        if self.inflate.eof:
            self.raw = self.inflate.unused_data
        return True

    def next_member(self) -> bool:
        if self.ready or self.fill():
            raise DamagedArchive("a record has bytes after its end")
        self.raw = self.raw or self.file.read(self.chunk)
        if not self.raw:
            return False
        self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self.fill():
                raise DamagedArchive("a record has no end of its header")
        found = bytes(self.ready[:at])
        del self.ready[:at + len(mark)]
        return found

    def take(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.ready and not self.fill():
                raise DamagedArchive("a block is shorter than its Content-Length")
            part = bytes(self.ready[:count])
            del self.ready[:count]
            count -= len(part)
            if part:
                yield part

    def finish(self) -> None:
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise DamagedArchive("a record does not end with two line ends")
        while self.fill():
            if self.ready:
                raise DamagedArchive("a record has bytes after its end")


def read_records(file: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, str]]:
    """Header, block length and block digest of each record; blocks are never held whole."""
    stream = _Stream(file, chunk)
    while stream.next_member():
        version, *lines = stream.until(b"\r\n\r\n").split(b"\r\n")
        if version != VERSION:
            raise DamagedArchive(f"unknown version {version[:20]!r}")
        headers = dict(line.decode().split(": ", 1) for line in lines)
        length, digest = int(headers["Content-Length"]), hashlib.sha1()
        for part in stream.take(length):
            digest.update(part)
        stream.finish()
        found = base64.b32encode(digest.digest()).decode()
        stated = headers.get("WARC-Block-Digest", "").removeprefix("sha1:")
        if stated != found:
            raise DamagedArchive(f"{headers.get('WARC-Record-ID')}: digest {found}, stated {stated}")
        yield headers, length, found


def _files(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme and host, as Spark takes it; an error if pyarrow can not open it.

    A path without a scheme is one on the default file system of the cluster, not on the disk of
    each executor.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if whole.startswith("file:/") and not whole.startswith("file://"):
        whole = "file://" + whole.removeprefix("file:")
    try:
        _files(whole)
    except (pa.ArrowException, OSError) as reason:
        raise ValueError(f"archives can not be written to {whole}: {reason}") from reason
    return whole


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Id, payload mark and refers_to of every page.

    The largest page_id of equal payloads is the response. A third of the pages with one payload
    costs one row per task: payloads are compared by SHA-256 and length after a partial maximum.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = keep(pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("key"),
        F.length(payload).cast("bigint").alias("n"), F.xxhash64(payload).alias("mark")), "payloads")
    first = (digests.filter(F.col("n") >= least_bytes).groupBy("key", "n")
             .agg(F.max("page_id").alias("_first"), F.count("*").alias("_rows"))
             .filter("_rows > 1").drop("_rows"))
    refers = F.when(F.col("page_id") < F.col("_first"), F.col("_first"))
    return (digests.join(first, ["key", "n"], "left")
            .select(F.col("page_id").alias("_id"), F.col("mark").alias("_mark"),
                    refers.alias("refers_to")))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0,
                   archive_rows: int = ARCHIVE_ROWS) -> DataFrame:
    """Write a record for every row of pages (page_id, html, and url if there is one).

    Returns the archives: archive, records. A file gets its name when it is complete; a task that
    runs again writes a file of another name, and only files in the returned table count.

    A null html is an empty payload, a null page_id a response under the id of no page. Rows
    that repeat a page_id are records of their own with the same role. Other columns are ignored.
    """
    ship(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    mark = F.xxhash64(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"),
                        F.col("html").cast("string").alias("html"), mark.alias("mark"))
    rows = rows.withColumn("row", F.xxhash64("page_id", "mark"))
    again = keep(roles(pages, least_bytes).filter("refers_to is not null")
                 .groupBy(F.xxhash64("_id", "_mark").alias("row"), "_id", "_mark")
                 .agg(F.max("refers_to").alias("refers_to")), "revisits")
    # Pages that may be revisits meet their response's id; all others stay where they are.
    likely, others = split_ids(rows, again.select("row"), "row")
    named = likely.join(again, (F.col("page_id") == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    columns = ("page_id", "url", "html", "refers_to")
    rows = named.select(*columns).unionByName(
        others.withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns))

    def write(batches):
        place, name, out, count = None, None, None, 0
        files, base = _files(folder)
        for batch in batches:
            for key, link, html, refers in zip(*(batch[c].to_pylist() for c in
                                                 ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    context = TaskContext.get()
                    name = (f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-"
                            f"{uuid.uuid4().hex[:12]}.warc.gz")
                    place, count = f"{base}/.{name}.part", 0
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(place, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                out.write(page_record(key, link, payload, refers, count))
                count += 1
                if count == archive_rows:
                    yield _closed(files, base, out, place, name, count)
                    out = None
        if out is not None:
            yield _closed(files, base, out, place, name, count)

    return keep(rows.mapInArrow(write, "archive string, records bigint"), "archives")


def _closed(files, base, out, place, name, count) -> pa.RecordBatch:
    out.close()
    files.move(place, f"{base}/{name}")
    return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([count], pa.int64())})


def page_record(key, link, payload: bytes, refers, copy: int) -> bytes:
    digest, block = f"sha1:{sha1_base32(payload)}", b"" if refers is not None else payload
    clean = "".join(c for c in (link or f"urn:page:{key}") if c.isprintable() and c != " ")
    headers = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": record_uri(key, 0 if key is not None else copy), "WARC-Date": DATE,
        "WARC-Target-URI": clean, "Content-Type": "text/html; charset=utf-8",
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": digest if refers is None else f"sha1:{sha1_base32(b'')}"}
    if key is not None:
        headers["X-Page-Id"] = str(key)
    if refers is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_uri(refers)}
    return record(headers, block)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives (archive), each archive read by one task."""
    folder = qualified(archives.sparkSession, folder)

    def read(batches):
        files, base = _files(folder)
        for batch in batches:
            for name in batch["archive"].to_pylist():
                rows = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as file:
                    for headers, length, digest in read_records(file):
                        rows.append(_row(headers, length, digest, name))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return archives.select("archive").mapInArrow(read, RECORDS)


def _row(headers, length, digest, name):
    kind, stated = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest != stated:
        raise DamagedArchive(f"{headers['WARC-Record-ID']}: payload differs from its header")
    page = headers.get("X-Page-Id")
    return (headers["WARC-Record-ID"], None if page is None else int(page),
            length if kind == "response" else None, stated, kind, headers.get("WARC-Refers-To"), name)


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(values), kind) for values, kind in zip(columns, kinds)],
        names=["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers",
               "archive"])


def linked(records: DataFrame) -> DataFrame:
    """Records, a kept table, with `refers_to`: the page of the response that a revisit names.

    A revisit has the length of that response. One that names no response with its digest ends
    the job with an error. Only the responses that are named are looked up; if they are many,
    the revisits of one response are spread over many tasks.
    """
    place = F.concat_ws(" ", "refers", "payload_digest").alias("place")
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes").withColumn("place", place)
    wanted = revisits.select("place").distinct()
    targets = keep(records.filter("record_type = 'response'")
                   .select(F.concat_ws(" ", "record_id", "payload_digest").alias("place"),
                           F.col("page_id").alias("refers_to"), "payload_bytes")
                   .join(wanted, "place", "left_semi")
                   .groupBy("place").agg(F.max("refers_to").alias("refers_to"),
                                         F.max("payload_bytes").alias("payload_bytes")), "targets")
    found = join_dimension(revisits, targets, targets, "place", "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit "), F.col("record_id")))
    found = found.withColumn("payload_bytes", F.coalesce("payload_bytes", lost.cast("bigint")))
    return (records.filter("record_type = 'response'")
            .withColumn("refers_to", F.lit(None).cast("bigint"))
            .unionByName(found.drop("place")).drop("record_id", "refers"))


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read the records back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, least_bytes)
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, 1)
    records = read_archives(archives.repartition(max(tasks, archives.count())), folder)
    return linked(keep(records, "records"))
