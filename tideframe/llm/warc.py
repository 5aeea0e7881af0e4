"""WARC archives: writing, the monolithic-gzip normaliser with its offset index, and reading by index.

A crawl often leaves archives whose whole file is one gzip stream: no record can be read without inflating
all before it. normalise() inflates each such stream once, in bounded memory, writes every record as a gzip
member of its own and leaves a sidecar index of offsets; read_records() then inflates members one by one,
so that one archive can be read by many tasks.

Defined cases: a null html is an empty payload; a null url is an empty target; control characters in a url are
percent-encoded in the header. Rows with a null page_id have equal standing among equal payloads only if no row
of the payload has an id, else they revisit it. Rows that repeat the largest page_id of a payload are all
responses. Very long payloads are written, inflated and checked whole. An empty table gives no archive and no row. Columns other than page_id, url and html are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
RANGE = 256  # records that are read at a time
ARCHIVE_BYTES = 1 << 30  # of records, after which a new archive begins

ARCHIVES = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType())])
RANGES = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("index", T.StringType()),
        T.StructField("first", T.LongType()),
        T.StructField("records", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for a response): equal payloads of min_bytes or more refer to the largest page_id.

    The group is an aggregate (combined before its shuffle); the join back is an ordinary equi-join, which
    adaptive execution splits where one payload holds many pages.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", common.base32_of_hex(F.sha1("html")))
    shared = page.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return page.join(shared, "digest", "left").withColumn("refers_to", F.when(other, F.col("keeper"))).drop("keeper")


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    number = name.strip().removeprefix("<urn:x-page:").removesuffix(">")
    return None if number in ("", "none") else int(number)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC 1.1 record. A revisit keeps the HTTP header block (with the payload's length) and drops the payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 4, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of with_revisits(), each one gzip stream as a whole; gives the archives' table.

    A partition goes into one archive, or into more of about `most` bytes of records each. A file's name holds the task
    attempt, and only the written table says which files count: a retried or speculative task leaves a file
    that nobody reads.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        store, top = common.files(folder)
        store.create_dir(top, recursive=True)
        name, out, deflate, n, size, number = "", None, None, 0, 0, 0

        def end() -> pa.RecordBatch:
            out.write(deflate.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [n]})

        for batch in batches:
            ids, urls, digests, refers = (common.values(batch, c) for c in ("page_id", "url", "digest", "refers_to"))
            for page_id, url, digest, refer, payload in zip(ids, urls, digests, refers, common.utf8(batch, "html"), strict=True):
                if out is None:
                    name = f"mono-{at.partitionId():06d}-{number:04d}-{at.taskAttemptId()}.warc.gz"
                    out, deflate = store.open_output_stream(f"{top}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page_id, url, payload, digest, refer, date)
                out.write(deflate.compress(data))
                n, size = n + 1, size + len(data)
                if size >= most:
                    yield end()
                    out, n, size, number = None, 0, 0, number + 1
        if out is not None:
            yield end()

    common.ship(pages.sparkSession)
    return common.written(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, ARCHIVES))


def inflated(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, piece by piece."""
    inflate = zlib.decompressobj(31)
    rest = b""
    while True:
        piece = rest or stream.read(chunk)
        rest = b""
        if not piece:
            return
        while piece:
            if out := inflate.decompress(piece, 4 * chunk):
                yield out
            piece = inflate.unconsumed_tail
        if inflate.eof:
            rest, inflate = inflate.unused_data, zlib.decompressobj(31)


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(header block, pieces of the content block) of each record; the content must be used before the next record."""
    held = bytearray()

    def more() -> bool:
        for piece in pieces:
            held.extend(piece)
            return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a WARC header is cut off")
                return
        head = bytes(held[: end + 4])
        del held[: end + 4]
        found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        if not found:
            raise ValueError("a WARC record has no Content-Length")
        left = int(found[1]) + 4

        def content(left: int = left) -> Iterator[bytes]:
            while left:
                if not held and not more():
                    raise ValueError("a WARC record is cut off")
                piece = bytes(held[:left])
                del held[:left]
                left -= len(piece)
                yield piece

        yield head, content()


def header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}


def normalise(archives: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrite each monolithic archive with a member for each record and a sidecar index; gives ranges of records to read.

    Each stream is inflated once. Memory: a piece of input and of output, whatever the record's size.
    The sidecar has one JSON line for each record: offset and length of its member, id, type, target, digest. A
    range says where its lines lie in the sidecar, so that a reader looks at no others.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        store, top = common.files(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for archive in common.values(batch, "archive"):
                name = f"{archive.rsplit('/', 1)[1].removesuffix('.warc.gz').replace('mono', 'norm')}-{attempt}"
                source, path = common.files(archive)
                offset, n, starts, line = 0, 0, [], 0
                with source.open_input_stream(path, compression=None) as stream, store.open_output_stream(f"{top}/{name}.warc.gz", compression=None) as out, store.open_output_stream(f"{top}/{name}.idx") as index:
                    for head, content in records_of(inflated(stream)):
                        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                        start = offset
                        for piece in _chain(head, content):
                            done = deflate.compress(piece)
                            out.write(done)
                            offset += len(done)
                        done = deflate.flush()
                        out.write(done)
                        offset += len(done)
                        field = header(head)
                        entry = {"offset": start, "length": offset - start, "id": field.get("warc-record-id"), "type": field.get("warc-type"), "uri": field.get("warc-target-uri"), "digest": field.get("warc-payload-digest")}
                        if n % RANGE == 0:
                            starts.append(line)
                        data = json.dumps(entry).encode() + b"\n"
                        index.write(data)
                        line += len(data)
                        n += 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "archive": [f"{folder}/{name}.warc.gz"] * len(starts),
                        "index": [f"{folder}/{name}.idx"] * len(starts),
                        "first": list(range(0, n, RANGE)),
                        "records": [min(RANGE, n - x) for x in range(0, n, RANGE)],
                        "at": starts,
                        "bytes": [b - a for a, b in zip(starts, [*starts[1:], line], strict=True)],
                    }
                )

    common.ship(archives.sparkSession)
    n = common.tasks(archives.sparkSession, archives.count())  # a number of its own, as Spark merges small partitions otherwise
    return common.written(archives.repartition(n, "archive").mapInArrow(rewrite, RANGES))


def _chain(head: bytes, content: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from content


def parse_member(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC header, HTTP header block and payload of one inflated member."""
    head, content = next(records_of(iter([data])))
    block = b"".join(content)[:-4]
    http, _, payload = block.partition(b"\r\n\r\n")
    return header(head), http, payload


def read_records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, each inflated alone from the offset in its index line, its digest checked."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        for archive, index, at, length in zip(*(common.values(batch, c) for c in ("archive", "index", "at", "bytes")), strict=True):
            store, path = common.files(index)
            with store.open_input_file(path) as stream:
                entries = [json.loads(x) for x in stream.read_at(length, at).splitlines()]
            store, path = common.files(archive)
            with store.open_input_file(path) as stream:
                for entry in entries:
                    data = zlib.decompress(stream.read_at(entry["length"], entry["offset"]), 31)
                    field, http, payload = parse_member(data)
                    digest, kind = field["warc-payload-digest"].removeprefix("sha1:"), field["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{archive}: the payload at {entry['offset']} doesn't match its digest")
                    length = int(header(http)["content-length"])
                    refers = _id(field["warc-refers-to"]) if "warc-refers-to" in field else None
                    yield (_id(field["warc-record-id"]), kind, refers, field.get("warc-target-uri", ""), length, digest, payload if payloads and kind == "response" else None, archive, entry["offset"], entry["length"])

    common.ship(ranges.sparkSession)
    n = common.tasks(ranges.sparkSession, ranges.count() // 4)
    return ranges.repartition(n, "archive", "first").mapInArrow(common.arrow_rows(RECORDS, read), RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise these and give the ranges that read_records() takes."""
    folder = folder or common.shared_dir(pages.sparkSession)
    archives = write_monolithic(with_revisits(pages, min_bytes), f"{folder}/crawl")
    return normalise(archives, f"{folder}/normal")
