"""Media columns: ISO base media files in a binary column, described without decoding a payload.

describe() walks the nested boxes of each file, decodes the sample tables and gives codec, duration and the byte
ranges of the keyframes. store() makes such a column: bytes become the raw 8-bit luma frames of a video track.

Defined cases: null bytes or a null text are empty; an empty text is one padded frame. A file that is not ISO media,
is cut off or contradicts itself gives error (text) and null fields, never a failed task. A file with no stss box has
all samples as keyframes, as the format says; samples that add up to more than the file are refused, so no
place is read again and again. Very long texts are stored whole, with 64-bit offsets where 32 bits don't reach. Repeated rows get equal files and
descriptions. Extra columns pass through; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT  # bytes of a frame of 8-bit samples
RATE, KEY_EVERY, CHUNK_FRAMES = 25, 25, 64
# Box types that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
DEPTH = 16

STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
DESCRIBED = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("handler", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("timescale", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("samples", T.LongType()),
        T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("sample", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """data and spaces up to a positive multiple of a frame."""
    return data + b" " * (-len(data) % FRAME if data else FRAME)


def encode(payload: bytes) -> bytes:
    """An ISO media file: ftyp, moov with the sample tables, mdat with the payload's frames as they are."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK_FRAMES)
    unity = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    last = n - (chunks - 1) * CHUNK_FRAMES
    runs = ([(1, CHUNK_FRAMES)] if chunks > 1 else []) + ([(chunks, last)] if chunks == 1 or last != CHUNK_FRAMES else [])
    keys = range(1, n + 1, KEY_EVERY)
    large = len(payload) > (1 << 32) - (1 << 20)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")

    def moov(base: int) -> bytes:
        places = [base + i * CHUNK_FRAMES * FRAME for i in range(chunks)]
        table = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", 0, 0, struct.pack(">II", FRAME, n)),
            full(b"co64", 0, 0, struct.pack(f">I{chunks}Q", chunks, *places)) if large else full(b"stco", 0, 0, struct.pack(f">I{chunks}I", chunks, *places)),
        )
        minf = box(b"minf", full(b"vmhd", 0, 1, bytes(8)), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), table)
        mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = full(b"tkhd", 0, 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), unity, struct.pack(">II", WIDTH << 16, HEIGHT << 16))
        mvhd = full(b"mvhd", 0, 0, struct.pack(">IIIIIH", 0, 0, RATE, n, 1 << 16, 1 << 8), bytes(10), unity, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    lead = 16 if large else 8
    first = len(head) + len(moov(0)) + lead
    return head + moov(first) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int, depth: int = 0) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, first byte of the body, end, depth) of every box, parents before children."""
    at = start
    while at < end:
        if end - at < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box header is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif size == 0:
            size = end - at
        if at + size > end or body > at + size:
            raise ValueError(f"box {kind!r} doesn't fit its parent")
        yield kind, body, at + size, depth
        if kind in CONTAINERS:
            if depth >= DEPTH:
                raise ValueError("boxes are nested too deep")
            yield from boxes(data, body, at + size, depth + 1)
        at += size


def _numbers(data: memoryview, at: int, end: int, n: int, code: str) -> tuple[int, ...]:
    if at + n * struct.calcsize(f">{code}") > end:
        raise ValueError("a sample table is cut off")
    return struct.unpack_from(f">{n}{code}", data, at)


def sample_ranges(chunk_at: tuple[int, ...], runs: list[tuple[int, int]], sizes: list[int] | int, n: int) -> list[tuple[int, int]]:
    """(offset, length) of each sample from chunk offsets, samples by chunk and sample sizes."""
    out: list[tuple[int, int]] = []
    for k, (first, per) in enumerate(runs):
        stop = runs[k + 1][0] if k + 1 < len(runs) else len(chunk_at) + 1
        if not 1 <= first <= stop <= len(chunk_at) + 1:
            raise ValueError("a run of chunks doesn't fit the chunks")
        for chunk in range(first, stop):
            at = chunk_at[chunk - 1]
            for _ in range(per):
                if len(out) == n:
                    return out
                size = sizes if isinstance(sizes, int) else sizes[len(out)]
                out.append((at, size))
                at += size
    if len(out) != n:
        raise ValueError("the chunks hold fewer samples than the sizes say")
    return out


def parse(media: bytes) -> tuple[dict, list[tuple[int, int]]]:
    """The first track's description, and its samples' byte ranges in the file. No sample is read."""
    data = memoryview(media)
    got: dict = {}
    chunk_at: tuple[int, ...] | None = None
    runs: list[tuple[int, int]] | None = None
    sizes: list[int] | int | None = None
    keys: tuple[int, ...] | None = None
    n = tracks = 0
    times: tuple[int, ...] = ()
    for kind, at, end, _ in boxes(data, 0, len(data)):
        if kind == b"trak":
            tracks += 1
        if tracks != 1:
            continue
        if kind == b"mdhd":
            version = data[at]
            scale, duration = struct.unpack_from(">QQIQ", data, at + 4)[2:] if version else struct.unpack_from(">IIII", data, at + 4)[2:]
            got |= {"timescale": scale, "duration": duration}
        elif kind == b"hdlr" and "handler" not in got:
            got["handler"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            if struct.unpack_from(">I", data, at + 4)[0] < 1:
                raise ValueError("no sample description")
            got["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
            if got.get("handler") == "vide":
                got["width"], got["height"] = struct.unpack_from(">HH", data, at + 8 + 32)
        elif kind == b"stts":
            times = _numbers(data, at + 8, end, 2 * struct.unpack_from(">I", data, at + 4)[0], "I")
        elif kind == b"stss":
            keys = _numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], "I")
        elif kind == b"stsc":
            flat = _numbers(data, at + 8, end, 3 * struct.unpack_from(">I", data, at + 4)[0], "I")
            runs = [(flat[i], flat[i + 1]) for i in range(0, len(flat), 3)]
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, at + 4)
            sizes = size or list(_numbers(data, at + 12, end, n, "I"))
        elif kind == b"stz2":
            width, n = struct.unpack_from(">II", data, at + 4)
            if width == 4:
                packed = bytes(data[at + 12 : end])
                sizes = [x for b in packed for x in (b >> 4, b & 15)][:n]
            else:
                sizes = list(_numbers(data, at + 12, end, n, {8: "B", 16: "H"}[width]))
        elif kind in (b"stco", b"co64"):
            chunk_at = _numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], "I" if kind == b"stco" else "Q")
    if chunk_at is None or runs is None or sizes is None or "codec" not in got or "timescale" not in got:
        raise ValueError("not an ISO media file with a sample table")
    if (sizes * n if isinstance(sizes, int) else sum(sizes)) > len(data):  # chunks that point at one place would be read again and again
        raise ValueError("the samples are longer than the file")
    ranges = sample_ranges(chunk_at, runs, sizes, n)
    if max((a + b for a, b in ranges), default=0) > len(data):
        raise ValueError("a sample lies outside the file")
    if times and sum(times[::2]) != n:
        raise ValueError("times and sizes disagree on the number of samples")
    keys = tuple(range(1, n + 1)) if keys is None else keys
    if keys and not 1 <= min(keys) <= max(keys) <= n:
        raise ValueError("a keyframe is none of the samples")
    got["keyframes"] = [{"sample": k, "offset": ranges[k - 1][0], "length": ranges[k - 1][1]} for k in keys]
    got["samples"] = n
    return got, ranges


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8, padded to whole frames, as an ISO media file."""

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, data in zip(common.values(batch, "doc_id"), common.utf8(batch, "text"), strict=True):
            yield doc_id, len(data), encode(padded(data))

    common.ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.arrow_rows(STORED, run, 500), STORED)


def describe(frame: DataFrame, column: str = "media") -> DataFrame:
    """frame without its media column, and a description of each file with checksums of the stored samples."""
    rest = [f for f in frame.schema.fields if f.name != column and f.name not in DESCRIBED.names]
    schema = T.StructType([*rest, *DESCRIBED.fields])

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        others = [common.values(batch, f.name) for f in rest]
        for i, media in enumerate(common.utf8(batch, column)):
            row = dict.fromkeys(DESCRIBED.names)
            try:
                found, ranges = parse(media)
                row |= found
                digest, tail, view, n = hashlib.sha256(), b"", memoryview(media), 0
                for at, size in _joined(ranges):
                    digest.update(view[at : at + size])
                    tail = (tail + bytes(view[max(at, at + size - 16) : at + size]))[-16:]
                    n += size
                row |= {"payload_bytes": n, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail)}
            except (ValueError, struct.error, IndexError, KeyError) as e:
                row |= {"error": str(e)[:200]}
            row |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
            yield (*(x[i] for x in others), *(row[k] for k in DESCRIBED.names))

    common.ship(frame.sparkSession)
    return frame.select(*[f.name for f in rest], column).mapInArrow(common.arrow_rows(schema, run, 500), schema)


def _joined(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Neighbouring byte ranges as one."""
    at = size = None
    for a, n in ranges:
        if at is not None and at + size == a:
            size += n
        else:
            if at is not None:
                yield at, size
            at, size = a, n
    if at is not None:
        yield at, size


def feature(frame: DataFrame) -> DataFrame:
    """A one-line summary of each description, as column feature."""
    last = F.element_at("keyframes", -1)
    text = F.concat_ws(
        "|",
        F.concat(F.lit("codec="), F.trim("codec")),
        F.format_string("size=%dx%d", "width", "height"),
        F.format_string("seconds=%d/%d", "duration", "timescale"),
        F.format_string("samples=%d", "samples"),
        F.format_string("keyframes=%d", F.size("keyframes").cast("long")),
        F.format_string("last_keyframe=%d+%d", last["offset"], last["length"]),
    )
    return frame.withColumn("feature", F.when(F.col("error").isNull(), text).otherwise(F.concat(F.lit("error="), "error")))
