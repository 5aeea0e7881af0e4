"""What the operators share: the shared work folder, written intermediate tables, Arrow batches, text helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENT_BYTES = 64 << 20  # of a table that is broadcast

_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir.

    Only a local session (as in tests) without that setting gets a temporary folder instead; on a cluster its lack is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(_own[app])
        base = _own[app]
    return f"{base.rstrip('/')}/tideframe-{uuid.uuid4().hex[:16]}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="tideframe-")
    package = shutil.make_archive(os.path.join(folder, "tideframe_pkg"), "zip", top, "tideframe")
    spark.sparkContext.addPyFile(package)


def written(df: DataFrame, *, partitions: int | None = None, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and lost executors cost a read only."""
    spark = df.sparkSession
    path = shared_dir(spark)
    out = df if partitions is None else df.coalesce(partitions)
    out.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(uri: str):
    """A pyarrow file system and the path in it; the shared folder can be on any store that pyarrow knows."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri) if uri.startswith("file:") else uri
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def release() -> None:
    """Give free memory back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: function, and release() after its last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return run


def arrow_rows(schema: T.StructType, function: Callable[[pa.RecordBatch], Iterable[tuple]], rows: int = 2000, weight: int = 32 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: function gives tuples for a batch; they go out in batches of bounded rows and bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def pack(part: list[tuple]) -> pa.RecordBatch:
        columns = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part: list[tuple] = []
            held = 0
            for row in function(batch):
                part.append(row)
                held += sum(len(x) for x in row if isinstance(x, (bytes, str)))
                if len(part) >= rows or held >= weight:
                    yield pack(part)
                    part, held = [], 0
            if part:
                yield pack(part)

    return released(run)


def utf8(batch: pa.RecordBatch, name: str, step: int = 256) -> Iterator[bytes]:
    """The column's texts as UTF-8, null as empty; only a few are copied at a time."""
    column = batch.column(batch.schema.get_field_index(name))
    for at in range(0, len(column), step):
        for x in column.slice(at, step).cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()):
            value = x.as_py()
            yield b"" if value is None else value


def texts(batch: pa.RecordBatch, name: str, step: int = 256) -> Iterator[str]:
    """The column's texts, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    for at in range(0, len(column), step):
        for value in column.slice(at, step).to_pylist():
            yield value or ""


def values(batch: pa.RecordBatch, name: str) -> list[Any]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def in_code_point_order(values: Iterable[str | None]) -> list[str | None]:
    """Distinct values by code point, null last."""
    return sorted(set(values), key=lambda x: (x is None, x or ""))


def base32_of_hex(hexadecimal: Column) -> Column:
    """The RFC 4648 base-32 text of a 40-digit hexadecimal column, without Python."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes: its texts' and arrays' lengths, and 8 for anything else."""
    total = F.lit(8)
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + 8 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            total = total + 8 + 32 * F.coalesce(F.size(f.name), F.lit(0))
        else:
            total = total + 8
    return total


def small_enough(df: DataFrame, rows: int, most: int = SENT_BYTES) -> bool:
    """Whether a written table has at most so many rows and bytes, so that it can be sent to all tasks."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0)).alias("size")).first()
    return found.n <= rows and found.size <= most


def sent(df: DataFrame, rows: int, most: int = SENT_BYTES) -> DataFrame:
    """A written table, to be broadcast if it is small enough; beyond that a join with it shuffles."""
    return F.broadcast(df) if small_enough(df, rows, most) else df


def tasks(spark: SparkSession, items: int) -> int:
    """For items of work that a task takes one after the other: a task each, but no more than 16 times the shuffle partitions."""
    return max(1, min(items, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
