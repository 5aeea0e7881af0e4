"""Tables of vectors as blocks of small integers, which passes over all rows read instead of the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common

BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8192  # of a block, as 64-bit integers
HELD_BYTES = 32 << 20  # of rows that wait for a full block

BLOCKS = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("norm", T.DecimalType(38, 0)),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("labels", T.ArrayType(T.LongType())),
        T.StructField("kind", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def whole_rows(vectors: pa.ListArray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, floor(scale * entry) as longs) of the rows of each length whose entries are all there, finite, and below 2**62 when scaled."""
    flat, lengths = vectors.flatten(), pc.list_value_length(vectors).fill_null(0).to_numpy()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * scale)
        bad = ~(np.abs(scaled) < 2.0**62)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    faults = np.concatenate([[0], np.cumsum(bad)])
    good = (faults[starts[1:]] == faults[starts[:-1]]) & (lengths > 0)
    for width in np.unique(lengths[good]).tolist():
        at = np.flatnonzero(good & (lengths == width))
        yield at, scaled[starts[at][:, None] + np.arange(width)].astype(np.int64)


def largest_norm(x: np.ndarray) -> tuple[int, np.ndarray]:
    """The largest squared length that is below 2**63, and which rows have one."""
    about = (x.astype(np.float64) ** 2).sum(1)
    near = np.flatnonzero(about > 2.0**62)
    fits = np.ones(len(x), bool)
    exact = [sum(v * v for v in row) for row in x[near].tolist()]
    fits[near] = [v < 1 << 63 for v in exact]
    small = (x[about <= 2.0**62] ** 2).sum(1)  # no sum of these overflows
    return max([0, *small.tolist(), *(v for v in exact if v < 1 << 63)]), fits


def _block(parts: list[tuple[np.ndarray, ...]]) -> tuple:
    ids, known, labels, x = (np.concatenate(c) for c in zip(*parts, strict=True))
    kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
    return x.shape[1], len(x), largest_norm(x)[0], [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], labels.tolist(), kind, x.astype(kind).tobytes()


def blocks(df: DataFrame, key: str, vector: str, scale: float, label: Column | None = None, bounded: bool = False) -> DataFrame:
    """df's usable rows as a written table of BLOCKS: integers floor(scale * entry), row by row, of vectors of one width each.

    Left out are vectors that are null, empty, hold a null or non-finite entry, or one of 2**62 and more when scaled; if bounded, also
    those whose squared length, scaled, is 2**63 or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
        rows: dict[int, int] = {}

        def packed(width: int) -> pa.RecordBatch:
            width, n, norm, ids, labels, kind, data = _block(waiting.pop(width))
            rows.pop(width)
            values = ([width], [n], [norm], [ids], [labels], [kind], [data])
            kinds = (pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=BLOCKS.names)

        for batch in batches:
            keys, labels = batch.column(0), batch.column(2).fill_null(0).to_numpy()
            known, ids = keys.is_valid().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy()
            for at, x in whole_rows(batch.column(1), scale):
                if bounded:
                    fits = largest_norm(x)[1]
                    at, x = at[fits], x[fits]
                width = x.shape[1]
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
                low = 0
                while low < len(at):
                    take = min(len(at) - low, most - rows.get(width, 0))
                    part = at[low : low + take]
                    waiting.setdefault(width, []).append((ids[part], known[part], labels[part], x[low : low + take]))
                    rows[width] = rows.get(width, 0) + take
                    low += take
                    if rows[width] >= most:
                        yield packed(width)
            if sum(8 * w * n for w, n in rows.items()) > HELD_BYTES:
                for width in list(waiting):
                    yield packed(width)
        for width in list(waiting):
            yield packed(width)

    common.ship(df.sparkSession)
    chosen = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), (F.lit(0) if label is None else label).cast("long").alias("label"))
    return common.written(chosen.where("vector IS NOT NULL").mapInArrow(common.released(run), BLOCKS))


def of_commonest_width(packed: DataFrame) -> tuple[DataFrame, int, int]:
    """The blocks of the width that most rows have (the larger of equals), that width, and the number of rows; 0, 0 without rows."""
    best = packed.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return (packed.where("false"), 0, 0) if best is None else (packed.where(F.col("width") == best.width), best.width, best.n)


def matrix(kind: str, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width)
