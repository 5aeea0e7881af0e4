"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of all rows is never formed. One pass over the rows gives V Q for a block Q of some more columns than
wanted components: each task sums X'(X Q) over its centred rows, Spark adds the sums up by dimension, and the driver
gets dimension x block numbers, however many rows there are. A filter is a Chebyshev polynomial of V, by its three-term recurrence,
one pass a degree: it stays below 1 on the unwanted part of the spectrum and grows fast above it. Then QR and
Rayleigh-Ritz (one pass) give new estimates, until the residuals |V q - e q| of all wanted components are at rounding level.

The unwanted part reaches from a lower bound of the spectrum, from a few Lanczos steps, to the block's smallest estimate.

Rows are centred exactly: integers n * x - S, then divided by n. So an offset that all entries share costs no precision.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so is one with an
entry that no long holds once scaled, and one of another length than most rows have (of equally common lengths the longer counts).
Repeated rows and null ids stay. Components whose variance is below RANK of the largest are rounding only and aren't given, so there is
no row at all for an empty table or equal vectors. Extra columns are ignored. deviation is exact, as a decimal, and null from
10**38 on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common, vectors

COMPONENTS = 32
EXTRA = 16  # columns of the block beyond the components
LANCZOS = 10  # steps
DEGREE = 16  # most of one filter
GROWTH = 1e8  # most by which a filter may grow the first component over the last wanted one
TOLERANCE, FLOOR = 2e-14, 1e-11  # of residuals over the largest variance: done at once, and done when they fall no further
ROUNDS = 200
RANK = 1e-12
OUT_ROWS = 1024

WHITENED = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
        T.StructField("residual", T.DoubleType()),
    ]
)


def scaled_centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs, or Python's integers where longs might overflow."""
    if n * max(int(x.max()), -int(x.min())) + max(map(abs, sums)) < 1 << 62:
        return x.astype(np.int64) * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return scaled_centred(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None] | np.ndarray:
    d = scaled_centred(x, n, sums)
    if d.dtype != object and x.shape[1] * max(int(d.max()), -int(d.min())) ** 2 < 1 << 63:
        return (d * d).sum(1)
    found = [sum(int(v) ** 2 for v in row) for row in d.tolist()]
    return [Decimal(v) if v < 10**38 else None for v in found]


class Rows:
    """The blocks of a table of vectors, centred, for passes over all of them."""

    def __init__(self, packed: DataFrame):
        self.packed, self.width, self.n = vectors.of_commonest_width(packed)
        self.spark = packed.sparkSession
        self.sums = self._sums() if self.n else []

    def _sums(self) -> list[int]:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * width
            for batch in batches:
                for kind, data in zip(common.values(batch, "kind"), common.values(batch, "data"), strict=True):
                    x = vectors.matrix(kind, data, width)
                    if kind == "int64":
                        part = [(a << 32) + b for a, b in zip((x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist(), strict=True)]
                    else:
                        part = x.sum(0, dtype=np.int64).tolist()
                    total = [a + b for a, b in zip(total, part, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], names=["i", "s"])

        found = self.packed.select("kind", "data").mapInArrow(common.released(run), "i int, s decimal(38, 0)").groupBy("i").agg(F.sum("s").alias("s"))
        by = {r.i: int(r.s) for r in found.collect()}
        return [by[i] for i in range(width)]

    def total(self, function: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of function(centred block), a matrix of that shape, over all blocks: one pass."""
        width, n, sums = self.width, self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for kind, data in zip(common.values(batch, "kind"), common.values(batch, "data"), strict=True):
                    part = function(centred(vectors.matrix(kind, data, width), n, sums))
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "y"])

        parts = self.packed.select("kind", "data").mapInArrow(common.released(run), "i int, y array<double>")
        found = parts.groupBy("i").agg(*(F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(shape[1])))
        out = np.zeros(shape)
        for r in found.collect():
            out[r[0]] = r[1:]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        return self.total(lambda x: x.T @ (x @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda x: (x * x).sum(0)[:, None], (self.width, 1)).sum() / self.n)


def lower_bound(times: Callable[[np.ndarray], np.ndarray], width: int, seed: np.random.Generator) -> float:
    """A bound that the spectrum isn't expected to go below: the least estimate of a few Lanczos steps, less the last remainder."""
    q = seed.standard_normal((width, 1))
    basis = [q / np.linalg.norm(q)]
    alpha, beta = [], []
    for _ in range(min(LANCZOS, width)):
        r = times(basis[-1])
        alpha.append(float((basis[-1].T @ r)[0, 0]))
        for _ in range(2):
            for b in basis:
                r = r - b * float((b.T @ r)[0, 0])
        beta.append(float(np.linalg.norm(r)))
        if beta[-1] <= 1e-10 * max(alpha):
            break
        basis.append(r / beta[-1])
    tri = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    values, rotation = np.linalg.eigh(tri)
    return max(0.0, float(values[0]) - beta[-1] * max(0.1, abs(float(rotation[-1, 0]))))


def degree(low: float, high: float, wanted: float, first: float) -> int:
    """The filter's degree: as large as DEGREE and GROWTH allow."""
    centre, half = (low + high) / 2, (high - low) / 2
    a, b = (np.arccosh(max(1.0, (v - centre) / half)) for v in (first, wanted))
    return int(max(1, min(DEGREE, np.log(GROWTH) / (a - b) if a > b else DEGREE)))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, v_q: np.ndarray, m: int, low: float, high: float, first: float) -> np.ndarray:
    """The Chebyshev polynomial of degree m of V, for the interval from low to high and about 1 at first, times q. v_q is V q, so that degree 1 takes no pass."""
    centre, half = (low + high) / 2, (high - low) / 2
    s1 = s = half / (first - centre)
    before, now = q, (v_q - centre * q) * (s / half)
    for _ in range(m - 1):
        s_next = 1 / (2 / s1 - s)
        before, now = now, (times(now) - centre * now) * (2 * s_next / half) - before * (s * s_next)
        s = s_next
    return now


def principal(times: Callable[[np.ndarray], np.ndarray], width: int, components: int = COMPONENTS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances (falling), unit vectors (columns) and relative residuals of V's first components, V being given by products with it."""
    random = np.random.default_rng(seed)
    block = min(width, components + EXTRA)
    wanted = min(components, width)
    y = random.standard_normal((width, block))
    low, last = None, np.inf
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(y)
        v_q = times(q)
        h = q.T @ v_q
        e, rotation = np.linalg.eigh((h + h.T) / 2)
        e, rotation = e[::-1], rotation[:, ::-1]
        q, v_q = q @ rotation, v_q @ rotation
        if not e[0] > 0:
            return np.zeros(0), np.zeros((width, 0)), np.zeros(0)
        keep = np.flatnonzero(e[:wanted] > RANK * e[0])
        residuals = np.linalg.norm(v_q - q * e, axis=0)[keep] / e[0]
        worst = residuals.max()
        if worst <= TOLERANCE or block == width or last / 2 < worst <= FLOOR:
            return e[keep], q[:, keep], residuals
        last = worst
        if low is None:
            low = lower_bound(times, width, random)
        high = e[-1]
        under = min(low, 0.9 * high)
        y = filtered(times, q, v_q, degree(under, high, e[wanted - 1], e[0]), under, high, e[0]) if high > RANK * e[0] else v_q
    raise ArithmeticError(f"residuals of {worst} after {ROUNDS} filters")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64, components: int = COMPONENTS) -> DataFrame:
    """A row of WHITENED for each usable row and component.

    x is floor(scale * entry); any whole number may be added to all of them, as nothing here depends on it. residual is |V q - e q| over the largest variance.
    """
    spark = df.sparkSession
    rows = Rows(vectors.blocks(df, key, vector, scale))
    e, q, residuals = principal(rows.times, rows.width, components) if rows.n else (np.zeros(0),) * 3
    k, n, sums, width = len(e), rows.n, rows.sums, rows.width
    if not k:
        return spark.createDataFrame([], WHITENED)
    w = q / np.sqrt(e)

    def moments(x: np.ndarray) -> np.ndarray:
        z = x @ w
        return np.vstack([z.T @ z, z.sum(0)[None, :]])

    found = rows.total(moments, (k + 1, k)) / n
    identity = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = e / rows.trace()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, kind, data in zip(batch.column("ids"), common.values(batch, "kind"), common.values(batch, "data"), strict=True):
                whole = vectors.matrix(kind, data, width)
                for low in range(0, len(whole), OUT_ROWS):
                    x = whole[low : low + OUT_ROWS]
                    m = len(x)
                    each = pa.array(np.repeat(np.arange(m), k))
                    d = deviations(x, n, sums)
                    d = pa.array(d, pa.int64()).cast(pa.decimal128(38, 0), safe=False) if isinstance(d, np.ndarray) else pa.array(d, pa.decimal128(38, 0))
                    own = ids.values.slice(low, m).take(each)
                    columns = [own, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), d.take(each), pa.array((centred(x, n, sums) @ w).reshape(-1))]
                    columns += [pa.array(np.tile(v, m)) for v in (explained, np.full(k, identity), residuals)]
                    yield pa.RecordBatch.from_arrays(columns, names=WHITENED.names)

    return rows.packed.select("ids", "kind", "data").mapInArrow(common.released(run), WHITENED)
