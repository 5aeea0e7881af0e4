"""Hard negatives of anchor vectors, by exact integer scores from residue number systems.

Vectors are integers; a score is an inner product. Component matrices are reduced modulo several small primes and multiplied
in float32, where every partial sum stays below 2**24 and so is exact; Chinese remaindering gives the score
itself. There are as many primes as the largest lengths of anchors and rows ask for (Cauchy and Schwarz bound every score).

The anchors are a stated query set. They are packed into sheets of bounded size, and every block of rows meets every sheet: a small
table of sheets is sent to all tasks, a larger one is joined by sheet, and by a share of the blocks, so that neither side of a sheet
ends in one task. A task keeps the best rows of each anchor so far; the few that tasks give are ranked by anchor. The first pass
finds each anchor's positives, whose scores set the windows of its second pass over other labels.

Defined cases: rows whose label, key or vector is null, whose vector is empty or holds a null or non-finite entry take no part; neither do
those of another length than most rows have, nor those whose scaled squared length is 2**63 or more, as no long would hold
their scores. Repeated rows are rows of their own, but no row is its own anchor's positive: another one with the anchor's key isn't either. An
empty table, no anchors, one label only: no rows. Ties go to the smaller key. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common, vectors

SHEETS = 1 << 17  # anchors up to which all sheets are sent to all tasks
SENT_BYTES = 8 << 20  # and their bytes
SHARE = 32  # blocks of rows of one share
AT_ONCE, ROWS = 256, 2048  # anchors and rows whose scores are held as an array
HELD = 1 << 17  # anchors whose best rows a task holds

BEST = T.StructType(
    [T.StructField("sheet", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("of", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("other", T.LongType())]
)


def primes_for(width: int, bound: int) -> list[int]:
    """Distinct primes, the largest first, whose product is above 2 * bound and whose residues multiply exactly in float32."""
    most = max(127, min(1021, 2 * math.isqrt((1 << 24) // max(width, 1)) + 1))
    found = [p for p in range(most, 2, -1) if all(p % k for k in range(2, math.isqrt(p) + 1))]
    chosen, product = [], 1
    for p in found:
        chosen.append(p)
        product *= p
        if product > 2 * bound + 1:
            return chosen
    raise ValueError("scores need more primes than there are")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, nearest to 0, as float32."""
    r = np.mod(x.astype(np.int64), p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p (0 up to p - 1) of residues, in exact runs of dimensions."""
    run = (1 << 24) // (p // 2) ** 2
    total = None
    for low in range(0, a.shape[1], run):
        part = (a[:, low : low + run] @ b[:, low : low + run].T).astype(np.int32)
        total = part % p if total is None else (total + part) % p
    return total


def reconstructed(remainders: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed longs of these remainders: mixed-radix digits, the least first, then weighted sums modulo 2**64."""
    digits: list[np.ndarray] = []
    for i, (r, p) in enumerate(zip(remainders, primes, strict=True)):
        r = r.astype(np.int64)
        for k in range(i):
            r = (r - digits[k]) * pow(primes[k], -1, p) % p
        digits.append(r)
    whole = math.prod(primes)
    half, negative, level = whole // 2, np.zeros(digits[0].shape, bool), np.ones(digits[0].shape, bool)
    weights = [math.prod(primes[:i]) for i in range(len(primes))]
    for digit, weight, p in reversed(list(zip(digits, weights, primes, strict=True))):
        edge = half // weight % p
        negative |= level & (digit > edge)
        level &= digit == edge
    out = np.zeros(digits[0].shape, np.uint64)
    with np.errstate(over="ignore"):
        for digit, weight in zip(digits, weights, strict=True):
            out += digit.astype(np.uint64) * np.uint64(weight % (1 << 64))
        out[negative] -= np.uint64(whole % (1 << 64))
    return out.view(np.int64)


class Best:
    """The first rows of each slot so far: by falling score, then rising key."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.slot, self.score, self.other = (np.zeros(0, np.int64) for _ in range(3))
        self.edge = np.full(slots, np.iinfo(np.int64).min)  # a full slot's last score

    def add(self, slot: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, other = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.other, other)))
        order = np.lexsort((other, ~score, slot))
        slot, score, other = slot[order], score[order], other[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        start = np.flatnonzero(first)
        rank = np.arange(len(slot)) - start[np.cumsum(first) - 1]
        keep, last = rank < self.most, rank == self.most - 1
        self.edge[slot[last]] = score[last]
        self.slot, self.score, self.other = slot[keep], score[keep], other[keep]


def _scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    return reconstructed([product(x, y, p) for x, y, p in zip(a, b, primes, strict=True)], primes)


class Sheet:
    """A sheet of anchors and their best rows so far. windows: for each anchor, (rank of the positive, least score, largest score)."""

    def __init__(self, ids: list[int], labels: list[int], x: np.ndarray, primes: list[int], most: int, windows: list[list[tuple[int, int, int]]] | None):
        self.ids, self.labels, self.n = np.array(ids), np.array(labels), len(ids)
        self.residues, self.primes, self.windowed = [residues(x, p) for p in primes], primes, windows is not None
        self.each = max(map(len, windows), default=0) if windows else 1
        self.low, self.high = np.full((2, self.each, self.n), np.iinfo(np.int64).max)
        self.high[:] = np.iinfo(np.int64).min
        self.of = np.zeros((self.each, self.n), np.int64)
        for i, own in enumerate(windows or []):
            for j, (rank, low, high) in enumerate(own):
                self.of[j, i], self.low[j, i], self.high[j, i] = rank, low, high
        self.best = Best(self.each * self.n, most)

    def meet(self, ids: np.ndarray, labels: np.ndarray, b: list[np.ndarray]) -> None:
        """Score rows of at most ROWS against all anchors."""
        for at in range(0, self.n, AT_ONCE):
            part = slice(at, at + AT_ONCE)
            score = _scores([x[part] for x in self.residues], b, self.primes)
            same = self.labels[part, None] == labels
            for j in range(self.each):
                edge = self.best.edge[j * self.n : (j + 1) * self.n][part, None]
                if self.windowed:
                    fits = ~same & (score <= self.high[j, part, None]) & (score >= np.maximum(self.low[j, part, None], edge))
                else:
                    fits = same & (self.ids[part, None] != ids) & (score >= edge)
                row, column = np.nonzero(fits)
                self.best.add(j * self.n + at + row, score[row, column], ids[column])

    def found(self, sheet: int) -> pa.RecordBatch:
        slot = self.best.slot
        of = self.of.reshape(-1)[slot]
        columns = [pa.array(np.full(len(slot), sheet)), pa.array((slot % self.n).astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(self.best.score), pa.array(self.best.other)]
        return pa.RecordBatch.from_arrays(columns, names=BEST.names)


def _pairs(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Each block of rows with each sheet."""
    count = sheets.agg(F.max("sheet")).first()[0] + 1
    sheets = sheets.select("sheet", *(F.col(c).alias(f"a_{c}") for c in sheets.columns if c != "sheet"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    if sheets.agg(F.sum(F.size("a_ids"))).first()[0] <= SHEETS and common.small_enough(sheets, SHEETS, SENT_BYTES):
        return rows.withColumn("sheet", numbers).join(F.broadcast(sheets), "sheet")
    shares = max(1, -(-rows.count() // SHARE))
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("data"), F.lit(shares))).withColumn("sheet", numbers)
    salted = sheets.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return dealt.join(salted.hint("merge"), ["sheet", "share"])


def best_rows(rows: DataFrame, sheets: DataFrame, width: int, primes: list[int], most: int) -> DataFrame:
    """For each anchor (sheet, at), and each of its windows (of) if sheets have these, its first `most` rows, as a written table with their rank."""
    windowed = "windows" in sheets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Sheet] = {}
        for batch in batches:
            at = batch.schema.get_field_index
            for i in range(batch.num_rows):
                value = lambda c, i=i, batch=batch, at=at: batch.column(at(c))[i].as_py()
                number = value("sheet")
                if number not in held:
                    if sum(s.n for s in held.values()) > HELD:
                        yield from (s.found(k) for k, s in held.items())
                        held.clear()
                    windows = [[(w["of"], w["low"], w["high"]) for w in own or []] for own in value("a_windows")] if windowed else None
                    held[number] = Sheet(value("a_ids"), value("a_labels"), vectors.matrix(value("a_kind"), value("a_data"), width), primes, most, windows)
                ids, labels = (batch.column(at(c))[i].values.to_numpy() for c in ("ids", "labels"))
                x = vectors.matrix(value("kind"), value("data"), width)
                for low in range(0, len(x), ROWS):
                    part = slice(low, low + ROWS)
                    held[number].meet(ids[part], labels[part], [residues(x[part], p) for p in primes])
        yield from (s.found(k) for k, s in held.items())

    found = _pairs(rows.select("ids", "labels", "kind", "data"), sheets).mapInArrow(common.released(run), BEST)
    order = Window.partitionBy("sheet", "at", "of").orderBy(F.desc("score"), "other")
    return common.written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most))


def mine(
    df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first positives, the first
    rows of other labels whose score is from low to high percent of the positive's. anchors says which rows are anchors; entries count as floor(scale * entry).
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usable = df.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    rows, width, n = vectors.of_commonest_width(vectors.blocks(usable, key, vector, scale, F.col(label), bounded=True))
    if not n:
        return spark.createDataFrame([], schema)
    asked = usable.where(anchors)
    parts = max(1, -(-asked.count() // vectors.BLOCK_ROWS))
    packed = vectors.blocks(asked.select(key, vector, label).repartition(parts), key, vector, scale, F.col(label), bounded=True).where(F.col("width") == width)
    number = F.row_number().over(Window.orderBy("part", "id")) - 1  # a row for each sheet
    chosen = packed.withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id())
    chosen = common.written(chosen)
    numbers = chosen.select("part", "id").withColumn("sheet", number.cast("long"))
    sheets = common.written(chosen.join(numbers, ["part", "id"]).select("sheet", "norm", "ids", "labels", "kind", "data"))
    longest = sheets.agg(F.max("norm")).first()[0]
    if longest is None:
        return spark.createDataFrame([], schema)
    bound = math.isqrt(int(longest) * int(rows.agg(F.max("norm")).first()[0])) + 1
    primes = primes_for(width, bound)
    first = best_rows(rows, sheets.drop("norm"), width, primes, positives)
    # in two parts, as a multiple of a score may not fit into a long
    whole, rest = F.expr("score div 100 - if(score % 100 < 0, 1, 0)"), F.expr("pmod(score, 100)")
    least = whole * low + F.ceil(rest * low / 100).cast("long")
    most = whole * high + F.floor(rest * high / 100).cast("long")
    windows = first.groupBy("sheet", "at").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("of"), least.alias("low"), most.alias("high")))).alias("w"))
    by_sheet = windows.groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("by"))
    asked = sheets.join(by_sheet, "sheet")
    places = F.sequence(F.lit(0), F.size("ids") - 1)
    asked = common.written(asked.select("sheet", "ids", "labels", "kind", "data", F.transform(places, lambda i: F.try_element_at("by", i)).alias("windows")))
    if asked.isEmpty():
        return spark.createDataFrame([], schema)
    second = best_rows(rows, asked, width, primes, negatives)
    named = asked.select("sheet", F.posexplode("ids").alias("at", "anchor_id"))
    own = first.select("sheet", "at", F.col("rank").alias("of"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    found = second.withColumnRenamed("score", "negative_score").withColumnRenamed("other", "negative_id").join(own, ["sheet", "at", "of"]).join(named, ["sheet", "at"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
