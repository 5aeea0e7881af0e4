"""N-gram Jaccard self-join by vertical partitioning.

All n-grams have one global order, that of a 64-bit hash. It is cut into fragments; a document's part of a
fragment is a segment. That is used twice.

Counting: the segments of the sets that are compared are dealt out by fragment; in each fragment the overlap of a
pair's two segments is counted on its own, a fragment whose lengths and positions rule the pair out counts nothing, and
Spark sums the partial counts for each pair. A sum that reaches the threshold is a link.

Candidates: sets of Jaccard similarity t differ in at most (1 - t) / (1 + t) * (|a| + |b|) n-grams, so with more
fragments than that, linked sets have equal segments in some fragment (bands() has the two ways of cutting, both
exact). Sizes are cut into bands, each with its own number of fragments; a set also enters the next bands where a larger
partner could be. Sizes and sketches then rule pairs out. Each set's nearest candidate is counted first; what these links
connect already needs no further count.

Segments of very many sets never give all their pairs: the sets hang on one of them, and the links of these stars are
counted like others. Where a star's sets aren't all connected by then, what isn't meets the rest in blocks of
bounded size. No link between different sets is lost, and no list of a group's pairs is made.

Defined cases: texts that are null, empty or without words have an empty set and are linked with nothing; a text of
fewer words than an n-gram has its whole word sequence as one. Equal sets are linked. A null doc_id takes part, but is
never a component's id unless it has no other member. Repeated rows link with each other. Very long texts are cut into
n-grams whole. Extra columns, also those named as the results, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common
from tideframe.llm.components import components

SPREAD, NARROW = 1.4, 1.12  # largest over smallest size of a band
SOLID, LONG = 5, 384  # n-grams that a signature should hold, of sets of less than LONG
MOST_SLACK = 16
TIMES = 56  # bits of a set's number
CELLS_LEAST, CELL_GRAMS = 64, 4  # cells of a sketch, and the n-grams that a cell holds at least in larger ones
FEW, LOCAL = 24, 12  # sets of a signature up to which its pairs are looked at, in all and in one part of the input
HELD = 4096  # rows of one signature that a task holds
PART = 1000  # sets whose signatures are looked through together before they go out
FRAGMENTS = 8  # of the counting
SKETCHED_SETS, SKETCHED_BYTES = 2048, 4 << 20  # bounds of a block of sketches of sets that stars leave open
BLOCK_SETS, BLOCK_GRAMS = 1024, 4 << 20  # bounds of a block of such sets
CELLS = 4 << 20  # of the array that counts one fragment's overlaps there
LIGHT, FRAGMENT = 24, 1 << 18  # sets up to which an n-gram's pairs are counted one by one, and n-grams of a fragment then
ROUNDS, MANY = 3, 10_000  # of nearest candidates, and candidates left that are worth one more
HASHED_ROWS = 1_000_000  # rows of ids up to which a side is sent to all tasks

SETS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_hash", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("signatures", T.ArrayType(T.LongType())),
    ]
)
SIGNATURES = T.StructType([T.StructField("signature", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
SEGMENTS = T.StructType([T.StructField("sid", T.LongType()), T.StructField("fragment", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("after", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("times", T.LongType())])
CLOSE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("need", T.LongType()), T.StructField("far", T.LongType())])
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Hashes of words, kept while there is room."""

    LIMIT = 60_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = Words()


def grams(text: bytes, width: int) -> np.ndarray:
    """The text's n-grams as sorted distinct hashes. Only A-Z are lower-cased; words are split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, _U)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\n" + b" ".join(words))], _U)
    h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


class Band(NamedTuple):
    low: int
    high: int
    fragments: int  # 0: only equal sets can link
    spare: int  # empty signatures that a set needn't send
    of_three: bool  # signatures are two of each three neighbouring fragments
    slack: int  # linked sets have more equal signatures than that


@cache
def bands(percent: int, upto: int) -> tuple[Band, ...]:
    """How sets of each size are cut. Two sets of a band differ in at most `apart` n-grams.

    Short signatures would be equal by chance wherever documents share a passage, so those of sets up to LONG n-grams
    should hold SOLID n-grams or so. Two ways, the first that gives that:

    - more than `apart` fragments: one is equal in both sets;
    - 3/2 * apart fragments: two of three neighbours are equal in both sets, for some three. Bands are narrow then,
      so that smaller sets have no shorter signatures than need be.

    Spare equal signatures make up for empty ones, which aren't sent unless a set has more of them. Slack is there so that
    linked sets don't only share what very many sets share (see stars_left()); it never falls with the size.
    """
    out, low = [], 1
    while low <= upto:
        high = max(low, int(low * SPREAD))
        apart = 2 * high * (100 - percent) // (100 + percent)
        band = Band(low, high, 0, 0, False, 0)
        if apart:
            slack = min(MOST_SLACK, apart // 8)
            spare = max(1, math.ceil((apart + 2) * math.exp(-low * percent / 100 / (apart + 2))))
            band = Band(low, high, apart + 1 + spare + slack, spare, False, slack)
            if low / (apart + 1 + spare) < SOLID and low < LONG:
                high = max(low, int(low * NARROW))
                apart = 2 * high * (100 - percent) // (100 + percent)
                slack = min(MOST_SLACK, apart // 8)
                band = Band(low, high, 3 * (-(-(apart + 3) // 2) + slack) if apart else 0, 1, True, slack)
        out.append(band)
        low = high + 1
    return tuple(out)


def signatures(s: np.ndarray, percent: int, all_bands: tuple[Band, ...]) -> np.ndarray:
    """Hashes of the set's segments, in its band and in any with larger partners."""
    n = len(s)
    parts: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(s ^ _U(0x5851F42D4C957F2D)))])
        top = s >> _U(32)
        for k, band in enumerate(all_bands):
            if band.high < n:
                continue
            if band.low > n and percent * band.low > 100 * n:
                break
            if not band.fragments:
                continue
            edges = np.searchsorted((top * _U(band.fragments)) >> _U(32), np.arange(band.fragments + 1, dtype=_U))
            total, size = sums[edges[1:]] - sums[edges[:-1]], np.diff(edges).astype(_U)
            if band.of_three:
                total, size = (np.concatenate([x[0::3] + x[1::3], x[0::3] + x[2::3], x[1::3] + x[2::3]]) for x in (total, size))
            place = np.arange(len(total), dtype=_U) + _U(k << 32)
            found = mix(mix(total + size) + place * _U(0x9E3779B97F4A7C15))
            parts.append(found if (size == 0).sum() > band.spare else found[size > 0])
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def slacks(percent: int) -> list[tuple[int, int]]:
    """(least size, slack) wherever the slack grows; it is the same for all sizes beyond the last."""
    upto = 1 << 12
    while bands(percent, upto)[-1].slack < MOST_SLACK and upto < 1 << 20:
        upto *= 2
    steps: dict[int, int] = {}
    for band in bands(percent, upto):
        steps.setdefault(band.slack, band.low)
    return [(low, slack) for slack, low in steps.items()]


def sketch(s: np.ndarray) -> bytes:
    """How many n-grams fall into each cell, at most 255. Two sets differ in at least as many n-grams as their sketches in counts.

    The number of cells is a power of two that grows with the set, as few cells would be alike in all large sets; cells of a
    finer sketch add up to those of a coarser one.
    """
    cells = max(CELLS_LEAST, 1 << max(0, (len(s) // CELL_GRAMS).bit_length() - 1))
    return np.minimum(np.bincount(((s >> _U(20)) & _U(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def sketches_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the n-grams in which two sets differ. Coarser cells are summed from finer ones; full ones count as full."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    n = min(len(a), len(b))
    a, b = a.reshape(-1, n), b.reshape(-1, n)
    full = (a == 255).any(0) | (b == 255).any(0)
    return int(np.abs(a.sum(0) - b.sum(0))[~full].sum())


def sets_of(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """A row of SETS for each row, as a written table: the one pass over all texts.

    set_hash (128 bits) is null without words; signatures stand in the first row of a set within a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36  # below 2 ** TIMES for a million partitions
        known = bands(percent, 1 << 12)
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                sizes, hashes, sketches, sent = [], [], [], []
                same: dict[int, int] = {}  # texts of the part
                seen: set[bytes] = set()
                for i, (key, text) in enumerate(zip(part.column(1).to_pylist(), common.utf8(part, "text"), strict=True)):
                    if key in same and (key is None or part.column(2)[i] == part.column(2)[same[key]]):
                        first = same[key]
                        sizes.append(sizes[first])
                        hashes.append(hashes[first])
                        sketches.append(sketches[first])
                        sent.append(None)
                        continue
                    same[key] = i
                    s = grams(text, width)
                    if len(s) * 100 > percent * known[-1].low:
                        known = bands(percent, 4 * len(s))
                    own = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    sizes.append(len(s))
                    hashes.append(own)
                    sketches.append(sketch(s))
                    sent.append(None if own is None or own in seen else signatures(s, percent, known).view(np.int64))
                    seen.add(own)
                ids = pa.array(np.arange(number, number + part.num_rows))
                number += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [ids, part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sketches, pa.binary()), pa.array(sent, pa.list_(pa.int64()))], names=SETS.names
                )

    common.ship(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return common.written(docs.mapInArrow(common.released(run), SETS))


def distinct_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row of each set, whose row_id is the set's sid, and (set_hash, sid) of the sets that occur again."""
    again = sets.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("row_id").alias("sid"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = common.written(again)
    copies = sets.select("row_id", "set_hash").join(common.sent(again, HASHED_ROWS), "set_hash").where("row_id <> sid").select("row_id")
    copies = common.written(copies)
    first = sets.where("set_hash IS NOT NULL").join(common.sent(copies, HASHED_ROWS), "row_id", "left_anti").withColumnRenamed("row_id", "sid")
    return first, again


def candidate_pairs(first: DataFrame) -> DataFrame:
    """(a, b, star) of sets that have a signature in common; of stars b is the set that a hangs on.

    A signature of few sets gives their pairs. One of more gives a star, never all pairs: star edges only say that
    the sets may hang together. A task first looks through its own sets: a signature of many sets there sends
    one row on and the others' edges to it, so a signature, however common, sends few rows for each part of the
    input. Equal signatures then meet in one partition, sorted, in a stream that holds a bounded run. Star
    rows come once for each signature.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                lists = part.column(1)
                flat = lists.flatten().to_numpy()
                if not len(flat):
                    continue
                own = np.repeat(part.column(0).to_numpy(), pc.list_value_length(lists).fill_null(0).to_numpy())
                order = np.lexsort((own, flat))
                flat, own = flat[order], own[order]
                first, run, size = _runs(flat)
                many = size[run] > LOCAL
                lead = own[np.flatnonzero(first)][run]
                # (signature, set, null), (signature, set, the same set) for one that stands for others, (any, set, set it
                # hangs on and, above that, how often; many times are as good as 127, see MOST_SLACK)
                rows = ~many | first
                hangs, times = np.unique(np.stack([own, lead], 1)[many & ~first], axis=0, return_counts=True)
                none = np.concatenate([~many[rows], np.zeros(len(hangs), bool)])
                packed = hangs[:, 1] | np.minimum(times, 127) << TIMES
                columns = [np.concatenate(x) for x in ((flat[rows], hangs[:, 0]), (own[rows], hangs[:, 0]), (own[rows], packed))]
                out = pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], mask=none)], names=SIGNATURES.names)
                for low in range(0, out.num_rows, 50_000):
                    yield out.slice(low, 50_000)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        for batch in batches:
            keys, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            other, none = batch.column(2).fill_null(0).to_numpy(), batch.column(2).is_null().to_numpy(zero_copy_only=False)
            edge = ~none & (other != own)
            out = [(own[edge], other[edge] & ((1 << TIMES) - 1), np.ones(int(edge.sum()), np.int8), other[edge] >> TIMES)]
            keys, own, stands = (np.concatenate(x) for x in zip(held, (keys[~edge], own[~edge], ~none[~edge]), strict=True))
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # that run may go on
            out += _linked(keys[:last], own[:last], stands[:last])
            held = keys[last:], own[last:], stands[last:]
            if len(held[0]) > HELD:  # a star's centre stands for the run so far
                out.append((held[1][1:], np.full(len(held[1]) - 1, held[1][0]), 1 + held[2][1:].astype(np.int8), np.ones(len(held[1]) - 1, np.int64)))
                held = held[0][:1], held[1][:1], np.ones(1, bool)
            if batch := _pairs(out):
                yield batch
        if batch := _pairs(_linked(*held)):
            yield batch

    n = max(1, int(first.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = first.select("sid", "signatures").mapInArrow(common.released(emit), SIGNATURES)
    return rows.repartition(n, "signature").sortWithinPartitions("signature").mapInArrow(common.released(link), PAIRS)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: whether a row begins a run, the number of its run, and the sizes of the runs."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(first) - 1
    return first, run, np.bincount(run) if len(keys) else np.zeros(0, np.int64)


def _linked(keys: np.ndarray, own: np.ndarray, stands: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Pairs of the whole runs of a signature (0), or stars where it has many sets (1) or ones that stand for others (2 for these)."""
    if not len(keys):
        return []
    first, run, size = _runs(keys)
    star = ((size > FEW) | (np.bincount(run, stands) > 0))[run]
    lead = own[np.flatnonzero(first)][run]
    out = [(own[star], lead[star], 1 + stands[star].astype(np.int8), np.ones(int(star.sum()), np.int64))]
    for step in range(1, min(FEW, len(keys))):
        near = np.flatnonzero((run[step:] == run[:-step]) & ~star[step:])
        if not len(near):
            break
        a, b = own[near], own[near + step]
        out.append((np.minimum(a, b), np.maximum(a, b), np.zeros(len(near), np.int8), np.ones(len(near), np.int64)))
    return out


def _pairs(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
    """Distinct rows, with the number of times that each came."""
    a, b, kind, times = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 4
    if not len(a):
        return None
    order = np.lexsort((kind, b, a))
    a, b, kind, times = a[order], b[order], kind[order], times[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])
    at = np.flatnonzero(first)
    return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(kind[at].astype(np.int32)), pa.array(np.add.reduceat(times, at))], names=PAIRS.names)


def slack_by_size(percent: int) -> Column:
    slack = F.lit(0)
    for low, most in slacks(percent):
        slack = F.when(F.col("n") >= low, F.lit(most)).otherwise(slack)
    return slack


def asked_pairs(pairs: DataFrame, sizes: DataFrame, percent: int, slack: Column, of: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b, n_a, n_b, s_a, s_b; s from the column `of` of sizes) that signatures and sizes don't rule out, and the star edges (a, b) that count.

    sizes: sid, n, `of`. Linked sets have more equal signatures than their
    slack, so a pair needs as many, counted over all signatures, those of stars being taken as equal. A set with no more than
    that in stars has a rarer signature in common with each set that it is linked with, and so needs no star. What
    stands for others in a part of the input keeps its edge.
    """
    kinds = common.written(pairs.groupBy("a", "b", "kind").agg(F.sum("times").alias("times")))
    hot = kinds.where("kind > 0").groupBy(F.col("a").alias("sid")).agg(F.sum("times").alias("hot"), F.max(F.col("kind") == 2).alias("stands"))
    known = sizes.select("sid", "n").join(hot, "sid", "left").select("sid", "n", slack.alias("slack"), F.coalesce("hot", F.lit(0)).alias("hot"), F.coalesce("stands", F.lit(False)).alias("stands"))
    known = common.written(known)
    needed = common.written(known.where("stands OR hot > slack").select("sid"))
    stars = kinds.where("kind > 0 AND a <> b").select("a", "b").distinct().join(common.sent(needed, HASHED_ROWS), F.col("a") == F.col("sid"), "left_semi")
    stars = common.written(stars)
    asked = kinds.where("kind = 0").select("a", "b", "times").union(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).cast("long")))
    asked = asked.groupBy("a", "b").agg(F.sum("times").alias("times"))
    small = common.small_enough(known, HASHED_ROWS)
    for x in ("a", "b"):
        side = known.select(F.col("sid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "slack", "hot")))
        asked = asked.join(F.broadcast(side) if small else side, x)
    asked = asked.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND times + least(hot_a, hot_b) > least(slack_a, slack_b)")
    for x in ("a", "b"):
        asked = asked.join(sizes.select(F.col("sid").alias(x), F.col(of).alias(f"s_{x}")), x)
    return asked.select("a", "b", "n_a", "n_b", "s_a", "s_b"), stars


def close_pairs(pairs: DataFrame, sizes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b, need, far), nearest by sketch if far is least, that neither signatures, sizes nor sketches rule out, and the star edges.

    need is the overlap of a link.
    """
    asked, stars = asked_pairs(pairs, sizes, percent, slack_by_size(percent), "sketch")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            far = np.array([sketches_apart(x, y) for x, y in zip(common.values(batch, "s_a"), common.values(batch, "s_b"), strict=True)], np.int64)
            keep = pa.array((100 + percent) * far <= (100 - percent) * n)
            need = -(-percent * n // (100 + percent))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("a", "b")), pa.array(need).filter(keep), pa.array(1000 * far // np.maximum(n, 1)).filter(keep)], names=CLOSE.names)

    return common.written(asked.mapInArrow(common.released(close), CLOSE)), stars


def segments_of(documents: DataFrame, chosen: DataFrame, width: int, fragments: int) -> DataFrame:
    """The segments (rows of SEGMENTS, as a written table) of the chosen sets: sid, and doc_id and text_key of a row that has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                rows: list[tuple] = []
                for sid, text in zip(common.values(part, "sid"), common.utf8(part, "text"), strict=True):
                    s = grams(text, width)
                    edges = np.searchsorted(((s >> _U(32)) * _U(fragments)) >> _U(32), np.arange(fragments + 1, dtype=_U))
                    rows += [(sid, f, int(edges[f]), len(s) - int(edges[f + 1]), s[edges[f] : edges[f + 1]].view(np.int64)) for f in range(fragments) if edges[f] < edges[f + 1]]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=SEGMENTS.names)

    return common.written(_texts_of(documents, chosen).mapInArrow(common.released(run), SEGMENTS))


def _texts_of(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (written; with doc_id and text_key) with the rows' texts, one row each."""
    side = common.sent(chosen, HASHED_ROWS)
    docs = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).withColumn("_key", F.xxhash64("text"))
    found = docs.join(side, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id"))).drop("_id", "_key")
    return found


def linked(pairs: DataFrame, segments: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """Those of the pairs (a, b, need) whose overlap reaches need, as a written table.

    Segments meet by set and fragment. A fragment counts nothing where the lengths before and after it and its own overlap
    rule the pair out; the partial counts are summed for each pair. A repeated row gives its segments again, so a
    fragment counts once however often it comes.
    """
    side = lambda x: segments.select(F.col("sid").alias(x), "fragment", *(F.col(c).alias(f"{c}_{x}") for c in ("before", "after", "grams")))
    met = pairs.select("a", "b", "need").join(side("a"), "a").join(side("b"), ["b", "fragment"])
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    apart = F.abs(F.col("before_a") - F.col("before_b")) + F.abs(F.col("after_a") - F.col("after_b")) + F.size("grams_a") + F.size("grams_b")
    total = F.col("before_a") + F.col("after_a") + F.size("grams_a") + F.col("before_b") + F.col("after_b") + F.size("grams_b")
    parts = met.select("a", "b", "need", "fragment", both.alias("both"), apart.alias("apart"), total.alias("total")).where("both > 0 AND apart - 2 * both <= total - 2 * need")
    once = [F.coalesce(F.max(F.when(F.col("fragment") == f, F.col("both"))), F.lit(0)) for f in range(fragments)]
    return common.written(parts.groupBy("a", "b").agg(sum(once[1:], once[0]).alias("both"), F.max("need").alias("need")).where("both >= need").select("a", "b"))


def close_in_block(own: np.ndarray, ids: np.ndarray, n: np.ndarray, of: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """The sets of a block, or of two blocks, that have a partner in another component there which sizes and sketches don't rule out."""
    order = np.argsort(n, kind="stable")
    own, ids, n, of, sketches = own[order], ids[order], n[order], of[order], [sketches[i] for i in order.tolist()]
    cells = min(map(len, sketches))
    flat = np.stack([np.frombuffer(x, np.uint8).reshape(-1, cells).sum(0, dtype=np.int64) for x in sketches])
    full = np.array([255 in x for x in sketches]) | (flat.max(1) > 32_000)  # of these, sketches say nothing
    flat = np.minimum(flat, 32_000).astype(np.uint8 if flat.max() < 256 else np.uint16)
    both, near = own.min() != own.max(), np.zeros(len(ids), bool)
    for i in range(len(ids) - 1):
        j = i + 1 + np.flatnonzero((of[i + 1 : (stop := int(np.searchsorted(n, 100 * n[i] // percent, side="right")))] != of[i]) & ((own[i + 1 : stop] != own[i]) | (not both)))
        if not len(j):
            continue
        apart = (np.maximum(flat[j], flat[i]) - np.minimum(flat[j], flat[i])).sum(1, dtype=np.int64)
        apart[full[j] | full[i]] = 0
        j = j[(100 + percent) * apart <= (100 - percent) * (n[j] + n[i])]
        near[j] = True
        near[i] |= len(j) > 0
    return ids[near]


def _close_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                own, ids, n, of, sketches = zip(*rows, strict=True)
                found = close_in_block(*(np.array(x, np.int64) for x in (own, ids, n, of)), list(sketches), percent)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found)], names=["sid"])

        for batch in batches:
            columns = [common.values(batch, c) for c in ("cluster", "p", "q", "own", "sid", "n", "component", "sketch")]
            for cluster, p, q, *row in zip(*columns, strict=True):
                if (cluster, p, q) != key:
                    yield from done()
                    key, rows = (cluster, p, q), []
                rows.append(row)
        yield from done()

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: the block's n-grams in order, cut into fragments; each fragment's partial counts are added for each pair.

    N-grams of few sets count their pairs one by one, those of many by a product of the fragment's 0-1 array.
    """
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    _, run, size = _runs(flat)
    total = np.zeros(m * m, np.int64)
    light = np.flatnonzero((size[run] > 1) & (size[run] <= LIGHT))
    for low in range(0, len(light), FRAGMENT):
        part = light[low : low + FRAGMENT + LIGHT]  # a run can reach into the next fragment
        mine, group = owner[part], run[part]
        codes = []
        for step in range(1, LIGHT):
            at = np.flatnonzero(group[step:] == group[:-step])
            at = at[at < FRAGMENT]
            if not len(at):
                break
            codes.append(mine[at] * m + mine[at + step])
        if codes:
            total += np.bincount(np.concatenate(codes), minlength=m * m)
    total = total.reshape(m, m)
    total += total.T
    heavy = size[run] > LIGHT
    owner, number = owner[heavy], np.unique(run[heavy], return_inverse=True)[1]
    step = max(1, CELLS // m)
    for low in range(0, int(number.max()) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(number, [low, low + step])
        segment = np.zeros((m, min(step, int(number[b - 1]) - low + 1)), np.float32)
        segment[owner[a:b], number[a:b] - low] = 1
        total += (segment @ segment.T).astype(np.int64)
    return total


def links(ids: list[int], component: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of different components."""
    if len(ids) < 2:
        return []
    sizes, of = np.array([len(s) for s in sets]), np.array(component)
    both = overlaps(sets)
    linked = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (of[:, None] != of[None, :])
    np.fill_diagonal(linked, True)
    label = np.arange(len(ids))
    while True:
        near = np.where(linked, label[None, :], len(ids)).min(1)
        near = np.minimum(near, near[near])
        if (near == label).all():
            break
        label = near
    return [(ids[i], ids[k]) for i, k in enumerate(label.tolist()) if i != k]


def _blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, of, sets = None, [], [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [common.values(batch, c) for c in ("cluster", "p", "q", "component", "sid", "grams")]
            for cluster, p, q, component, sid, data in zip(*columns, strict=True):
                if (cluster, p, q) != key:
                    out += links(ids, of, sets, percent)
                    key, ids, of, sets = (cluster, p, q), [], [], []
                if not ids or sid != ids[-1]:  # rows of a set follow each other
                    ids.append(sid)
                    of.append(component)
                    sets.append(np.frombuffer(data, _U))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=EDGES.names)
        if out := links(ids, of, sets, percent):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=EDGES.names)

    return run


def with_component(df: DataFrame, component: DataFrame, node: str, name: str) -> DataFrame:
    """df with the component of a node's column, the node itself where it has no links."""
    side = component.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return df.join(side, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", node)).drop("_node", "_component")


def in_blocks(members: DataFrame, weight: Column, sets: int, most: int, percent: int) -> DataFrame:
    """members (cluster, component, sid, n, ...) once for each pair (p, q) of blocks of their cluster that they belong to, with own, their block.

    A block has about `sets` sets and `most` of weight. A cluster's largest component needs no comparison within itself, so
    its blocks only meet the rest's. Sets whose sizes are further apart than the threshold can't link: a large cluster's
    blocks go by size, and a block meets those of its own and the neighbouring size only.
    """
    members = members.withColumn("weight", weight.cast("long"))
    blocks = lambda n, size: F.greatest(F.ceil(n / sets), F.ceil(size / most)).cast("long")
    counted = members.groupBy("cluster", "component").agg(F.count("*").alias("sets"), F.sum("weight").alias("size"))
    shape = counted.groupBy("cluster").agg(F.max_by("component", F.struct("sets", "component")).alias("largest"), blocks(F.sum("sets"), F.sum("size")).alias("whole"))
    shape = common.written(shape)
    size = F.floor(F.log("n") / -math.log(percent / 100)) if percent < 100 else F.col("n")
    members = members.join(shape, "cluster").withColumn("bin", F.when(F.col("whole") == 1, F.lit(0)).otherwise(size).cast("long"))
    members = common.written(members.withColumn("main", ((F.col("component") == F.col("largest")) & (F.col("whole") > 1)).cast("long")).drop("largest", "whole"))
    of = lambda main: blocks(F.count_if(F.col("main") == main), F.coalesce(F.sum(F.when(F.col("main") == main, F.col("weight"))), F.lit(0)))
    parts = members.groupBy("cluster", "bin").agg(of(0).alias("rest"), of(1).alias("of_main"))
    order = Window.partitionBy("cluster").orderBy("bin")  # a row for each size
    beside = lambda f, at, c: F.when(f("bin").over(order) == F.col("bin") + at, f(c).over(order)).otherwise(0).cast("long")
    near = [beside(f, at, c).alias(f"{c}_{name}") for c in ("rest", "of_main") for f, at, name in ((F.lead, 1, "above"), (F.lag, -1, "below"))]
    parts = common.written(parts.select("cluster", "bin", "rest", "of_main", *near))
    number = lambda bin_, main, k: (bin_ * 2 + main) * (1 << 32) + k
    block = lambda bin_, main, n: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long"))), lambda k: number(bin_, main, k))).otherwise(F.array().cast("array<bigint>"))
    meets = lambda c, main: [block(F.col("bin") + at, main, F.col(c + x)) for at, x in ((0, ""), (1, "_above"), (-1, "_below"))]
    others = F.when(F.col("main") == 1, F.concat(*meets("rest", 0))).otherwise(F.concat(*meets("rest", 0), *meets("of_main", 1)))
    own = number(F.col("bin"), F.col("main"), F.pmod(F.xxhash64("sid"), F.when(F.col("main") == 1, F.col("of_main")).otherwise(F.col("rest"))))
    keep = [c for c in members.columns if c not in ("weight", "bin", "main")]
    found = members.join(parts, ["cluster", "bin"]).select(*keep, own.alias("own"), others.alias("others"))
    return found.where(F.size("others") > 0)


def _dealt(found: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of in_blocks() for each of their pairs of blocks, one pair after the other in one partition."""
    n = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = found.withColumn("other", F.explode("others"))
    found = found.select("cluster", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), *columns)
    return found.repartition(n, "cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "sid")


def star_members(stars: DataFrame, component: DataFrame) -> DataFrame | None:
    """(sid, cluster) of the ends of stars whose component hangs together with others by star edges, which is a cluster; None without such sets."""
    ends = with_component(with_component(stars, component, "a", "ca"), component, "b", "cb")
    cross = common.written(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if cross.isEmpty():
        return None
    cluster = common.written(components(cross)).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    nodes = stars.select(F.col("a").alias("sid")).union(stars.select(F.col("b").alias("sid"))).distinct()
    return common.written(with_component(nodes, component, "sid", "component").join(cluster, "component").select("sid", "cluster"))


def stars_left(documents: DataFrame, sizes: DataFrame, stars: DataFrame, component: DataFrame, width: int, percent: int, members: DataFrame | None = None) -> DataFrame | None:
    """Links between sets of stars that the links so far leave in different components; None without such sets.

    members: star_members() of these or of fewer links. A cluster's sets' sketches meet in blocks, which tell the sets that could have
    a link at all. The n-grams of these meet in blocks as well; a task counts a block's overlaps fragment by
    fragment, and only a spanning forest of the links leaves it.
    """
    if members is None and (members := star_members(stars, component)) is None:
        return None
    members = common.written(with_component(members, component, "sid", "component").join(sizes, "sid"))
    sketched = in_blocks(members.select("cluster", "component", "sid", "n", "sketch"), F.octet_length("sketch"), SKETCHED_SETS, SKETCHED_BYTES, percent)
    near = _dealt(sketched, ["own", "sid", "n", "component", "sketch"]).mapInArrow(common.released(_close_blocks(percent)), "sid long").distinct()
    near = common.written(near)
    if near.isEmpty():
        return None
    chosen = members.drop("sketch", "registers").join(common.sent(near, HASHED_ROWS), "sid", "left_semi")
    met = common.written(in_blocks(chosen, F.col("n"), BLOCK_SETS, BLOCK_GRAMS, percent))
    keep = ["cluster", "component", "sid", "own", "others"]
    schema = T.StructType([*(met.schema[c] for c in keep), T.StructField("grams", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for *row, text in zip(*(common.values(batch, x) for x in keep), common.utf8(batch, "text"), strict=True):
            yield (*row, grams(text, width).tobytes())

    found = _texts_of(documents, met).select(*keep, "text").mapInArrow(common.arrow_rows(schema, run), schema)
    return common.written(_dealt(found, ["component", "sid", "grams"]).mapInArrow(common.released(_blocks(percent)), EDGES))


Candidates = Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame]]


def set_links(documents: DataFrame, first: DataFrame, width: int, percent: int, fragments: int = FRAGMENTS, close: Candidates = close_pairs) -> DataFrame:
    """Edges (a, b) between sids that connect exactly what the links between candidate sets connect."""
    sizes = common.written(first.withColumnRenamed("n_shingles", "n").drop("set_hash", "signatures"))
    near, stars = close(candidate_pairs(first), sizes, percent)
    edges, component, members = nearest_first(near, candidate_segments(documents, sizes, near, width, fragments), stars, fragments)
    left = None if members is None else stars_left(documents, sizes, stars, component, width, percent, members)
    return edges if left is None else edges.union(left)


def candidate_segments(documents: DataFrame, sizes: DataFrame, pairs: DataFrame, width: int, fragments: int) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    return segments_of(documents, common.written(sizes.select("sid", "doc_id", "text_key").join(nodes, "sid")), width, fragments)


def nearest_first(near: DataFrame, segments: DataFrame, stars: DataFrame, fragments: int = FRAGMENTS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Edges (a, b) that connect what the links among candidates (a, b, need, far) connect, but for pairs within a star cluster; components by the most
    of these edges, and star_members().

    Each set's nearest candidate is counted first: what these links connect needs no further count. What is left within a star
    cluster meets in blocks anyway (stars_left()), so it isn't counted pair by pair, as a group of many near copies has very many such pairs. While many
    candidates are left between components, each component's nearest one is next; what is left then is counted whole.
    """
    left, edges, members = near.select("a", "b", "far", "need", F.col("a").alias("ca"), F.col("b").alias("cb")), None, None
    for turn in range(ROUNDS):
        best = F.min(F.struct("far", "a", "b", "need")).alias("to")
        nearest = left.withColumn("x", F.explode(F.array("ca", "cb"))).groupBy("x").agg(best)
        nearest = common.written(nearest.select("to.a", "to.b", "to.need").distinct())
        found = linked(nearest, segments, fragments)
        edges = found if edges is None else common.written(edges.union(found))
        now = common.written(components(edges))
        rest = left.join(nearest.select("a", "b"), ["a", "b"], "left_anti").drop("ca", "cb")
        rest = with_component(with_component(rest, now, "a", "ca"), now, "b", "cb").where("ca <> cb")
        if turn == 0 and not stars.isEmpty() and (members := star_members(stars, now)) is not None:
            side = lambda x: members.select(F.col("sid").alias(x), F.col("cluster").alias(f"_{x}"))
            rest = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(_a <> _b, true)").select("a", "b", "far", "need", "ca", "cb")
        left = common.written(rest)
        if left.count() <= MANY:
            break
    return edges.union(linked(left.select("a", "b", "need"), segments, fragments)), now, members


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (least doc_id reachable by links) and group_id (null without words) of each row of documents.

    Links are pairs with 100 * intersection >= percent * union of their n-gram sets.
    """
    return classes(documents, sets_of(documents, width, percent), width, percent)


def classes(documents: DataFrame, sets: DataFrame, width: int, percent: int, close: Candidates = close_pairs) -> DataFrame:
    """near_duplicates() from a table of SETS (and maybe registers), candidates being those that close gives."""
    first, again = distinct_sets(sets)
    component = common.written(components(set_links(documents, first, width, percent, close=close)))
    rows = sets.select("row_id", "doc_id", "text_key", "n_shingles", "set_hash").join(common.sent(again, HASHED_ROWS), "set_hash", "left")
    rows = rows.withColumn("sid", F.when(F.col("set_hash").isNotNull(), F.coalesce("sid", "row_id"))).drop("row_id", "set_hash")
    rows = common.written(with_component(rows, component, "sid", "group_id").drop("sid"))
    least = rows.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    least = common.written(least)
    return rows.join(common.sent(least, HASHED_ROWS), "group_id", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group_id")


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each component: the least doc_id (null last), then the least text_key. Rows without words all stay."""
    found = common.written(near_duplicates(documents, width, percent).select("doc_id", "text_key", "group_id").where("group_id IS NOT NULL"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    groups = common.written(found.groupBy("group_id").agg(F.min(order).alias("best"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    marked = found.join(F.broadcast(groups) if common.small_enough(groups, HASHED_ROWS) else groups, "group_id")
    marked = common.written(marked.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), best.alias("_stays")).distinct())
    keyed = documents.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(common.sent(marked, HASHED_ROWS), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    alone = joined.where("_stays IS NULL").select(*documents.columns)
    again = joined.where("_stays").dropDuplicates(["_id", "_key"]).select(*documents.columns)
    return alone.union(again)
