"""Near duplicates by SetSketch registers.

An element of a set is a stream of events, as of a Poisson process: each falls upon one of REGISTERS registers, and a
register keeps its earliest time. So its time is the least of independent exponential values, one for each element.
Times after 1 are cut off (an empty register is 0); the others are kept on an exponential scale of base BASE, in 16
bits. Registers of two sets merge by the larger value; they are equal about as often as the sets' Jaccard similarity.

Candidates: registers are banded, a band's values being a signature. A candidate shares more signatures than a slack,
below which linked sets stay with a chance under MISSED (slack(); 7 of 85 at a similarity of 0.85). Sizes are known, so the similarity of a
candidate is the one under which the numbers of larger, smaller and equal registers are likeliest; a candidate
more than SIGMAS standard errors below the threshold goes. Verification: exact overlaps of the whole sets decide (see
ngram_join.linked), as they do for signatures of very many sets, whose sets hang on one of them and meet in blocks.

Defined cases: as in ngram_join. Sets so small that only equal ones can link have no registers. Elements of very long texts
go into the registers part by part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common
from tideframe.llm.ngram_join import CLOSE, SETS, asked_pairs, classes, grams, mix, sketch

REGISTERS = 512
BASE = 1.001
BAND = 6  # registers of a signature
MISSED = 1e-9  # chance that a pair at the threshold shares too few signatures
SIGMAS = 6
PART, ELEMENTS = 256, 1 << 19  # sets, and elements of sets, whose events are drawn together
STEPS = 40  # halvings of the interval of similarities

REGISTERED = T.StructType([*SETS.fields, T.StructField("registers", T.BinaryType())])

_U = np.uint64


def _events(times: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    """Let the elements' events fall upon the rows of times that own them, until none can make a register earlier."""
    m = times.shape[1]
    flat, at = times.reshape(-1), np.zeros(len(elements))
    limit = np.minimum(times.max(1), 1.0)
    step = 0
    with np.errstate(over="ignore"):
        while len(elements):
            step += 1
            draw = mix(elements + _U(step) * _U(0x9E3779B97F4A7C15))
            at = at - np.log(((draw >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / m
            alive = at <= limit[owner]
            elements, owner, at, draw = elements[alive], owner[alive], at[alive], draw[alive]
            np.minimum.at(flat, owner * m + (draw & _U(m - 1)).astype(np.int64), at)
            if step < 8 or step % 8 == 0:
                limit = np.minimum(times.max(1), 1.0)


def registers(sets: list[np.ndarray], count: int = REGISTERS) -> np.ndarray:
    """A row of registers for each set of 64-bit hashes; count is a power of two."""
    times = np.full((len(sets), count), np.inf)
    low = 0
    while low < len(sets):
        high, held = low, 0
        while high < len(sets) and (high == low or held + len(sets[high]) <= ELEMENTS):
            held += len(sets[high])
            high += 1
        flat = mix(np.concatenate(sets[low:high]) ^ _U(0xD6E8FEB86659FD93))
        owner = np.repeat(np.arange(high - low), [len(s) for s in sets[low:high]])
        for at in range(0, len(flat), ELEMENTS):
            _events(times[low:high], flat[at : at + ELEMENTS], owner[at : at + ELEMENTS])
        low = high
    kept = times <= 1.0
    scale = np.floor(1.0 - np.log(np.where(kept, np.maximum(times, 1e-28), 1.0)) / np.log(BASE))
    return np.where(kept, np.minimum(scale, 65535), 0).astype(np.uint16)


def signatures(rows: np.ndarray) -> np.ndarray:
    """A 64-bit signature for each band of each row of registers."""
    bands = rows.shape[1] // BAND
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(bands, dtype=_U), (len(rows), bands))
        parts = rows[:, : bands * BAND].reshape(len(rows), bands, BAND).astype(_U)
        for i in range(BAND):
            out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, i] + _U(1))
    return out.view(np.int64)


def similarity(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest Jaccard similarity, and its standard error, of sets of n_a and n_b elements.

    larger, smaller and equal are the numbers of registers in which a's value is above, below or the same as b's. A register
    of a is above b's by at least one step of the scale with a probability that depends on the share of elements that only
    a has; the logarithm of the likelihood is concave, so its slope is halved in.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    c = (BASE - 1) / BASE

    def chance(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip(x, 0, 1 - 1e-12)
        return np.maximum(-np.log1p(-x * c) / np.log(BASE), 1e-12), c / (1 - x * c) / np.log(BASE)

    def slope(j: np.ndarray) -> np.ndarray:
        (p, dp), (q, dq) = chance(u - v * j), chance(v - u * j)
        return -larger * dp * v / p - smaller * dq * u / q + equal * (dp * v + dq * u) / np.maximum(1 - p - q, 1e-12)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(STEPS):
        middle = (low + high) / 2
        up = slope(middle) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2, error(u, v, (low + high) / 2, larger + smaller + equal)


def error(u: np.ndarray, v: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The standard error of similarity() where it is j, from Fisher's information; BASE is close enough to 1 for its limit."""
    only_a, only_b = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    return 1 / np.sqrt(m * (v**2 / only_a + u**2 / only_b + 1 / np.maximum(1 - only_a - only_b, 1e-9)))


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs of rows of registers may reach the threshold, and their likeliest similarities.

    The error is that of a pair at the threshold (or as similar as its sizes allow), so what is dropped is far below it.
    """
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    found, _ = similarity(larger, smaller, a.shape[1] - larger - smaller, n_a, n_b)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    edge = np.minimum(percent / 100, np.minimum(u / v, v / u))
    return found >= edge - SIGMAS * np.maximum(error(u, v, edge, np.full(len(u), a.shape[1])), 1 / a.shape[1]), found


def slack(percent: int) -> int:
    """The largest number of signatures that a pair at the threshold shares, or fewer, with a chance of at most MISSED; -1: none is that safe."""
    bands, same = REGISTERS // BAND, (percent / 100) ** BAND
    total, most = 0.0, -1
    for k in range(bands):
        total += math.comb(bands, k) * same**k * (1 - same) ** (bands - k)
        if total > MISSED:
            break
        most = k
    return most


def sets_of(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """A row of REGISTERED for each row, as a written table: the one pass over all texts.

    set_hash is null without words; registers and signatures stand in the first row of a set within a part of the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                sets = [grams(text, width) for text in common.utf8(part, "text")]
                hashes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                places: dict[bytes, int] = {}
                for i, (s, own) in enumerate(zip(sets, hashes, strict=True)):
                    if own is not None and percent * (len(s) + 1) <= 100 * len(s):
                        places.setdefault(own, i)
                chosen = list(places.values())
                rows = registers([sets[i] for i in chosen]) if chosen else np.zeros((0, REGISTERS), np.uint16)
                banded = signatures(rows)
                kept, sent = [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(chosen):
                    kept[i], sent[i] = rows[k].tobytes(), banded[k]
                ids = pa.array(np.arange(number, number + part.num_rows))
                number += part.num_rows
                columns = [ids, part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sent, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=REGISTERED.names)

    common.ship(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return common.written(docs.mapInArrow(common.released(run), REGISTERED))


def likely_pairs(pairs: DataFrame, sizes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b, need, far) that share enough signatures and are likely to reach the threshold, and the star edges (a, b)."""
    asked, stars = asked_pairs(pairs, sizes, percent, F.lit(max(0, slack(percent))), "registers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                a, b = (np.frombuffer(b"".join(common.values(batch, c)), np.uint16).reshape(len(n_a), -1) for c in ("s_a", "s_b"))
                may, found = likely(a, b, n_a, n_b, percent)
                keep, need = pa.array(may), -(-percent * (n_a + n_b) // (100 + percent))
                far = (1000 * (1 - found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("a", "b")), pa.array(need).filter(keep), pa.array(far).filter(keep)], names=CLOSE.names)

    return common.written(asked.mapInArrow(common.released(run), CLOSE)), stars


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (least doc_id reachable by links) and group_id (null without words) of each row of documents.

    Links are pairs with 100 * intersection >= percent * union of their n-gram sets, found by registers and verified. At thresholds
    below 78 a linked pair shares no signature with a chance above MISSED, so they are refused.
    """
    if slack(percent) < 0:
        raise ValueError(f"signatures of {BAND} registers don't find pairs of {percent} %")
    return classes(documents, sets_of(documents, width, percent), width, percent, likely_pairs)
