"""Exact removal of repeated byte windows: suffixes told apart to a limited depth by hashes of growing parts of them.

This stands in for a depth-limited radix sort by bytes, whose passes would shuffle too much (see the README). Only the first `window` bytes
of a suffix count; suffixes equal after the last pass are exactly the repeated windows. A pass splits groups by one more digit, a hash, and drops what stands alone:

1. The digit is the anchor, a k-gram of least hash within the window. Equal windows have equal anchors at equal
   places, and some sixty neighbouring suffixes share one, so this pass sorts anchors instead of suffixes.
   A window whose anchor's gram occurs once in the corpus is not repeated.
2. The digit is the anchor's whole surroundings. Where these occur twice, all windows with that anchor are repeated.
3. Suffixes that are still open, those at the edges of repeated passages, are sorted by their whole window.

The digits are not single bytes: a pass over bytes would rewrite every suffix of the corpus 200 times, while most
suffixes differ from all others within the first two digits here.

Rows of the same digit meet by a hash partitioning and are told apart by a sort within partitions, in a stream that
holds one row. Each part of the input sends one witness of a gram that it has seen twice and one row of each anchor with
equal surroundings; the others of these are settled and are dealt out evenly, so that a digit sends few rows for each part,
however common it is. Where an anchor's surroundings differ, one text of each surroundings takes its settled windows along
into pass 3, for others to meet.

What settles a window is compared by 96 bits, a hash of 64 and an independent one of 32: in pass 2 of the anchor's
surroundings, in pass 3 of the window. Pass 1, whose digit has 64 bits, only opens windows for the others. Texts are
identified by 96 bits when the results go back to them. The 32 bits share a long with another field, as they are shuffled.

Defined cases: a null text is empty; texts shorter than the window keep all bytes; equal texts of the window's
length or more are removed whole, each of them. Repeated rows repeat each other. Very long texts are searched whole, in parts that overlap.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import common

WINDOW, GRAM = 200, 80
BUFFER = 1 << 19  # bytes that are hashed at once
KEY_ROWS = 1_000_000  # ids of texts up to which these are sent to all tasks

DIGITS = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType()), T.StructField("x", T.LongType()), T.StructField("twice", T.BooleanType()), T.StructField("whole", T.BooleanType()), T.StructField("shown", T.BooleanType()), T.StructField("settled", T.BooleanType()), T.StructField("key", T.LongType()), T.StructField("pos", T.LongType())])
FLAGS = T.StructType([T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()), T.StructField("code", T.LongType())])
STATE = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("sure", T.ArrayType(T.LongType())), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.LongType()))])
OPEN = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("start", T.LongType())])
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BYTES = (np.random.default_rng(20240229).integers(0, 1 << 63, 256).astype(_U) << _U(1)) | _U(1)
_BASE2 = _U(0xD1B54A32D192ED03)
_BYTES2 = (np.random.default_rng(20240301).integers(0, 1 << 63, 256).astype(_U) << _U(1)) | _U(1)
_MOST = _U(2**64 - 1)
_HALF, _LOW = _U(32), _U(2**32 - 1)
np.seterr(over="ignore")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _inverse(b: np.uint64) -> np.uint64:
    x = b
    for _ in range(6):
        x = x * (_U(2) - b * x)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.ones(max(n, 2 * BUFFER), _U)
        m = 1
        while m < len(held):
            k = min(m, len(held) - m)
            held[m : m + k] = held[:k] * (held[m - 1] * base)
            m += k
        _powers[int(base)] = held
    return held[:n]


class Prefix:
    """Hashes of any stretch of a buffer."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTES, base: np.uint64 = _BASE):
        n = len(data)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(table[data] * powers(base, n), out=self.sums[1:])
        self.back = powers(_inverse(base), n + 1)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.back[low]

    def all(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length]


def _sliding(x: np.ndarray, width: int, best: np.ufunc, fill: np.uint64) -> np.ndarray:
    """best of x[i : i + width] for each i."""
    n = len(x)
    rows = np.full((-(-n // width) + 1) * width, fill, _U)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    head = best.accumulate(rows, axis=1).ravel()
    tail = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(tail[:n], head[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], window: int, gram: int, second: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, position, hash of the gram, hash of the surroundings, if asked a second one of these) of all anchors, some texts at a time.

    Long texts go through in pieces that overlap by more than any anchor looks.
    """
    margin = 2 * window
    held: list[tuple[int, int, int, int, bytes]] = []  # text, first byte, core from, core to, bytes
    size = 0
    for i, text in enumerate(texts):
        if len(text) < window:
            continue
        for core in range(0, len(text), BUFFER):
            stop = min(len(text), core + BUFFER)
            low = max(0, core - margin)
            held.append((i, low, core, stop, text[low : stop + margin]))
            size += len(held[-1][4])
            if size >= BUFFER:
                yield _anchors(held, texts, window, gram, second)
                held, size = [], 0
    if held:
        yield _anchors(held, texts, window, gram, second)


def _anchors(held: list[tuple[int, int, int, int, bytes]], texts: list[bytes], window: int, gram: int, second: bool) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(x[4] for x in held), np.uint8)
    sizes = np.array([len(x[4]) for x in held])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    n, width = len(data), window - gram + 1
    prefix = Prefix(data)
    h = np.full(n, _MOST)
    h[: n - gram + 1] = _mix(prefix.all(gram)) | _U(1)
    left = np.repeat(edges[1:], sizes) - np.arange(n)
    least = _sliding(h, width, np.minimum, _MOST)
    least[left < window] = 0  # no window starts there
    chosen = _sliding(np.concatenate([np.zeros(width - 1, _U), least]), width, np.maximum, _U(0))[:n]
    at = np.flatnonzero((chosen == h) & (left >= gram))
    piece = np.searchsorted(edges, at, side="right") - 1
    first = np.array([x[1] for x in held]) - edges[:-1]
    pos = at + first[piece]
    core = np.array([(x[2], x[3]) for x in held])
    inside = (pos >= core[piece, 0]) & (pos < core[piece, 1])
    at, piece, pos = at[inside], piece[inside], pos[inside]
    text = np.array([x[0] for x in held])[piece]
    low = np.maximum(pos - (window - gram), 0)
    high = np.minimum(pos + window, np.array([len(texts[x[0]]) for x in held])[piece])
    shift = at - pos
    sizes = _mix(((pos - low) << 32 | (high - pos)).astype(_U))
    around = [prefix, Prefix(data, _BYTES2, _BASE2)] if second else [prefix]
    return text, pos, h[at], *(_mix(x.of(low + shift, high + shift) + sizes) for x in around)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """For each row of sorted columns, whether it differs from the one before it; the first does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def _counts(*columns: np.ndarray) -> np.ndarray:
    """For each row, how often its values occur."""
    order = np.lexsort(columns)
    group = np.cumsum(_changes(*(x[order] for x in columns))) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def digits(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """The anchors of all texts as rows of DIGITS; witnesses (twice is false for them) come on top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Of texts that are equal within the batch, one stands for all.
            keys = np.array([common.values(batch, "key"), common.values(batch, "key2")], np.int64).T
            keys, first, copies = np.unique(keys, axis=0, return_index=True, return_counts=True)
            texts = [x for x in common.utf8(batch.take(pa.array(first)), "text")]
            found = list(anchors(texts, window, gram, second=True))
            if not found:
                continue
            text, pos, h, c, c2 = (np.concatenate(x) for x in zip(*found, strict=True))
            c2 &= _LOW
            many = copies[text] > 1
            by_h, by_c = _counts(h), _counts(h, c, c2)
            whole, twice = (by_c > 1) | many, (by_h > 1) | many
            # Of surroundings that differ within the batch, the first text of each shows its windows.
            shown = np.zeros(len(h), bool)
            rows = np.lexsort((c2, c, h))
            new = _changes(h[rows], c[rows], c2[rows])
            shown[rows[new]] = by_h[rows[new]] > by_c[rows[new]]
            settled = np.ones(len(h), bool)  # but for the first of each surroundings
            settled[rows[new]] = False
            rows = np.flatnonzero(twice)
            witness = rows[np.unique(h[rows], return_index=True)[1]]
            pick = np.concatenate([np.arange(len(h)), witness])
            none = np.arange(len(pick)) >= len(h)
            columns = [
                pa.array(h[pick].view(np.int64)),
                pa.array(c[pick].view(np.int64)),
                pa.array((c2[pick] << _HALF | keys[text[pick], 1].view(_U)).view(np.int64)),
                pa.array(twice[pick] & ~none),
                pa.array(whole[pick]),
                pa.array(shown[pick]),
                pa.array(settled[pick] & ~none),
                pa.array(keys[text[pick], 0]),
                pa.array(pos[pick], pa.int64()),
            ]
            out = pa.RecordBatch.from_arrays(columns, names=DIGITS.names)
            for at in range(0, len(pick), 50_000):
                yield out.slice(at, 50_000)

    common.ship(documents.sparkSession)
    return documents.mapInArrow(run, DIGITS)


def _runs(columns: list[str], judge, names: list[str]):
    """A stream over rows sorted by `columns`. judge gets rows and, for each leading part of columns, whether the row before and the row after have the same values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        before = [False] * len(columns)  # whether the held row equals the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            same = []
            equal = np.ones(whole.num_rows - 1, bool)
            for name in columns:
                x = whole.column(whole.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                equal = equal & (x[1:] == x[:-1])
                same.append(equal)
            if whole.num_rows > 1:
                yield judge(whole.slice(0, whole.num_rows - 1), [(np.concatenate([[b], s[:-1]]), s) for b, s in zip(before, same, strict=True)])
                before = [bool(s[-1]) for s in same]
            held = whole.slice(whole.num_rows - 1, 1)
        if held is not None:
            yield judge(held, [(np.array([b]), np.array([False])) for b in before])

    return run


def _flag(batch: pa.RecordBatch, near: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    flag = lambda c: get(c).to_numpy(zero_copy_only=False)
    _, (h_before, h_after), _, (c_before, c_after) = near
    twice = h_before | h_after | flag("twice") | flag("whole")
    whole = c_before | c_after | flag("whole")
    shown = (h_before & ~c_before) | (h_after & ~c_after) | flag("shown")
    rows = np.flatnonzero(twice)
    code = 4 * get("pos").to_numpy()[rows] + 2 * shown[rows] + whole[rows]
    return pa.RecordBatch.from_arrays([get("key").take(pa.array(rows)), get("key2").take(pa.array(rows)), pa.array(code, pa.int64())], names=FLAGS.names)


def _answer(batch: pa.RecordBatch, near: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    rows = pa.array(np.flatnonzero((near[1][0] | near[1][1]) & (get("start").to_numpy() >= 0)))
    return pa.RecordBatch.from_arrays([get("row_id").take(rows), get("start").take(rows)], names=OPEN.names)


def _high(name: str) -> Column:
    return F.shiftright(name, 32)


def _low(name: str) -> Column:
    return F.col(name).bitwiseAND(F.lit(2**32 - 1))


def flags(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """For each text's key the codes of its repeated anchors: 4 times the position, 2 more if it shows its windows, 1 more where pass 2 settled it."""
    n = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = digits(documents, window, gram)
    even = F.when(F.col("settled"), F.xxhash64("key", "pos")).when(F.col("twice"), F.xxhash64("h", "c")).otherwise(F.col("h"))
    dealt = rows.repartition(n, even).sortWithinPartitions("twice", "h", "c", "x").withColumns({"c2": _high("x"), "key2": _low("x")})
    # Rows that are known to be repeated and their witnesses stay apart: a row never meets its own witness.
    return dealt.mapInArrow(_runs(["twice", "h", "c", "c2"], _flag, FLAGS.names), FLAGS).groupBy("key", "key2").agg(F.collect_set("code").alias("codes"))


def stretches(mask: np.ndarray) -> list[int]:
    """First and end of each run of True, flat."""
    step = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return step.tolist()


def window_hashes(text: bytes, starts: np.ndarray, window: int) -> np.ndarray:
    """Two hashes of each window that starts at one of the ascending starts."""
    out = np.empty((2, len(starts)), _U)
    for low in range(0, len(text), BUFFER):
        a, b = np.searchsorted(starts, [low, low + BUFFER])
        if a < b:
            data = np.frombuffer(text, np.uint8)[low : low + BUFFER + window]
            at = starts[a:b] - low
            for row, prefix in zip(out, (Prefix(data, _BYTES, _BASE), Prefix(data, _BYTES2, _BASE2)), strict=True):
                row[a:b] = _mix(prefix.of(at, at + window))
    return out


def _least(places: np.ndarray, hashes: np.ndarray, keep: np.ndarray | None, n: int, width: int) -> np.ndarray:
    """For each of n windows the least hash of the anchors in it, of those at the places keep if given."""
    if not n:
        return np.zeros(0, _U)
    dense = np.full(n + width - 1, _MOST)
    on = slice(None) if keep is None else np.isin(places, keep)
    dense[places[on]] = hashes[on]
    return _sliding(dense, width, np.minimum, _MOST)[:n]


def settle(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """From texts with the codes of their anchors: the windows surely repeated, and of the open ones a hash, and a second one over the start plus 1 (0: a witness)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = list(common.utf8(part, "text"))
                codes = part.column(part.schema.get_field_index("codes"))
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)), *(x[:3] for x in anchors(texts, window, gram))]
                text, pos, grams = (np.concatenate(x) for x in zip(*found, strict=True))
                edges = np.searchsorted(text, np.arange(len(texts) + 1))
                sure, opened, hashes = [], [], []
                for i, data in enumerate(texts):
                    own, h, n = pos[edges[i] : edges[i + 1]], grams[edges[i] : edges[i + 1]], max(0, len(data) - window + 1)
                    code = codes[i].values.to_numpy() if n and codes[i].is_valid else np.zeros(0, np.int64)
                    marks = np.zeros(n + 1, np.int32)
                    whole = np.unique(code[code & 1 > 0] // 4)
                    np.add.at(marks, np.maximum(whole - (window - gram), 0), 1)
                    np.add.at(marks, np.minimum(whole, n - 1) + 1, -1)
                    yes = np.cumsum(marks)[:-1] > 0
                    # A window's anchor is that of least hash in it; is it repeated, does it show its windows?
                    least, *parts = (_least(own, h, keep, n, window - gram + 1) for keep in (None, code // 4, code[code & 2 > 0] // 4))
                    repeated, show = (x == least for x in parts)
                    sure.append(yes)
                    opened.append(np.flatnonzero(repeated & (~yes | show)))
                    hashes.append(window_hashes(data, opened[-1], window))
                # What is known to be repeated, or occurs twice in the part, needs no answer; one witness of it goes out.
                flat, flat2 = np.concatenate(hashes, axis=1)
                flat2 &= _LOW
                known = np.concatenate([s[o] for s, o in zip(sure, opened, strict=True)])
                again = known | (_counts(flat2, flat) > 1)
                first = np.zeros(len(flat), bool)
                where = np.flatnonzero(again)
                where = where[np.lexsort((flat2[where], flat[where]))]
                first[where[_changes(flat[where], flat2[where])]] = True
                ends = np.concatenate([[0], np.cumsum([len(x) for x in opened])])
                rows = []
                for i in range(len(texts)):
                    own = slice(ends[i], ends[i + 1])
                    sure[i][opened[i][again[own]]] = True
                    ask = ~again[own] | first[own]
                    rows.append((number + i, stretches(sure[i]), flat[own][ask].view(np.int64), (flat2[own] << _HALF | np.where(again[own], 0, opened[i] + 1).astype(_U))[ask].view(np.int64)))
                number += len(texts)
                lists = lambda k, rows=rows: pa.array([r[k] for r in rows], pa.list_(pa.int64()))
                ids = part.column(part.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), ids, pa.array(texts, pa.binary()), lists(1), lists(2), lists(3)], names=STATE.names)

    return documents.mapInArrow(run, STATE)


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every text: bytes of windows that occur again anywhere go."""
    gram = gram or max(1, min(GRAM, window * 2 // 5))
    spark = documents.sparkSession
    common.ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text")).withColumn("key2", F.shiftrightunsigned(F.xxhash64(F.lit("again"), "text"), 32))
    flagged = common.written(flags(docs.select("text", "key", "key2"), window, gram))
    text_id = ["key", "key2"]
    keys = flagged.select(*text_id)
    keys = F.broadcast(keys) if common.small_enough(keys, KEY_ROWS) else keys
    touched = docs.join(keys, text_id, "left_semi").join(flagged, text_id).select("doc_id", "text", "codes")
    state = common.written(settle(touched, window, gram))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = state.select("row_id", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("row_id", F.col("x.hashes").alias("h"), F.col("x.places").alias("x"))
    met = asked.repartition(n, "h").sortWithinPartitions("h", "x").select("row_id", "h", _high("x").alias("h2"), (_low("x") - 1).alias("start"))
    answers = met.mapInArrow(_runs(["h", "h2"], _answer, OPEN.names), OPEN)
    # Windows of one stretch overlap, so the first and the last cover all between them.
    answers = answers.groupBy("row_id", F.floor(F.col("start") / max(1, window // 2)).alias("piece")).agg(F.min("start").alias("a"), F.max("start").alias("b"))
    answers = common.written(answers.groupBy("row_id").agg(F.flatten(F.collect_list(F.array("a", F.col("b") + 1))).alias("more")))
    more = common.sent(answers, KEY_ROWS // 10)
    cut = state.drop("hashes", "places").join(more, "row_id", "left")

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, data, sure, more in zip(common.values(batch, "doc_id"), common.utf8(batch, "text"), common.values(batch, "sure"), common.values(batch, "more"), strict=True):
            ends = np.array((sure or []) + (more or []), np.int64).reshape(-1, 2)
            marks = np.zeros(len(data) + 1, np.int32)
            np.add.at(marks, ends[:, 0], 1)
            np.add.at(marks, ends[:, 1] - 1 + window, -1)
            gone = np.cumsum(marks)[:-1] > 0
            yield doc_id, len(data), int(gone.sum()), len(stretches(gone)) // 2, np.frombuffer(data, np.uint8)[~gone].tobytes()

    done = cut.select("doc_id", "text", "sure", "more").mapInArrow(common.arrow_rows(RESULT, run), RESULT)
    rest = docs.join(keys, text_id, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.encode("text", "UTF-8").alias("kept"))
    return done.union(rest)
