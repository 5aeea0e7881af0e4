"""Token ids in files: static range asymmetric numeral system over interleaved lanes.

One frequency table, counted over all ids and scaled to a power of two, serves all files. A file is a run of blocks
that are decoded on their own: LANES states take turns (id t belongs to lane t % LANES), so that numpy steps all lanes
at once. Checkpoints (states and word offset) cut a block into stretches, each with the CRC-32 of its ids; a reader
starts at the checkpoint before the first document that it wants, stops at the one after its last, and checks every
stretch that it decodes. Documents lie in ascending doc_id order over all files, each ended by an end id. Every UNIT
blocks have a directory of their own with ids and lengths of the documents that begin there, so a reading task looks at the
file's short list of blocks and at one directory only.

Defined cases: a null text is empty and gives the end id alone; null doc_ids come first; equal doc_ids follow each
other in the order of their ids' hash. Very long documents span blocks. An empty table gives no file and no row. Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm import chunks, common

MAGIC = b"TFANS2\0\0"
LANES, ROWS, CHECK_ROWS = 1024, 512, 128  # of a block; rows between checkpoints
BLOCK, STRETCH = LANES * ROWS, LANES * CHECK_ROWS
BITS = 20  # the frequencies add up to 2 ** BITS
LOW = np.uint64(1 << 31)
UNIT = 6  # blocks that a reading task takes

TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])
MANIFEST = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("documents", T.LongType()),
        T.StructField("blocks", T.LongType()),
    ]
)
READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class Table:
    """Frequencies of all ids, scaled: every id that occurs has at least 1, the sum is 2 ** BITS."""

    def __init__(self, counts: np.ndarray):
        self.freq = self.scaled(np.asarray(counts, np.int64))
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.freq64 = self.freq.astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        total, goal = int(counts.sum()), 1 << BITS
        used = np.flatnonzero(counts)
        if len(used) > goal:
            raise ValueError("more different ids than the table has slots")
        out = np.zeros(len(counts), np.int64)
        if total == 0:
            return out
        out[used] = np.maximum(1, counts[used] * goal // total)
        order = used[np.argsort(-out[used], kind="stable")]
        short = goal - int(out.sum())
        if short > 0:
            out[order[0]] += short
        i = 0
        while short < 0:  # too many were raised to 1: take from the largest in turn
            take = min(-short, max(0, int(out[order[i]]) - max(1, int(out[order[i]]) * 7 // 8)))
            out[order[i]] -= take
            short += take
            i = (i + 1) % len(order)
        return out

    def encode(self, ids: np.ndarray) -> bytes:
        """A block: header, states, checkpoints, the CRC-32 of each stretch's ids, words."""
        n = len(ids)
        rows = -(-n // LANES)
        freq, start = self.freq64[ids], self.start[ids]
        state = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, int, bytes]] = []
        n_words = 0
        shift, half = np.uint64(BITS), np.uint64(32)
        limit = np.uint64((1 << 31) >> BITS << 32)
        for r in range(rows - 1, -1, -1):
            a, b = r * LANES, min(n, (r + 1) * LANES)
            f, s, x = freq[a:b], start[a:b], state[: b - a]
            out = x >= limit * f
            if out.any():
                words.append((x[out] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                n_words += len(words[-1])
                x[out] >>= half
            q = x // f
            state[: b - a] = (q << shift) + (x - q * f) + s
            if r and r % CHECK_ROWS == 0:
                marks.append((r, n_words, state.astype("<u8").tobytes()))
        body = b"".join(w.tobytes() for w in reversed(words))
        checks = b"".join(struct.pack("<II", r, n_words - k) + x for r, k, x in reversed(marks))
        sums = b"".join(struct.pack("<I", zlib.crc32(ids[i : i + STRETCH].astype("<u4").tobytes())) for i in range(0, n, STRETCH))
        return struct.pack("<III", n, n_words, len(marks)) + state.astype("<u8").tobytes() + checks + sums + body

    def decode(self, block: bytes, first: int = 0, end: int | None = None) -> tuple[int, np.ndarray]:
        """The ids of a block in the stretches that hold ids first to end, and the number of the first of them.

        Decoding starts at a checkpoint; each stretch is checked by its CRC-32, the block's end by its states.
        """
        n, n_words, n_marks = struct.unpack_from("<III", block)
        end = n if end is None else min(end, n)
        begin = min(first // STRETCH, n_marks)
        at = 12
        state = np.frombuffer(block, "<u8", LANES, at).astype(np.uint64)
        at += 8 * LANES
        word = 0
        if begin:
            mark = at + (begin - 1) * (8 + 8 * LANES)
            row, word = struct.unpack_from("<II", block, mark)
            if row != begin * CHECK_ROWS:
                raise ValueError("a checkpoint isn't where it should be")
            state = np.frombuffer(block, "<u8", LANES, mark + 8).astype(np.uint64)
        at += n_marks * (8 + 8 * LANES)
        stretches = -(-n // STRETCH)
        sums = np.frombuffer(block, "<u4", stretches, at)
        words = np.frombuffer(block, "<u4", n_words, at + 4 * stretches)
        stop = min(stretches, max(begin + 1, -(-end // STRETCH)))
        base = begin * STRETCH
        out = np.empty(min(n, stop * STRETCH) - base, np.uint32)
        mask, shift, half = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
        for r in range(begin * CHECK_ROWS, -(-(base + len(out)) // LANES)):
            a, b = r * LANES, min(n, (r + 1) * LANES)
            x = state[: b - a]
            slot = x & mask
            ids = self.symbol[slot]
            out[a - base : b - base] = ids
            x = self.freq64[ids] * (x >> shift) + slot - self.start[ids]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = x[low] << half | words[word : word + len(low)]
                word += len(low)
            state[: b - a] = x
        if stop == stretches and (state != LOW).any():
            raise ValueError("a block doesn't end in the state it began with")
        for k in range(begin, stop):
            if zlib.crc32(out[k * STRETCH - base : (k + 1) * STRETCH - base].astype("<u4").tobytes()) != sums[k]:
                raise ValueError("a stretch doesn't match its checksum")
        return base, out


_ready: dict = {}


def _table(counts: np.ndarray) -> Table:
    """The table of this worker process."""
    key = "table", zlib.crc32(counts.tobytes()), len(counts)
    if key not in _ready:
        _ready[key] = Table(counts)
    return _ready[key]


def _tokenizer(data: str, specials_as_text: bool):
    """Tokenizer and memo of this worker process."""
    key = hash(data), specials_as_text
    if key not in _ready:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(data)
        own.encode_special_tokens = specials_as_text
        width = "<u2" if own.get_vocab_size() <= 65536 else "<u4"

        spaced = np.zeros(own.get_vocab_size(), bool)
        for token, number in own.get_vocab().items():
            spaced[number] = token.startswith("\u0120")  # this is how byte-level vocabularies write a space

        def alone(pieces: list[str]) -> list[bytes]:
            return [np.array(x.ids, width).tobytes() for i in range(0, len(pieces), 4096) for x in own.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]

        def together(pieces: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for i in range(0, len(pieces), 8192):
                part = pieces[i : i + 8192]
                ids = np.array(own.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, width)
                starts = np.flatnonzero(spaced[ids])  # an id that begins with a space begins a piece
                if len(starts) != len(part):
                    out += alone([" " + x for x in part])
                    continue
                flat, wide = ids.tobytes(), ids.itemsize
                ends = (wide * starts).tolist() + [len(flat)]
                out += [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            return out

        special = [] if specials_as_text else [x.content for x in own.get_added_tokens_decoder().values()]
        _ready[key] = chunks.Memo(alone, together, public_tokenizers.PATTERN, width, limit=900_000), alone, special, width
    return _ready[key]


def tokenise(documents: DataFrame, vocabulary: str, end_id: int, specials_as_text: bool = True) -> DataFrame:
    """doc_id, n_tokens and packed ids with the end id, unordered, as a written table.

    counts of the first row of a part holds how often ids occur in the part, as pairs of id and number.
    """
    with open(vocabulary, encoding="utf-8") as f:
        data = documents.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file: under 2 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, encode, special, width = _tokenizer(data.value, specials_as_text)
        end = np.array([end_id], width).tobytes()
        wide = len(end)
        for batch in batches:
            for part, column in chunks.slices(batch, "text", 20 << 20):
                ids = memo.column(column, end)
                if special and any(pc.any(pc.match_substring(column, s)).as_py() for s in special):  # a special token's own string needs the whole text
                    texts = column.to_pylist()
                    ids = pa.array([encode([x])[0] + end if x and any(s in x for s in special) else y for x, y in zip(texts, ids.to_pylist(), strict=True)], pa.binary())
                n = pc.divide(pc.cast(pc.binary_length(ids), pa.int64()), wide)
                found = np.bincount(np.frombuffer(ids.buffers()[2], width) if ids.offset == 0 and len(ids) else np.zeros(0, np.int64))
                used = np.flatnonzero(found)
                counts = [np.stack([used, found[used]]).astype("<i8").tobytes()] + [None] * (len(ids) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), n, ids, pa.array(counts, pa.binary())], names=TOKENS.names)

    common.ship(documents.sparkSession)
    return common.written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS))


def _unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32)


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; one row for each id and task, added up by Spark. The driver gets the vocabulary's size of rows."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for pairs in common.values(batch, "counts"):
                ids, n = np.frombuffer(pairs, "<i8").reshape(2, -1)
                if len(ids) and ids[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64)])
                total[ids] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=schema.names)

    # Only the small column is read.
    rows = tokens.select("counts").where("counts IS NOT NULL").mapInArrow(run, schema).groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write_files(tokens: DataFrame, counts: np.ndarray, folder: str) -> DataFrame:
    """Sort by doc_id over all files and write one file for each range; gives the manifest with start, the ids before a file.

    Only the written manifest says which files count, so retried tasks do no harm.
    """
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(counts)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        table = _table(shared.value)
        store, top = common.files(folder)
        store.create_dir(top, recursive=True)
        path = f"part-{at.partitionId():06d}-{at.taskAttemptId()}.ans"
        out = None
        held: list[np.ndarray] = []
        n_held = tokens = offset = 0
        docs: list[int | None] = []
        sizes: list[int] = []
        blocks: list[tuple[int, int, int]] = []

        def put(ids: np.ndarray) -> None:
            nonlocal offset
            data = table.encode(ids)
            out.write(data)
            blocks.append((offset, len(data), len(ids)))
            offset += len(data)

        for batch in batches:
            for doc_id, n, ids in zip(*(common.values(batch, c) for c in ("doc_id", "n_tokens", "ids")), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{top}/{path}", compression=None)
                    out.write(MAGIC)
                    offset = len(MAGIC)
                docs.append(doc_id)
                sizes.append(n)
                tokens += n
                held.append(_unpack(ids, n))
                n_held += n
                if n_held >= BLOCK:
                    flat = np.concatenate(held)
                    while len(flat) >= BLOCK:
                        put(flat[:BLOCK])
                        flat = flat[BLOCK:]
                    held, n_held = [flat], len(flat)
        if out is None:
            return
        if n_held:
            put(np.concatenate(held))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.searchsorted(starts[:-1], np.arange(0, len(blocks) + UNIT, UNIT) * BLOCK)  # of documents by the unit that they begin in
        units = []
        for a, b in zip(edges, edges[1:], strict=False):
            part = np.array(sizes[a:b], "<u4").tobytes() + np.array([x or 0 for x in docs[a:b]], "<i8").tobytes() + np.packbits(np.array([x is None for x in docs[a:b]], bool)).tobytes()
            data = zlib.compress(part, 1)
            out.write(data)
            units.append((offset, len(data), int(b - a), int(starts[a])))
            offset += len(data)
        footer = json.dumps({"documents": len(docs), "units": units, "blocks": blocks}).encode()
        out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at.partitionId(), f"{folder}/{path}", tokens, len(docs), len(blocks))], names=MANIFEST.names)

    ordered = tokens.drop("counts").withColumn("tie", F.xxhash64("ids"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    manifest = common.written(ordered.mapInArrow(run, MANIFEST), partitions=None)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_files(manifest: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, decoded from the files; a task takes some units of UNIT blocks.

    Of a unit, the documents that begin in its blocks are decoded, from the checkpoint before the first one on, and into
    the next blocks as far as the last one goes.
    """
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    units = manifest.select("path", F.col("start").alias("before"), F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / UNIT).cast("long"))).alias("unit"))

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        table = _table(shared.value)
        for path, before, unit in zip(*(common.values(batch, c) for c in ("path", "before", "unit")), strict=True):
            store, name = common.files(path)
            with store.open_input_file(name) as f:
                end = f.size()
                size = struct.unpack("<I", f.read_at(4, end - 12))[0]
                footer = json.loads(f.read_at(size, end - 12 - size))
                place, length, n, start = footer["units"][unit]
                directory = zlib.decompress(f.read_at(length, place))
                docs = np.frombuffer(directory, "<i8", n, 4 * n)
                none = np.unpackbits(np.frombuffer(directory, np.uint8, -1, 12 * n))[:n]
                ends = start + np.concatenate([[0], np.cumsum(np.frombuffer(directory, "<u4", n).astype(np.int64))])
                flat, done, last = np.zeros(0, np.uint32), start, int(ends[-1])  # ids from number done on
                for i in range(n):
                    a, b = int(ends[i]), int(ends[i + 1])
                    parts = [flat[a - done :]]
                    done, held = a, len(parts[0])
                    while done + held < b:
                        block, skip = divmod(done + held, BLOCK)
                        at, length, _ = footer["blocks"][block]
                        base, ids = table.decode(f.read_at(length, at), skip, last - block * BLOCK)
                        parts.append(ids[skip - base :])
                        held += len(parts[-1])
                    flat = np.concatenate(parts) if len(parts) > 1 else parts[0]
                    yield None if none[i] else int(docs[i]), before + a, b - a, flat[: b - a].astype("<u4").tobytes()

    common.ship(spark)
    n = common.tasks(spark, units.count())  # a number of its own, as Spark merges small partitions otherwise
    return units.repartition(n, F.col("path"), F.col("unit")).mapInArrow(common.arrow_rows(READ, run), READ)


def write_documents(documents: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Tokenise and write; gives the manifest and the counts that read_files() takes."""
    tokens = tokenise(documents, vocabulary, end_id)
    counts = count_ids(tokens)
    return write_files(tokens, counts, folder or common.shared_dir(documents.sparkSession)), counts
