"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Each pre-token is merged with the help of a segment tree over its byte positions. A leaf holds the rank of the pair
that starts at that live position, an inner node the smaller rank of its children, so the leftmost pair of least rank
is found by one walk down; a merge changes three leaves (the pair's own, the dead right part, the live left
neighbour) and their ancestors. Short pre-tokens of a batch are merged side by side, one tree for each row of
an array; long ones, where trees matter most, one by one.

Defined cases: a null text is empty and has no ids; texts of any length are encoded whole; special tokens don't exist.
Repeated rows repeat. Extra columns pass through encode() and decode(); an empty table stays empty.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideframe.llm import chunks, common

NONE = np.int32(2**31 - 1)
SHORT = 64  # bytes of a pre-token that is merged in an array with others
ROWS = 1 << 13
SLICE = 3 << 20  # bytes of text that are encoded together
MEMO = 200_000  # pieces whose ids a worker keeps


class Merger:
    """Vocabulary and merges. A token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = array("q")
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.extend((left << 32 | right, rank))
        both = np.frombuffer(pairs, np.int64).reshape(-1, 2)
        order = np.argsort(both[:, 0])
        self.keys, self.values = both[order, 0].copy(), both[order, 1].astype(np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where they don't merge or a side is missing (-1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.values[at], NONE)

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most width bytes (a power of two), one segment tree a row."""
        n = len(words)
        ids = np.full((n, width + 2), -1, np.int32)  # position i at i + 1; both ends stay empty
        sizes = np.array([len(w) for w in words])
        inside = np.arange(width)[None, :] < sizes[:, None]
        ids[:, 1:-1][inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        place = np.arange(width + 2, dtype=np.int32)
        after = np.minimum(np.broadcast_to(place + 1, ids.shape), width + 1).copy()
        before = np.maximum(np.broadcast_to(place - 1, ids.shape), 0).copy()
        tree = np.full((n, 2 * width), NONE, np.int32)
        tree[:, width:] = self.pair_ranks(ids[:, 1:-1], ids[:, 2:])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            node = np.ones(len(rows), np.int64)
            while node[0] < width:  # down to the leftmost leaf of least rank
                node *= 2
                node += tree[rows, node] > tree[rows, node + 1]
            at = node - width + 1
            ids[rows, at] = tree[rows, node]
            dead = after[rows, at]
            far = after[rows, dead]
            after[rows, at] = far
            before[rows, far] = at
            ids[rows, dead] = -1
            near = before[rows, at]
            own = ids[rows, at]
            leaves = ((at, self.pair_ranks(own, ids[rows, far])), (dead, NONE), (near, self.pair_ranks(ids[rows, near], own)))
            for position, rank in leaves:
                leaf = position.astype(np.int64) - 1 + width
                on = position > 0
                r, leaf = rows[on], leaf[on]
                tree[r, leaf] = rank[on] if isinstance(rank, np.ndarray) else rank
                while len(leaf) and leaf[0] > 1:
                    leaf >>= 1
                    tree[r, leaf] = np.minimum(tree[r, 2 * leaf], tree[r, 2 * leaf + 1])
            rows = rows[tree[rows, 1] != NONE]
        live = ids[:, 1:-1] >= 0
        flat = ids[:, 1:-1][live].astype("<u4").tobytes()
        ends = np.concatenate([[0], 4 * np.cumsum(live.sum(1))]).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one long word; the same tree in a list."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        none, token, rank_of = int(NONE), self.tokens, self.ranks.get
        pair = lambda a, b: rank_of(token[a] + token[b], none)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pair(ids[i], ids[i + 1])
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int) -> None:
            i += width
            tree[i] = rank
            i >>= 1
            while i:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    return
                tree[i] = low
                i >>= 1

        while tree[1] != none:
            node = 1
            while node < width:
                node *= 2
                node += tree[node] > tree[node + 1]
            at, rank = node - width, tree[node]
            dead = after[at]
            far = after[dead]
            ids[at], ids[dead], after[at] = rank, -1, far
            put(dead, none)
            put(at, none if far >= n else pair(rank, ids[far]))
            if far < n:
                before[far] = at
            if (near := before[at]) >= 0:
                put(near, pair(ids[near], rank))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens; one that is itself in the vocabulary is one id."""
        out: dict[bytes, bytes] = {}
        todo: dict[int, list[bytes]] = {}
        for word in dict.fromkeys(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[word] = rank.to_bytes(4, "little")
            elif len(word) > SHORT:
                out[word] = self.merge_long(word)
            else:
                todo.setdefault(max(2, 1 << (len(word) - 1).bit_length()) if word else 2, []).append(word)
        for width, part in todo.items():
            for i in range(0, len(part), ROWS):
                rows = part[i : i + ROWS]
                out.update(zip(rows, self.merge_rows(rows, width), strict=True))
        return [out[w] for w in words]

    def decode(self, packed: pa.Array) -> pa.Array:
        """The bytes that packed ids stand for (null: none)."""
        get = self.tokens.__getitem__
        return pa.array([b"".join(map(get, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in packed], pa.binary())


def load(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


_ready: dict[tuple[int, str], tuple[Merger, chunks.Memo]] = {}


def ready(data: bytes, pattern: str) -> tuple[Merger, chunks.Memo]:
    """Merger and memo of this worker process."""
    key = hash(data), pattern
    if key not in _ready:
        merger = Merger(load(data))
        find = regex.compile(pattern).findall

        def alone(pieces: list[str]) -> list[bytes]:
            words = [[w.encode("utf-8", "surrogatepass") for w in find(x)] for x in pieces]
            ids = iter(merger.encode_words([w for x in words for w in x]))
            return [b"".join(next(ids) for _ in x) for x in words]

        def together(pieces: list[str]) -> list[bytes]:
            words = find(" " + " ".join(pieces))  # a word that begins with a space begins a piece
            ids = merger.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
            starts = [i for i, w in enumerate(words) if w[0] == " "]
            if len(starts) != len(pieces):
                return alone([" " + x for x in pieces])
            return [ids[a] if b == a + 1 else b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(words)], strict=True)]

        _ready[key] = merger, chunks.Memo(alone, together, pattern, limit=MEMO)
    return _ready[key]


def encode(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """documents with their ids instead of the text: little-endian unsigned 32-bit integers in a binary column.

    decoded names a further column for what the ids decode to, made in the same pass: one Python worker instead of two.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())  # the vocabulary file: under 1 MB whatever the input
    rest = [f for f in documents.schema.fields if f.name not in (text, ids, decoded)]
    schema = T.StructType([*rest, T.StructField(ids, T.BinaryType()), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, memo = ready(data.value, pattern)
        for batch in batches:
            for part, column in chunks.slices(batch, text, SLICE):
                columns = [part.column(part.schema.get_field_index(f.name)) for f in rest]
                columns.append(memo.column(column))
                if decoded:
                    columns.append(merger.decode(columns[-1]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            pa.default_memory_pool().release_unused()  # workers live on from stage to stage

    common.ship(spark)
    return documents.select(*[f.name for f in rest], text).mapInArrow(run, schema)


def decode(frame: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """frame and the bytes that its ids stand for, in a binary column."""
    spark = frame.sparkSession
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([*(f for f in frame.schema.fields if f.name != decoded), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, _ = ready(data.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, merger.decode(part.column(part.schema.get_field_index(ids)))], names=schema.names)

    common.ship(spark)
    return frame.select(*schema.names[:-1]).mapInArrow(run, schema)
