"""Splitting texts so that each distinct piece is tokenised once in a while.

The pre-token pattern of byte-level BPE puts a boundary before every single space, so a text cut at its spaces can be
tokenised piece by piece. That is not so where spaces follow other white space ("  ", or a space at the end);
such texts are cut by the pattern itself. A bounded memo holds the pieces' ids; emptying it costs time only.
New pieces of a batch that neither begin nor end with white space are tokenised as one text, again cut at its spaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

MARKS = ".,;:!?%*&$#"  # neither letters, numbers nor white space

Encode = Callable[[list[str]], list[bytes]]


class Memo:
    """Ids of texts through the memo.

    alone gives the packed ids of pieces, each on its own; together those of pieces that a space goes before each of,
    none with white space at an end, or with a space inside.
    """

    def __init__(self, alone: Encode, together: Encode, pattern: str, width: str = "<u4", limit: int = 700_000):
        self.alone, self.together, self.width, self.limit = alone, together, np.dtype(width), limit
        self.find = regex.compile(pattern).findall
        self.spaced: dict[str, bytes] = {}  # pieces that a space stands before, without it
        self.plain: dict[str, bytes] = {}

    def _learn(self, spaced: set[str], plain: set[str]) -> None:
        spaced = spaced.difference(self.spaced)
        plain = plain.difference(self.plain)
        # The pattern parts letters from the marks after them, so a new piece of both needs the ids of each only.
        marked = {}
        for x in spaced:
            core = x.rstrip(MARKS)
            if core is not x and core != x and core.isalpha():
                marked[x] = core
        spaced = spaced.difference(marked).union(marked.values()).difference(self.spaced)
        plain |= {x[len(core) :] for x, core in marked.items()}.difference(self.plain)
        loose = [x for x in spaced if x[0].isspace() or x[-1].isspace()]
        firm = list(spaced.difference(loose))
        for i in range(0, len(firm), 20_000):
            self.spaced.update(zip(firm[i : i + 20_000], self.together(firm[i : i + 20_000]), strict=True))
        rest = list(plain)
        if loose or rest:
            ids = self.alone([" " + x for x in loose] + rest)
            self.spaced.update(zip(loose, ids[: len(loose)], strict=True))
            self.plain.update(zip(rest, ids[len(loose) :], strict=True))
        for x, core in marked.items():
            self.spaced[x] = self.spaced[core] + self.plain[x[len(core) :]]

    def _by_pattern(self, text: str) -> bytes:
        pieces = self.find(text)
        spaced = [x[0] == " " and len(x) > 1 and x[1] != " " for x in pieces]
        self._learn({x[1:] for x, s in zip(pieces, spaced, strict=True) if s}, {x for x, s in zip(pieces, spaced, strict=True) if not s})
        return b"".join(self.spaced[x[1:]] if s else self.plain[x] for x, s in zip(pieces, spaced, strict=True))

    def column(self, texts: pa.Array, tail: bytes = b"") -> pa.Array:
        """Packed ids of each text (null: empty), with the packed ids tail at its end, as a binary array.

        Arrow cuts the texts and finds the batch's distinct pieces, so Python sees each of these once.
        """
        texts = pc.fill_null(texts, "")
        hard = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False)
        easy = texts if not hard.any() else texts.filter(pa.array(~hard))
        packed = self._easy(easy, tail) if len(easy) else pa.array([], pa.binary())
        if not hard.any():
            return packed
        out, rest = [], iter(packed)
        for x, is_hard in zip(texts, hard.tolist(), strict=True):
            out.append(self._by_pattern(x.as_py()) + tail if is_hard else next(rest).as_py())
        return pa.array(out, pa.binary())

    def _easy(self, texts: pa.Array, tail: bytes) -> pa.Array:
        lists = pc.split_pattern(texts, " ")
        flat, edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        first = np.zeros(len(flat), bool)
        first[edges[:-1]] = True
        coded = flat.filter(pa.array(~first)).dictionary_encode()
        # Through numpy, which makes all strings in one go.
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = flat.take(pa.array(edges[:-1])).to_numpy(zero_copy_only=False).tolist()
        if len(self.spaced) + len(self.plain) > self.limit:
            self.spaced.clear()
            self.plain.clear()
        known = list(map(self.spaced.get, pieces))
        new = [i for i, x in enumerate(known) if x is None]
        self._learn({pieces[i] for i in new}, {x for x in heads if x})
        for i in new:
            known[i] = self.spaced[pieces[i]]
        get = self.plain.get
        known += [get(x, b"") for x in heads]
        known.append(tail)
        wide = self.width.itemsize
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // wide
        starts = np.cumsum(lengths) - lengths
        pool = np.frombuffer(b"".join(known), self.width)
        # The pieces of all texts in order, each text with its head before and the tail after.
        n = len(texts)
        part = np.empty(len(flat) + n, np.int64)
        shift = np.repeat(np.arange(n), np.diff(edges))
        place = np.arange(len(flat)) + shift
        part[place[~first]] = coded.indices.to_numpy()
        part[place[first]] = len(pieces) + np.arange(n)
        part[edges[1:] + np.arange(n)] = len(known) - 1
        size = lengths[part]
        upto = np.cumsum(size)
        ids = pool[np.repeat(starts[part] - (upto - size), size) + np.arange(int(upto[-1]))]
        offsets = np.zeros(n + 1, np.int64)
        offsets[1:] = upto[edges[1:] + np.arange(n)] * wide
        if offsets[-1] < 1 << 31:
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
        whole = ids.tobytes()
        return pa.array([whole[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], pa.large_binary())

    def batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        return self.column(pa.array(texts, pa.string())).to_pylist()


def slices(batch: pa.RecordBatch, text: str, size: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch, and its column text, in parts of about so many bytes of text."""
    index = batch.schema.get_field_index(text)
    column = batch.column(index)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, stop - at), column.slice(at, stop - at)
        at = stop
