import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideframe.llm import ans

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 70_001, ans.BLOCK])
def test_blocks_round_trip(n):
    random = np.random.default_rng(n)
    ids = np.minimum(random.zipf(1.3, n), 50_000).astype(np.uint32)
    table = ans.Table(np.bincount(ids, minlength=50_257) + (np.arange(50_257) < 40_000))
    block = table.encode(ids)
    base, whole = table.decode(block)
    assert base == 0 and (whole == ids).all()
    for first, end in ((0, 1), (n // 2, n // 2 + 1), (n // 3, n), (n - 1, n)):  # from a checkpoint on, up to one
        base, part = table.decode(block, first, end)
        assert base <= first and base + len(part) >= end and (part == ids[base : base + len(part)]).all()
        assert base % ans.STRETCH == 0 and first - base < ans.STRETCH and base + len(part) - end < ans.STRETCH
    if n > 70_000:
        assert len(block) < 2.2 * n


def test_a_broken_block_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 97
    table = ans.Table(np.bincount(ids))
    block = bytearray(table.encode(ids))
    block[-20] ^= 1
    with pytest.raises((ValueError, IndexError)):
        table.decode(bytes(block))
    ids = np.arange(3 * ans.STRETCH, dtype=np.uint32) % 97
    table = ans.Table(np.bincount(ids))
    good = table.encode(ids)
    for at in (len(good) - 40, len(good) - len(good) // 8):  # in the words of the last stretch: the one before is sound
        bad = bytearray(good)
        bad[at] ^= 255
        assert (table.decode(bytes(bad), ans.STRETCH, 2 * ans.STRETCH)[1] == ids[ans.STRETCH : 2 * ans.STRETCH]).all()
        with pytest.raises((ValueError, IndexError)):
            table.decode(bytes(bad), 2 * ans.STRETCH)


def test_documents_over_many_units(spark, monkeypatch):
    """Small blocks and units: documents begin and end anywhere, one spans several units, and reads start at checkpoints."""
    texts = [f"some words of document {i} " * (1 + i % 37) for i in range(300)] + ["a very long one " * 5000] + ["short"] * 50
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows, every, unit in ((4, 1, 1), (4, 2, 2)):
        with monkeypatch.context() as m:
            for name, value in (("LANES", 8), ("ROWS", rows), ("CHECK_ROWS", every), ("BLOCK", 8 * rows), ("STRETCH", 8 * every), ("UNIT", unit)):
                m.setattr(ans, name, value)
            table = ans.Table(np.bincount(np.arange(60_000) % 50_257, minlength=50_257))
            ids = np.random.default_rng(1).integers(0, 50_257, 8 * rows).astype(np.uint32)
            block = table.encode(ids)
            for first in range(0, 8 * rows, 3):
                base, part = table.decode(block, first, first + 2)
                assert (part == ids[base : base + len(part)]).all() and len(part) <= 16 * every
    manifest, counts = ans.write_documents(frame, PATH, 2)
    got = ans.read_files(manifest, counts).collect()
    own = Tokenizer.from_file(PATH)
    for r in got:
        assert bytes(r.ids) == np.array([*own.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert len(got) == len(texts)


def test_units_in_which_no_document_begins(spark, monkeypatch):
    texts = ["first", "one over many units " * 500, "last"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, value in (("BLOCK", 64), ("UNIT", 2)):  # the writer's and the reader's tasks take these along
        monkeypatch.setattr(ans, name, value)
    monkeypatch.setattr(ans.common, "tasks", lambda spark, items: 4)
    manifest, counts = ans.write_documents(frame, PATH, 2)
    assert manifest.agg({"blocks": "max"}).first()[0] > 10
    got = {r.doc_id: bytes(r.ids) for r in ans.read_files(manifest, counts).collect()}
    own = Tokenizer.from_file(PATH)
    assert got == {i: np.array([*own.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, x in enumerate(texts)}


def test_files_against_the_library(spark, monkeypatch):
    texts = ["hello world", None, "", "the  the", "x" * 3000, "hello world", "many words here " * 9000, "end <|endoftext|> text"]
    rows = [(7 * i % 5 if i != 3 else None, x, "extra") for i, x in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    manifest, counts = ans.write_documents(frame, PATH, 2)
    got = sorted(ans.read_files(manifest, counts).collect(), key=lambda r: r.start)
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    want = sorted(((d is not None, d or 0), zlib.crc32(np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t, _ in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), zlib.crc32(r.ids)) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert (r.start, len(r.ids)) == (at, 4 * r.n_tokens)
        at += r.n_tokens
    manifest, counts = ans.write_documents(frame.limit(0), PATH, 2)
    assert ans.read_files(manifest, counts).count() == 0
