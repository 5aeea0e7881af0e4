import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    data = open(PATH, "rb").read()
    ranks = bpe.load(data)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.ready(data, PATTERN)


TEXTS = ["", " ", "  ", "a", "a b", "a  b", "a   b", "x\n y", "x\n  y ", " lead", "trail ", "tab\t x \n\n z", "don't we'll 's 'S", "é" * 70, "word" * 90, " " * 300, "1234 56", "  b　 c", "<|endoftext|> no", "ab" * 4000, "🙂🙂 ok", "a \n b \n", "x  y", "\n \n"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_texts(both, text):
    library, (merger, memo) = both
    (packed,) = memo.batch([text])
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert b"".join(merger.tokens[x] for x in np.frombuffer(packed, "<u4").tolist()) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t'aebtnsdé1.,! ß字"), max_size=90), max_size=6))
def test_ids_of_random_texts(both, texts):
    library, (_, memo) = both
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.batch(texts)] == [library.encode_ordinary(x) for x in texts]


def test_both_trees_agree(both):
    _, (merger, _) = both
    words = [bytes(np.random.default_rng(i).integers(97, 110, 1 + i % 60).astype(np.uint8)) for i in range(400)]
    for w in words:
        width = max(2, 1 << (len(w) - 1).bit_length())
        assert merger.merge_rows([w], width) == [merger.merge_long(w)]


def test_frame_with_nulls_and_extra_columns(spark):
    rows = [(1, "hello  world", "x"), (None, None, None), (3, "", "y"), (1, "hello  world", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = bpe.decode(bpe.encode(frame, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in got) == [b"", b"", b"hello  world", b"hello  world"]
    assert sorted(bytes(r.decoded) for r in bpe.encode(frame, PATH, PATTERN, decoded="decoded").collect()) == sorted(bytes(r.decoded) for r in got)
    assert bpe.encode(frame.limit(0), PATH, PATTERN).count() == 0
    assert os.path.exists(PATH)
