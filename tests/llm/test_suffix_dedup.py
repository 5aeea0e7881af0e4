import random

import numpy as np
import pytest

from tideframe.llm import suffix_dedup as sd


def brute(rows, window):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((-1 if d is None else d, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def corpus(seed, window, n=90):
    r = random.Random(seed)
    words = ["ab", "cdé", "e", "fghij", "the", "of"] + [f"x{i}" for i in range(60)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    base = [text(r.choice([3, 20, 90, 300])) for _ in range(25)]
    passages = [text(40)[: window + x] for x in (-1, 0, 1, 7, 60)]
    rows = []
    for i in range(n):
        x = r.choice(base)
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(x))
            x = x[:k] + r.choice(["", "Q", r.choice(passages)]) + x[k:]
        rows.append((i, x))
    return rows + [(900, None), (901, ""), (902, "z" * (3 * window)), (903, "z" * window), (904, "y" * window), (905, "ab" * 2 * window), (None, rows[0][1]), rows[1]]


@pytest.mark.parametrize(("window", "gram", "seed"), [(50, 20, 1), (50, 8, 2), (200, None, 3), (31, 31, 4)])
def test_against_all_windows(spark, window, gram, seed):
    rows = corpus(seed, window)
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(frame, window, gram).collect())
    assert got == brute(rows, window)


def test_repeats_with_a_gap_between_them(spark):
    r = random.Random(9)
    text = "".join(r.choice("abcdefghij") for _ in range(400))
    rows = [(1, text), (2, text[0:50] + "#" + text[90:140]), (3, "?" + text[200:251] + "!")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect())
    assert got == brute(rows, 50) and got[0][3] == 3


def test_a_passage_of_all_documents_is_dealt_out_evenly(spark):
    passage = "a passage that stands in every document of this corpus, word for word, and is longer than a window of two hundred bytes; " * 3
    rows = [(i, f"own words {i * 7919} " + passage + f"and more own words {i * 104729}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = frame.withColumn("key", sd.F.xxhash64("text")).withColumn("key2", sd.F.shiftrightunsigned(sd.F.xxhash64(sd.F.lit("again"), "text"), 32))
    dealt = sd.digits(docs.select("text", "key", "key2"), 200, 80)
    met = dealt.where("NOT settled").groupBy("h", "c").count().agg(sd.F.max("count")).first()[0]
    assert met <= 6  # a row and a witness for each part of the input
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(frame).collect())
    assert got == brute(rows, 200)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "BUFFER", 700)
    rows = corpus(5, 50)
    found = {}
    for texts in ([t.encode() for _, t in rows if t],):
        for text, pos, h, c in sd.anchors(texts, 50, 20):
            for x in zip(text.tolist(), pos.tolist(), h.tolist(), c.tolist(), strict=True):
                found[x[:2]] = x[2:]
        monkeypatch.setattr(sd, "BUFFER", 1 << 19)
        whole = {}
        for text, pos, h, c in sd.anchors(texts, 50, 20):
            for x in zip(text.tolist(), pos.tolist(), h.tolist(), c.tolist(), strict=True):
                whole[x[:2]] = x[2:]
    assert found == whole


def test_an_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_alike_in_one_hash_differ_in_the_other(monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choice("uvwxyz ") for _ in range(700)).encode() for _ in range(6)]
    monkeypatch.setattr(sd, "_BYTES", np.zeros(256, np.uint64))
    first, second = np.concatenate([sd.window_hashes(t, np.arange(501), 200) for t in texts], axis=1)
    assert len(np.unique(first)) == 1 and len(np.unique(second)) == 6 * 501
