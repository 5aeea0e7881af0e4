import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.llm import hard_negatives as h
from tideframe.llm import vectors


def brute(rows, every=10, scale=256, positives=5, negatives=10, low=30, high=90):
    usable = [(i, lab, [math.floor(scale * float(c)) for c in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, lab, v in usable:
        if i % every:
            continue
        found = [(score(v, w), j, m) for j, m, w in usable]
        first = sorted((-s, j) for s, j, m in found if m == lab and j != i)[:positives]
        for s, j in first:
            p = -s
            there = sorted((-t, k) for t, k, m in found if m != lab and low * p <= 100 * t <= high * p)[:negatives]
            out += [(i, j, r + 1, k, p, -t) for r, (t, k) in enumerate(there)]
    return sorted(out)


def table(n, width, labels, seed=0, spread=0.2):
    r = np.random.default_rng(seed)
    return [(i, [float(v) for v in np.round(r.standard_normal(width) * spread, 1)], int(r.integers(labels))) for i in range(n)]  # rounded: ties


def found(spark, rows, every=10, kind="double", **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, rank string").repartition(3)
    return sorted(map(tuple, h.mine(df, F.col("vec_id") % every == 0, **more).collect()))


@pytest.mark.parametrize(("width", "labels"), [(3, 2), (16, 4), (70, 3)])
def test_against_all_scores(spark, width, labels, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(h, "ROWS", 16)
    monkeypatch.setattr(h, "AT_ONCE", 3)
    rows = table(300, width, labels, width)
    assert found(spark, rows) == brute(rows)


def test_many_sheets_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)
    monkeypatch.setattr(h, "SHEETS", 0)
    monkeypatch.setattr(h, "SHARE", 5)
    monkeypatch.setattr(h, "HELD", 10)
    rows = table(200, 4, 3, 5)
    assert found(spark, rows, every=4) == brute(rows, every=4)


def test_one_hot_label_and_one_label(spark):
    rows = [(i, v, 0 if i % 9 else 1) for i, v, _ in table(120, 4, 1, 6)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(i, v, 0) for i, v, _ in rows]) == []


def test_large_and_negative_scores(spark):
    rows = [(i, [c * 1e6 for c in v], lab) for i, v, lab in table(80, 3, 2, 7)] + [(200 + i, [-5.0, 0.1 * i, -2.0], i % 2) for i in range(6)]
    assert found(spark, rows) == brute(rows)


def test_what_takes_no_part(spark):
    bad = [(None, [0.1, 0.2, 0.3], 1), (500, None, 1), (510, [0.1, None, 0.2], 1), (520, [0.1, math.nan, 0.2], 1), (530, [math.inf, 0.1, 0.2], 0), (540, [0.1, 0.2, 0.3], None), (550, [], 1)]
    rows = table(60, 3, 2, 8) + bad
    assert found(spark, rows) == brute(rows)
    short, long = [(560, [0.1], 1)], [(570, [1e9, 0.1, 0.1], 1)]
    assert found(spark, rows + short + long) == brute(rows)
    assert found(spark, rows + rows[:20]) == brute(rows + rows[:20])
    assert found(spark, []) == [] and found(spark, rows, every=1000) == brute(rows, every=1000)


def test_residues_give_exact_scores():
    r = np.random.default_rng(1)
    for width, size in ((64, 90), (700, 1 << 20), (3, 1 << 30)):
        a, b = r.integers(-size, size, (20, width)), r.integers(-size, size, (30, width))
        want = a.astype(object) @ b.astype(object).T
        bound = math.isqrt(vectors.largest_norm(a)[0] * vectors.largest_norm(b)[0]) + 1
        primes = h.primes_for(width, bound)
        assert len(set(primes)) == len(primes) and math.prod(primes) > 2 * bound + 1
        got = h._scores([h.residues(a, p) for p in primes], [h.residues(b, p) for p in primes], primes)
        assert (got.astype(object) == want).all()
