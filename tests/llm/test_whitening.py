import math

import numpy as np
import pytest

from tideframe.llm import vectors
from tideframe.llm import whitening as w


def brute(x, k=w.COMPONENTS):
    """Exact centring, all eigenvectors."""
    n = len(x)
    whole = np.array([[int(v) for v in row] for row in x.tolist()], object)
    d = n * whole - whole.sum(0)
    c = d.astype(float) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    keep = [i for i in range(len(e) - 1, -1, -1) if e[i] > w.RANK * e[-1]][:k]
    return (d * d).sum(1), c @ q[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(c.T @ c / n)


def held(got, ids, x, scale):
    want_d, want, explained = brute(np.floor(scale * x.astype(float)))
    k = want.shape[1]
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(i, j + 1) for i in sorted(ids) for j in range(k)]
    by = np.argsort(ids)
    z = np.array([r.whitened for r in got]).reshape(-1, k)
    sign = np.sign((z * want[by]).sum(0))
    assert np.abs(z * sign - want[by]).max() < 1e-8
    assert [int(r.deviation) for r in got[::k]] == [int(v) for v in want_d[by]]
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-9)
    assert {r.n for r in got} == {len(x)} and got[0].identity_error < 1e-7


def frame(spark, ids, x, kind="float"):
    return spark.createDataFrame([(i, [float(v) for v in row], "label") for i, row in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>, component string").repartition(3)


@pytest.mark.parametrize(("width", "shape"), [(64, "flat"), (90, "falling"), (5, "flat"), (64, "gap")])
def test_against_all_eigenvectors(spark, width, shape, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    r = np.random.default_rng(width)
    spread = {"flat": np.ones(width), "falling": 1 / (1 + np.arange(width)) ** 0.7, "gap": np.where(np.arange(width) < 40, 1.0, 1e-3)}[shape]
    x = (r.standard_normal((700, width)) * spread * 40).astype(np.float32)
    ids = [i * 37 % 701 for i in range(700)]
    held(w.whiten(frame(spark, ids, x)).collect(), ids, x, 64)


def test_offset_and_large_entries(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((200, 6)) + 1e6
    x[:, 0] = r.standard_normal(200) * 1e14  # sums of squares beyond a long
    held(w.whiten(frame(spark, range(200), x, "double")).collect(), list(range(200)), x, 64)


def test_what_is_left_out(spark):
    nan, inf = math.nan, math.inf
    rows = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(1, 9)]
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [nan, 1.0, 1.0]), (23, [1.0, inf, 1.0]), (24, []), (25, [1.0]), (26, [1.0, 1e300, 1.0]), (None, [3.0, 3.0, 1.0]), (1, rows[0][1])]
    got = w.whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2}  # the third entry is constant
    assert sorted((r.vec_id is not None, r.vec_id or 0) for r in got if r.component == 1) == [(False, 0), (True, 1), *((True, i) for i in range(1, 9))]
    assert {r.n for r in got} == {10}


def test_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert w.whiten(none).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert w.whiten(same).count() == 0
    assert w.whiten(same.where("vec_id = 1")).columns == w.WHITENED.names


def test_filter_grows_the_wanted_part():
    e = np.linspace(1, 100, 60)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((60, 60)))
    passes = []

    def times(y):
        passes.append(y.shape[1])
        return q @ (e[:, None] * (q.T @ y))

    found, vectors_, residuals = w.principal(times, 60, 8)
    assert np.allclose(found, e[::-1][:8], rtol=1e-12) and residuals.max() < 1e-12 and len(passes) < 90
    assert np.abs(np.abs((q[:, ::-1][:, :8] * vectors_).sum(0)) - 1).max() < 1e-12
    y = w.filtered(times, np.eye(60), times(np.eye(60)), 6, 1, 50, 100)
    grown = np.abs(np.diag(q.T @ y @ q))
    assert grown[:29].max() < 1e-2 and grown[-1] == pytest.approx(1)
    assert 0 <= w.lower_bound(times, 60, np.random.default_rng(2)) <= 1
