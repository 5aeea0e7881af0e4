import numpy as np
import pytest

from tests.llm.test_ngram_join import brute, corpus, crowds
from tideframe.llm import ngram_join as nj
from tideframe.llm import setsketch as ss


def sets(n, similarity, pairs, seed=0):
    r = np.random.default_rng(seed)
    both = round(2 * n * similarity / (1 + similarity))
    out = []
    for _ in range(pairs):
        x = r.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        out += [x[:n], x[n - both :]]
    return out


@pytest.mark.parametrize(("n", "similarity"), [(40, 0.8), (400, 0.85), (400, 0.5), (3000, 0.95)])
def test_estimate(n, similarity):
    rows = ss.registers(sets(n, similarity, 80))
    a, b = rows[::2], rows[1::2]
    up, down, size = (a > b).sum(1), (a < b).sum(1), np.full(len(a), n)
    found, error = ss.similarity(up, down, ss.REGISTERS - up - down, size, size)
    assert abs(found.mean() - similarity) < 0.02 and 0.5 < found.std() / error.mean() < 1.6
    assert ss.likely(a, b, size, size, 85)[0].all() == (similarity >= 0.8)
    if similarity >= 0.85:
        shared = (ss.signatures(a) == ss.signatures(b)).sum(1)
        assert shared.min() > ss.slack(85)


def test_registers_are_mergeable_and_parts_don_t_matter(monkeypatch):
    s = sets(500, 0.3, 3)
    whole = ss.registers(s)
    union = ss.registers([np.union1d(s[0], s[1])])
    assert (np.maximum(whole[0], whole[1]) == union[0]).all()
    monkeypatch.setattr(ss, "ELEMENTS", 64)
    assert (ss.registers(s) == whole).all()
    assert (ss.registers([s[4]]) == whole[4:5]).all()
    assert ss.registers([np.zeros(0, np.uint64)]).max() == 0


def test_error_is_that_of_the_likelihood():
    n = np.array([300.0])
    step, j = 1e-4, 0.7
    only = 0.5 * (1 - j)

    def log_likelihood(x):
        p = 0.5 * (1 - x)
        return ss.REGISTERS * (2 * only * np.log(p) + (1 - 2 * only) * np.log(1 - 2 * p))

    curve = (log_likelihood(j + step) - 2 * log_likelihood(j) + log_likelihood(j - step)) / step**2
    assert ss.error(n / (2 * n), n / (2 * n), np.array([j]), np.array([ss.REGISTERS]))[0] == pytest.approx(1 / np.sqrt(-curve), rel=1e-3)


def test_slack():
    assert [ss.slack(p) for p in (70, 78, 85, 100)] == [-1, 0, 7, 84]


def result(frame, percent):
    got = ss.near_duplicates(frame, 5, percent).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got)


@pytest.mark.parametrize(("percent", "seed"), [(85, 1), (80, 2), (90, 3)])
def test_against_all_pairs(spark, percent, seed, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SETS", 7)
    rows = corpus(seed)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_shingles string, registers int")
    assert result(frame, percent) == brute(rows, 5, percent)


def test_crowds_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SETS", 20)
    monkeypatch.setattr(nj, "SKETCHED_SETS", 40)
    rows = crowds(5)
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    rows += [(9001, long), (9002, long + " end"), (9003, long[: len(long) // 2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(frame, 85) == brute(rows, 5, 85)


def test_empty_and_refused(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert ss.near_duplicates(frame.limit(0)).count() == 0
    assert result(frame, 85) == [(1, 2, 1), (2, 0, 2)]
    with pytest.raises(ValueError, match="don't find"):
        ss.near_duplicates(frame, 5, 50)
