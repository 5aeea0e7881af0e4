import random
import re

import numpy as np
import pytest

from tideframe.llm import ngram_join as nj


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = label[i], label[j]
                label = [y if k == x else k for k in label]
    least = {}
    for (d, _), k in zip(rows, label, strict=True):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return sorted((d if d is not None else -1, len(s), least.get(k, -1)) for (d, _), s, k in zip(rows, sets, label, strict=True))


def corpus(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of"] * 40
    rows, base = [], [[r.choice(vocabulary) for _ in range(r.choice([4, 9, 12, 30, 31, 60, 120, 400]))] for _ in range(50)]
    passage = ["shared", "passage", "of", "words"] * 3
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            k = r.randrange(len(words))
            words[k : k + r.choice([0, 1])] = [r.choice(vocabulary)]
        if r.random() < 0.3:
            words += passage
        rows.append((i * 3 % 1009, " ".join(words)))
    return rows + [(5000, None), (5001, ""), (5002, " \n "), (None, rows[0][1]), rows[1], (5003, "One Two"), (5004, "one\ttwo"), (5005, "two one")]


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 90, 3)])
def test_against_all_pairs(spark, width, percent, seed, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SETS", 7)  # clusters in several blocks
    rows = corpus(seed)
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_shingles string")
    got = nj.near_duplicates(frame, width, percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows, width, percent)


def test_one_of_each_and_empty(spark):
    rows = corpus(4)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = nj.one_of_each(frame).collect()
    groups = {(c if n else ("none", d)) for d, n, c in brute(rows, 5, 80)}
    assert len(kept) == len(groups)
    assert {r.doc_id for r in kept if shingles(r.text, 5)} == {g for g in groups if not isinstance(g, tuple)}
    assert nj.near_duplicates(frame.limit(0)).count() == 0 and nj.one_of_each(frame.limit(0)).count() == 0


def crowds(seed):
    """Large groups of near copies that drift apart, and many unrelated texts that share most of their words."""
    r = random.Random(seed)
    rows = []
    for size, drift in ((90, 0.0), (70, 0.5)):
        words = [f"v{r.randrange(500)}" for _ in range(80)]
        for _ in range(size):
            own = list(words)
            for _ in range(r.choice([1, 2, 3, 5])):
                own[r.randrange(len(own))] = f"e{r.randrange(9999)}"
            rows.append(" ".join(own))
            if r.random() < drift:
                words[r.randrange(len(words))] = f"d{r.randrange(9999)}"
    passage = [f"p{i}" for i in range(45)]
    rows += [" ".join(passage + [f"u{r.randrange(9999)}" for _ in range(r.choice([3, 8, 15, 25]))]) for _ in range(80)]
    return [(i * 7 % 997, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (3, 80)])
def test_crowds(spark, width, percent, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SETS", 20)
    monkeypatch.setattr(nj, "SKETCHED_SETS", 40)
    rows = crowds(width)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    first, _ = nj.distinct_sets(nj.sets_of(frame, width, percent))
    assert nj.candidate_pairs(first).where("kind > 0").count()  # there are stars
    got = nj.near_duplicates(frame, width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, percent)


@pytest.mark.parametrize("block", [3, 4096])
def test_stars_left_open(spark, monkeypatch, block):
    """Where only stars say what may hang together, blocks find every link but those within a component."""
    monkeypatch.setattr(nj, "BLOCK_SETS", block)
    monkeypatch.setattr(nj, "SKETCHED_SETS", 2 * block)
    rows = crowds(8)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first, _ = nj.distinct_sets(nj.sets_of(frame, 3, 80))
    sizes = nj.common.written(first.select("sid", "doc_id", "text_key", nj.F.col("n_shingles").alias("n"), "sketch"))
    hub = first.agg(nj.F.min("sid")).first()[0]
    stars = first.select(nj.F.col("sid").alias("a"), nj.F.lit(hub).alias("b")).where("a <> b")
    of = {r.sid: r.doc_id for r in first.collect()}
    sets = {s: shingles(dict(rows)[d], 3) for s, d in of.items()}
    links = {(a, b) for a in of for b in of if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    many = sorted(of, key=lambda s: -sum(s in x for x in links))[:40]
    known = {s: min(many) for s in many}
    component = spark.createDataFrame(list(known.items()), "node long, component long")
    found = nj.stars_left(frame, sizes, stars, component, 3, 80).collect()
    def groups(edges):
        label = {s: known.get(s, s) for s in of}
        for a, b in edges:
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        return label

    assert groups((e.a, e.b) for e in found) == groups(links)


def test_sketches_never_overstate():
    r = np.random.default_rng(5)
    for n in (10, 300, 700, 3000, 9000):
        for keep in (0.0, 0.5, 0.9):
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * keep)], r.integers(0, 2**64, int(n * r.uniform(0.1, 1.2)), dtype=np.uint64)]))
            apart = len(np.setxor1d(a, b))
            assert abs(len(a) - len(b)) <= nj.sketches_apart(nj.sketch(a), nj.sketch(b)) <= apart


def test_partial_counts_add_up(spark):
    rows = crowds(5)[:60]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first, _ = nj.distinct_sets(nj.sets_of(frame, 3, 90))
    sets = {r.sid: set(nj.grams(dict(rows)[r.doc_id].encode(), 3).tolist()) for r in first.collect()}
    segments = nj.segments_of(frame, nj.common.written(first.select("sid", "doc_id", "text_key")), 3, 8)
    cut = {}
    for r in segments.collect():
        cut.setdefault(r.sid, {})[r.fragment] = set(x % 2**64 for x in r.grams)
        assert r.before == sum(len(v) for k, v in ((f, g) for f, g in cut[r.sid].items()) if k < r.fragment) and len(r.grams) == len(cut[r.sid][r.fragment])
    assert {s: set().union(*v.values()) for s, v in cut.items()} == sets and {f for v in cut.values() for f in v} == set(range(8))
    pairs = [(a, b, -(-90 * (len(sets[a]) + len(sets[b])) // 190)) for a in sets for b in sets if a < b]
    got = nj.linked(spark.createDataFrame(pairs, "a long, b long, need long"), segments).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a, b, _ in pairs if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])} and got


@pytest.mark.parametrize("percent", [80, 90])
def test_every_link_shares_more_signatures_than_the_slack(percent):
    r = np.random.default_rng(percent)
    known = nj.bands(percent, 4000)
    for n in [4, 5, 6, 9, 10, 11, 19, 20, 47, 100, 200, 333, 500, 1000, 2500]:
        for _ in range(60):
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))  # n-grams are uniform 64-bit hashes
            most = int(len(a) * (100 - percent) / 100)
            b = np.unique(np.concatenate([a[r.permutation(len(a))[: len(a) - most]], r.integers(0, 2**64, max(0, r.integers(0, most + 1) - most // 2), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and len(a) != both:
                slack = max(s for low, s in [(0, 0), *nj.slacks(percent)] if low <= min(len(a), len(b)))
                assert np.intersect1d(nj.signatures(a, percent, known), nj.signatures(b, percent, known)).size > slack


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_repeated_rows_count_once(spark, width, percent):
    """Pairs a little below the threshold, one row of each repeated."""
    rows = []
    for k in range(12):
        words = [f"a{k}x{i}" for i in range(40)]
        other = [w if i % 20 or not i else f"b{k}x{i}" for i, w in enumerate(words[: 40 - k])]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(other))]
    rows += rows
    got = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, percent)


def test_pairs_within_a_star_cluster_are_not_counted_one_by_one(spark, monkeypatch):
    """Near copies of one text around the threshold share signatures in ever other small groups: blocks settle these pairs."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in r.choice(len(words), 4, replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counted, linked = [], nj.linked
    monkeypatch.setattr(nj, "linked", lambda pairs, *more: counted.append(pairs.count()) or linked(pairs, *more))
    got = nj.near_duplicates(frame, 3, 82).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 82)
    assert counted[0] and not any(counted[1:]), counted


@pytest.mark.parametrize("rounds", [1, 3])
def test_rounds_of_nearest_candidates(spark, monkeypatch, rounds):
    monkeypatch.setattr(nj, "MANY", 0)
    monkeypatch.setattr(nj, "ROUNDS", rounds)
    monkeypatch.setattr(nj, "FEW", 200)
    rows = crowds(3)
    got = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 80)
