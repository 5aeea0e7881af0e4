"""The registered queries of this package over a whole small data set, against SQL, libraries or plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tideframe.llm import media, queries
from tideframe.sources.fixtures import TABLES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return {d: t or "" for d, t in duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()}


def rows(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, DATA).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    relation = duck.sql(queries.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in relation.fetchall())))


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))


def test_op2(spark, texts):
    got = rows(spark, "op2_media")
    assert got.keys() == texts.keys()
    features = {}
    for d, t in texts.items():
        r, data = got[d], t.encode()
        payload = media.padded(data)
        stored = media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert features.setdefault(t, r.feature) == r.feature


def test_op3(spark, texts):
    got = rows(spark, "op3_quality_rules")
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        words, seen, repeated = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            repeated += line in seen and bool(WORD.search(line))
            seen.add(line)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(inside))
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_op5(spark, texts):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op5_byte_bpe")
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = encoding.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op6(spark, duck, texts):
    got = rows(spark, "op6_mixing")
    source = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    assert got.keys() == texts.keys()
    sizes, taken, longest = Counter(), Counter(), {}
    for d, t in texts.items():
        n = len(WORD.findall(t))
        assert got[d].size == n and 0 <= got[d].taken <= 3 * n
        sizes[source[d]] += n
        taken[source[d]] += got[d].taken
        longest[source[d]] = max(n, longest.get(source[d], 0))
    assert sum({source[d]: got[d].target for d in texts}.values()) == pytest.approx(sum(sizes.values()))
    for d in texts:
        s = source[d]
        assert got[d].source_size == sizes[s] and got[d].target <= 3 * sizes[s] + 1e-6 and abs(taken[s] - got[d].target) <= longest[s]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_op7(spark, texts):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(re.sub("[^0-9]", "", x)) <= 19 and luhn(re.sub("[^0-9]", "", x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
    }
    got = rows(spark, "op7_pii")
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])] for k, (p, ok) in kinds.items()}
        base = ",".join(s for k in kinds for s in spans[k])
        r = got[d]
        assert [r[f"n_{k}"] for k in kinds] == [len(spans[k]) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


def test_op8(spark, texts):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True  # strings of special tokens are ordinary text
    got, start = rows(spark, "op8_ans_files"), 0
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op9(spark, texts):
    window, power = 200, np.uint64(0x9E3779B97F4A7C15)
    codes = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
    data = {d: np.frombuffer(t.encode(), np.uint8) for d, t in texts.items()}
    hashes = {}
    with np.errstate(over="ignore"):
        weights = power ** np.arange(window - 1, -1, -1, dtype=np.uint64)
        for d, x in data.items():
            if len(x) >= window:
                own, total = codes[x], np.zeros(len(x) - window + 1, np.uint64)
                for i in range(window):
                    total += own[i : len(x) - window + 1 + i] * weights[i]
                hashes[d] = total
    values, counts = np.unique(np.concatenate(list(hashes.values())), return_counts=True)
    again = values[counts > 1]
    got = rows(spark, "op9_suffix_dedup")
    assert got.keys() == texts.keys() and len(again)
    for d, x in data.items():
        gone = np.zeros(len(x) + 1, np.int64)
        for i in np.flatnonzero(np.isin(hashes[d], again)) if d in hashes else []:
            gone[i] += 1
            gone[i + window] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(x), int(covered.sum()), spans, hashlib.sha256(x[~covered].tobytes()).hexdigest())


def test_op11(spark, duck):
    known = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in known], object)
    n = len(x)
    d = n * x - x.sum(0)
    c = d.astype(float) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:32], q[:, ::-1][:, :32]
    want = c @ q / np.sqrt(e)
    got = sorted(queries.QUERIES["op11_whitening"](spark, DATA).collect(), key=lambda r: (r.vec_id, r.component))
    z = np.array([r.whitened for r in got]).reshape(n, 32)
    assert [r.vec_id for r in got[::32]] == [i for i, _ in known] and {r.n for r in got} == {n}
    assert np.abs(z * np.sign((z * want).sum(0)) - want).max() < 1e-9
    assert [r.deviation for r in got[::32]] == [int(s) for s in (d * d).sum(1)]
    assert np.allclose([r.explained for r in got[:32]], e / np.trace(v), rtol=1e-10) and got[0].identity_error < 1e-10
