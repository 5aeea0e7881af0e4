import hashlib
import struct
import zlib

import pytest

from tideframe.llm import media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 64, 192 * 65, 50_000])
def test_stored_bytes_come_back(n):
    payload = media.padded(bytes(i * 7 % 251 for i in range(n)))
    assert len(payload) % 192 == 0 and len(payload) >= 192
    data = media.encode(payload)
    found, ranges = media.parse(data)
    assert b"".join(data[a : a + k] for a, k in ranges) == payload
    assert found["samples"] == len(payload) // 192 == found["duration"] and found["codec"] == "raw " and found["handler"] == "vide"
    assert [k["sample"] for k in found["keyframes"]] == list(range(1, found["samples"] + 1, media.KEY_EVERY))


def test_other_tables(spark):
    sizes, data = [3, 5, 7], b"aaabbbbbccccccc"
    head = media.box(b"ftyp", b"isom", bytes(4))

    def file(base, stz2=False):
        table = media.box(
            b"stbl",
            media.full(b"stsd", 0, 0, struct.pack(">I", 1), media.box(b"twos", bytes(28))),
            media.full(b"stts", 0, 0, struct.pack(">III", 1, 3, 10)),
            media.full(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, 2, 1)),
            media.full(b"stz2", 0, 0, struct.pack(">II", 4, 3), bytes([0x35, 0x70])) if stz2 else media.full(b"stsz", 0, 0, struct.pack(">II", 0, 3), struct.pack(">III", *sizes)),
            media.full(b"co64", 0, 0, struct.pack(">IQQ", 2, base, base + 8)),
        )
        mdhd = media.full(b"mdhd", 1, 0, struct.pack(">QQIQ", 0, 0, 8000, 30))
        hdlr = media.full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(13))
        return head + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, hdlr, media.box(b"minf", table)))) + struct.pack(">I4s", 0, b"mdat") + data

    for stz2 in (False, True):
        base = len(file(0, stz2)) - len(data)
        found, ranges = media.parse(file(base, stz2))
        assert ranges == [(base, 3), (base + 3, 5), (base + 8, 7)] and found["timescale"] == 8000 and found["duration"] == 30
        assert len(found["keyframes"]) == 3  # no stss: all are


def test_frames_with_broken_files_nulls_and_clashing_columns(spark):
    rows = [(1, "text é", "a"), (2, None, "b"), (3, "", "c"), (1, "text é", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codec string")
    got = media.feature(media.describe(media.store(docs))).collect()
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        payload = media.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.error is None and r.feature.startswith("codec=raw|size=16x12|")
    good = media.encode(media.padded(b"x" * 500))
    broken = [b"", b"no media at all", good[:300], good[:-5], good.replace(b"stsz", b"stss"), None, bytearray(good[:40])]
    frame = spark.createDataFrame([(i, None if b is None else bytes(b)) for i, b in enumerate(broken)], "doc_id long, media binary")
    assert all(r.error and r.codec is None and r.feature.startswith("error=") for r in media.feature(media.describe(frame)).collect())
    assert media.describe(media.store(docs.limit(0))).count() == 0


def test_tables_that_claim_too_much():
    good = media.encode(media.padded(b"x" * 500))
    size, n = good.index(b"stsz") + 8, good.index(b"stsz") + 12
    for much in (5_000_000, 2**32 - 1):
        with pytest.raises(ValueError, match="longer than the file"):
            media.parse(good[:n] + struct.pack(">I", much) + good[n + 4 :])
        with pytest.raises(ValueError):
            media.parse(good[:size] + struct.pack(">II", 0, much) + good[size + 8 :])
    key = good.index(b"stss") + 12
    for bad in (0, 2**32 - 1):
        with pytest.raises(ValueError, match="keyframe"):
            media.parse(good[:key] + struct.pack(">I", bad) + good[key + 4 :])
    run = good.index(b"stsc") + 12
    for bad in (0, 2**32 - 1):
        with pytest.raises(ValueError, match="run of chunks"):
            media.parse(good[:run] + struct.pack(">I", bad) + good[run + 4 :])


def test_chunks_that_point_at_one_place_are_refused():
    """A file of 10 MB whose samples all claim the same megabyte: an error at once, not hours of hashing."""
    import struct
    import time

    n = 600_000
    size = 1 << 20
    entry = media.box(b"raw ", bytes(70))
    table = media.box(
        b"stbl",
        media.full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        media.full(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, 1, 1)),
        media.full(b"stsz", 0, 0, struct.pack(">II", 0, n), struct.pack(">I", size) * n),
        media.full(b"stco", 0, 0, struct.pack(">I", n), bytes(4 * n)),
    )
    mdhd = media.full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, 1, n, 0, 0))
    data = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", table)))) + media.box(b"mdat", bytes(5 << 20))
    began = time.perf_counter()
    with pytest.raises(ValueError, match="longer than the file"):
        media.parse(data)
    assert len(data) > 9 << 20 and time.perf_counter() - began < 5


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = media.describe(media.store(docs)).collect()
    assert len(got) == 3 and len({r.media_sha256 for r in got}) == 2 and {r.payload_bytes for r in got} == {192}
    assert media.describe(media.store(docs.limit(0))).count() == 0
