import base64
import gzip
import hashlib
import io
import json

from tideframe.llm import common, warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3 x\r\ny", "é" * 40_000), (4, None, None), (5, "http://a/5", ""), (None, "http://a/n", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (None, "http://b", "only null"), (9, "http://a/9", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n")]


def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")


def test_round_trip_and_revisits(spark):
    got = warc.read_records(warc.archive_pages(pages(spark).repartition(3))).collect()
    assert len(got) == len(ROWS)
    keeper = {}
    for page_id, _, html in ROWS:
        keeper[html or ""] = max((x for x in (keeper.get(html or ""), page_id) if x is not None), default=None)
    want = []
    for page_id, _, html in ROWS:
        data, best = (html or "").encode(), keeper[html or ""]
        revisit = best is not None and page_id != best
        want.append(str((page_id, len(data), digest(data), "revisit" if revisit else "response", best if revisit else None, None if revisit else data)))
    assert sorted(want) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got)


def test_members_and_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 100)
    folder = common.shared_dir(spark)
    ranges = warc.archive_pages(pages(spark).coalesce(1), folder)
    row = ranges.first()
    store, path = common.files(row.archive)
    data = store.open_input_stream(path, compression=None).read()
    store, path = common.files(row["index"])
    lines = [json.loads(x) for x in store.open_input_stream(path).read().splitlines()]
    assert sum(x["length"] for x in lines) == len(data)
    for x in lines:  # each member inflates alone and is one record
        member = gzip.decompress(data[x["offset"] : x["offset"] + x["length"]])
        assert member.startswith(b"WARC/1.1\r\n") and x["id"].encode() in member
    whole = b"".join(warc.inflated(io.BytesIO(data), 64))
    assert len(list((h, b"".join(c)) for h, c in warc.records_of(iter([whole])))) == len(lines)


def test_archives_roll_over_and_ranges_know_their_lines(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 2)
    folder = common.shared_dir(spark)
    archives = warc.write_monolithic(warc.with_revisits(pages(spark).coalesce(1)), f"{folder}/crawl", most=600)
    assert archives.count() > 2 and archives.agg({"records": "sum"}).first()[0] == len(ROWS)
    ranges = warc.normalise(archives, f"{folder}/normal")
    for r in ranges.collect():
        store, path = common.files(r["index"])
        assert len(store.open_input_file(path).read_at(r["bytes"], r["at"]).splitlines()) == r.records <= 2
    assert warc.read_records(ranges).count() == len(ROWS)


def test_small_payloads_can_be_exempt_and_empty_tables(spark):
    kinds = {r.page_id: r.refers_to for r in warc.with_revisits(pages(spark), min_bytes=5).collect()}
    assert kinds[4] is None and kinds[1] == 2
    assert warc.read_records(warc.archive_pages(pages(spark).limit(0))).count() == 0
