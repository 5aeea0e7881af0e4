"""Orders cut into ranges: lateness, as-of joins and delivery runs against brute force, whatever the ranges."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tideframe.operators import asof, ranges, realtime

TRADE = "instrument_id string, source string, session string, arrival_seq long, ts_event timestamp, price double, size double"


def moment(seconds):
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc).replace(tzinfo=None)


def trades(n, seed, keys=3):
    r = random.Random(seed)
    return [(f"K{r.randrange(keys)}" if keys > 1 else "HOT", "feed", None if r.random() < 0.1 else "regular", i * 3, moment(60 * i - r.choice([0, 0, 0, 200, 4000])), float(r.randrange(1, 9)), float(r.randrange(1, 5))) for i in range(1, n)]


def lateness(rows, seconds):
    newest, late = {}, set()
    for k, s, session, at, ts, *_ in sorted(rows, key=lambda x: x[3]):
        window = int(ts.replace(tzinfo=dt.timezone.utc).timestamp()) // seconds
        if window < newest.get((k, s, session), window):
            late.add(at)
        newest[k, s, session] = max(window, newest.get((k, s, session), window))
    return late


@pytest.mark.parametrize(("span", "keys"), [(7, 3), (100, 1), (10_000, 2), (None, 3)])
def test_lateness(spark, span, keys, monkeypatch):
    monkeypatch.setattr(ranges, "RANGES", 4)
    rows = trades(400, keys, keys)
    found = realtime.with_lateness(spark.createDataFrame(rows, TRADE).repartition(5), 300, span)
    assert {r.arrival_seq for r in found.where("late").collect()} == lateness(rows, 300)
    assert found.count() == len(rows)


def test_no_task_holds_a_key(spark):
    plan = realtime.with_lateness(spark.createDataFrame(trades(50, 1), TRADE), 300)._jdf.queryExecution().optimizedPlan().toString()
    parts = [re.findall(r"(\w+)#", m) for m in re.findall(r"Window \[.*\], \[([^\]]*)\], \[", plan)]
    assert parts and all(len(p) == len(realtime.BAR_KEY) + 1 for p in parts)


def test_no_trades_and_one_range(spark):
    none = spark.createDataFrame([], TRADE)
    assert realtime.with_lateness(none, 60).count() == 0 and realtime.trade_bars(none, 60).count() == 0
    one = spark.createDataFrame([("A", "f", "regular", 5, moment(0), 1.0, 1.0)] * 2, TRADE)
    assert [r.late for r in realtime.with_lateness(one, 60).collect()] == [False, False]


def test_range_size(spark):
    rows = spark.range(0, 1000, 10).select((F.col("id") + 10**12).alias("at"))
    assert ranges.range_size(rows, F.col("at"), 10) == 99
    assert ranges.range_size(rows.limit(0), F.col("at")) == 1


@pytest.mark.parametrize("span", [3, 50, 10**6, None])
def test_asof_without_tolerance(spark, span, monkeypatch):
    monkeypatch.setattr(ranges, "RANGES", 3)
    r = random.Random(5)
    right = [(r.choice("ab"), moment(t), float(t), None if t % 5 == 0 else f"v{t}") for t in r.sample(range(0, 900), 60)]
    left = [(r.choice(["a", "b", "c"]), i, moment(r.randrange(-50, 1000))) for i in range(200)]
    frames = spark.createDataFrame(left, "k string, id int, t timestamp"), spark.createDataFrame(right, "k string, at timestamp, x double, y string")
    got = {g.id: (g.x, g.y) for g in asof.asof_join(*frames, ["k"], "t", "at", ["x", "y"], span=span).collect()}
    for k, i, t in left:
        before = [(at, x, y) for kk, at, x, y in right if kk == k and at <= t]
        assert got[i] == (max(before)[1:] if before else (None, None))


def test_bars_at_many_points(spark):
    bars = spark.createDataFrame([("P", moment(100), 1.5), ("P", moment(400), 2.5), ("Q", moment(90), 9.0)], "symbol string, bar_time timestamp, close double")
    points = spark.createDataFrame([("P", moment(99)), ("P", moment(400)), ("P", moment(460)), ("P", moment(900)), ("Q", moment(100)), ("R", moment(100)), ("P", moment(400))], "symbol string, as_of timestamp")
    want = [
        ("P", 99, None, None, "missing"), ("P", 400, 2.5, 0, "exact"), ("P", 400, 2.5, 0, "exact"), ("P", 460, 2.5, 60, "prior_within_lookback"),
        ("P", 900, None, None, "missing"), ("Q", 100, 9.0, 10, "prior_within_lookback"), ("R", 100, None, None, "missing"),
    ]
    got = [(r.symbol, moment(0), r.as_of, r.close, r.staleness_seconds, r.match_kind) for r in asof.bars_at(bars, points, 60).collect()]
    assert sorted(((s, int((t - z).total_seconds()), *rest) for s, z, t, *rest in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("span", [4, None])
def test_delivery_runs(spark, span, monkeypatch):
    monkeypatch.setattr(ranges, "RANGES", 2)
    r = random.Random(9)
    events = [(10 + i, f"I{r.randrange(4)}", r.choice(["trade", "quote", "quote", "status"])) for i in range(60) if i % 13]  # some numbers are missing
    subs = [("one", "I0", "trade"), ("one", "I1", "quote"), ("one", "I1", "quote"), ("all", "I2", "trade"), ("idle", "I9", "trade")]
    frames = spark.createDataFrame(events, "sequence long, instrument_id string, event_type string"), spark.createDataFrame(subs, "subscriber string, instrument_id string, event_type string")
    want = sorted((s, n, e if e == "status" or (s, i, e) in subs else "watermark") for s in {x[0] for x in subs} for n, i, e in events)
    assert sorted((x.subscriber, x.sequence, x.delivered) for x in realtime.filtered_delivery(*frames, span).collect()) == want
    runs = sorted((x.subscriber, x.first_sequence, x.last_sequence, x.reason) for x in realtime.delivery_runs(*frames, span).collect())
    assert len(runs) < len(want) and all(a[0] != b[0] or a[2] + 1 == b[1] for a, b in zip(runs, runs[1:], strict=False))
    assert all(not (a[0] == b[0] and a[3] and b[3]) for a, b in zip(runs, runs[1:], strict=False))
    assert "NestedLoop" not in realtime.filtered_delivery(*frames, span)._jdf.queryExecution().executedPlan().toString()
    assert realtime.delivery_runs(frames[0].limit(0), frames[1]).count() == 0
