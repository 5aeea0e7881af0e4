"""Streams against their batch forms."""

import datetime as dt
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from tests.test_ranges import TRADE, lateness, moment, trades
from tideframe.operators import canonical, realtime
from tideframe.streaming import canonical as upkeep
from tideframe.streaming import trades as stream

NUMBERS = ["window", "open", "high", "low", "close", "volume", "trades"]


def run(spark, tmp, batches, seconds, watermark):
    """Each batch as a run of the stream; rows of each run."""
    out = []
    for rows in batches:
        spark.createDataFrame(rows, TRADE).repartition(3).write.mode("append").parquet(f"{tmp}/in")
        source = stream.events_stream(spark, f"{tmp}/in", spark.createDataFrame([], TRADE).schema)
        bars = stream.trade_bar_stream(source, seconds, watermark)
        stream.run_to_end(stream.bars_sink(bars, f"{tmp}/out", f"{tmp}/checkpoint"), spark)
        out.append(spark.read.schema(stream.OUTPUT).parquet(f"{tmp}/out").collect())
    return out


def bars_of(rows):
    return sorted((r.instrument_id, r.session or "", *(r[c] for c in NUMBERS)) for r in rows if r.kind == "bar")


def test_one_hot_key_in_many_frames(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = trades(600, 4, keys=1)
        got = run(spark, tmp_path, [rows[:250], rows[250:251], rows[251:]], 300, "30 days")[-1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.arrival_seq for r in got if r.kind == "late_trade_dropped"} == lateness(rows, 300)
    want = realtime.trade_bars(spark.createDataFrame(rows, TRADE), 300).collect()
    newest = {}
    for r in want:
        newest[r.session] = max(r.window, newest.get(r.session, 0))
    assert bars_of(got) == sorted((r.instrument_id, r.session or "", *(r[c] for c in NUMBERS)) for r in want if r.window < newest[r.session])


def test_timer_closes_and_what_comes_then_is_late(spark, tmp_path):
    a = lambda at, t, p=1.0, key="A": (key, "feed", "regular", at, moment(t), p, 2.0)
    first, second, third, fourth = run(
        spark, tmp_path,
        [[a(1, 10, 5.0), a(2, 50, 7.0)], [a(3, 300, key="B")], [a(4, 59), a(5, 61, 3.0), a(6, 30)], [a(7, 1000, key="B")]],
        60, "0 seconds",
    )
    assert bars_of(first) == []  # nothing has passed the end of A's window
    assert bars_of(second) == [("A", "regular", 0, 5.0, 7.0, 5.0, 7.0, 4.0, 2)]
    late = [(r.arrival_seq, r.window) for r in third if r.kind == "late_trade_dropped"]
    assert late == [(4, 0), (6, 0)]
    assert ("A", "regular", 60, 3.0, 3.0, 3.0, 3.0, 2.0, 1) in bars_of(fourth) and ("B", "regular", 300, 1.0, 1.0, 1.0, 1.0, 2.0, 1) in bars_of(fourth)
    closed = {r.instrument_id: r.closed_through for r in stream.closed_windows(spark, f"{tmp_path}/checkpoint").collect()}
    assert closed["A"] == 120 and closed["B"] >= 360


def test_distinct_trades_within_the_watermark(spark, tmp_path):
    schema = "trade_id string, ts_event timestamp, n int"

    def push(*rows):
        spark.createDataFrame([(i, moment(t), n) for i, t, n in rows], schema).write.mode("append").parquet(f"{tmp_path}/in")
        source = stream.events_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        stream.run_to_end(stream.bars_sink(stream.distinct_trades(source, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
        return sorted((r.trade_id, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert [i for i, _ in push(("x", 1000, 1), ("y", 1000, 1), ("y", 1001, 2))] == ["x", "y"]
    assert push(("x", 1300, 3)) == push(("z", 9000, 4))[:2]  # a repeat within ten minutes
    assert ("x", 5) in push(("x", 9001, 5))  # long after, it is a trade again


RAW = "symbol string, market string, bar_interval string, adjustment string, bar_time timestamp, open double, high double, low double, close double, volume double, amount double, raw_close double, adjustment_factor double, source string, source_sequence string, raw_artifact_id string, content_rank string, observed_at timestamp, ingested_at timestamp"


def raw_bars(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        day = dt.datetime(2023, 1, 1) + dt.timedelta(days=r.randrange(100))
        price = round(5 + r.random(), 2)
        out.append((f"W{r.randrange(5)}", "US", "1d", "raw", day, price, price + 1, price - 1, price, 10.0, None, price, 1.0, r.choice(["sina", "tushare", "other"]), str(i), f"f{i % 3}", f"{i:06d}", day, day + dt.timedelta(hours=i % 5)))
    return out


def test_canonical_upkeep(spark, tmp_path):
    rows = raw_bars(240, 2)
    frame = lambda part: spark.createDataFrame(part, RAW)
    want = canonical.canonical_bars(frame(rows))
    shown = [c for c in want.columns if c != "version"]
    key = lambda df: sorted(map(str, df.select(*shown).collect()))
    for name, step in (("one", 240), ("many", 24)):
        store = f"{tmp_path}/{name}"
        for k, at in enumerate(range(0, 240, step)):
            upkeep.refresh(frame(rows[at : at + step]), k, store, buckets=2)
        assert key(upkeep.read_canonical(spark, store)) == key(want)
    store = f"{tmp_path}/many"
    held = sorted(map(str, upkeep.read_canonical(spark, store).collect()))
    upkeep.refresh(frame(rows[216:]), 9, store, buckets=2)  # the last batch again
    assert sorted(map(str, upkeep.read_canonical(spark, store).collect())) == held
    versions = {r.version for r in upkeep.read_canonical(spark, store).collect()}
    assert min(versions) == 1 and max(versions) > 1
    march = [r for r in rows if r[4].month == 3][:4]
    before = {d for d, *_ in os.walk(f"{store}/canonical")}
    upkeep.refresh(frame(march), 10, store, buckets=2)
    new = {d for d, *_ in os.walk(f"{store}/canonical")} - before
    assert new and all("m202303" in d and d.endswith("build=10") for d in new)
    upkeep.refresh(frame([]), 11, store)
    assert key(upkeep.read_canonical(spark, store)) == key(want)
    # an uncommitted build doesn't count
    upkeep.with_part(want.withColumn("version", F.lit(99).cast("long")), 2).withColumn("build", F.lit(50)).write.mode("append").partitionBy("part", "build").parquet(f"{store}/canonical")
    assert 99 not in {r.version for r in upkeep.read_canonical(spark, store).select("version").distinct().collect()}
    assert upkeep.read_canonical(spark, f"{tmp_path}/none") is None


def test_processor_folds_frames_without_spark():
    class Value:
        def __init__(self):
            self.held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        def __init__(self):
            self.timers = set()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

    handle, processor = Handle(), stream.BarProcessor(10)
    processor.init(handle)
    frame = lambda *rows: pd.DataFrame(rows, columns=["window", "price", "size", "arrival_seq"])
    out = list(processor.handleInputRows(("k", "s", "r"), iter([frame((0, 1.0, 1.0, 1), (0, 3.0, 1.0, 2)), frame((20, 2.0, 1.0, 3), (10, 9.0, 1.0, 4))]), None))
    assert [r[3:5] for r in out[0].itertuples(index=False)] == [("late_trade_dropped", 10), ("bar", 0)]
    assert handle.timers == {30_000} and processor.closed.get() == (10,)
