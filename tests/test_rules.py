"""Rules of bars, quotes, calendars, exposure, instruments and datasets on hand-made rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_streams import RAW, raw_bars
from tideframe.operators import canonical, fundamentals, inventory, quotes, realtime, reference_data, versions

T = dt.datetime(2031, 3, 9, 8, 30)


def one(spark, *values):
    """A column of values (texts or numbers) with a number n."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, v string")


def given(frame, column):
    return [r[0] for r in frame.orderBy("n").select(column).collect()]


def test_us_dates(spark):
    rows = one(spark, "Mar 5, 2034", "March 5 2034", "Released March 5", "2034-03-05", "on 2034/3/5.", "Quarter 5, 2034", "Feb 30, 2034", "sept 3, 2034", "DEC 31 2034", "nothing", None, "1999-01-01")
    assert given(rows, reference_data.parse_us_date(F.col("v"), F.lit(2023))) == ["2034-03-05", "2034-03-05", "2023-03-05", "2034-03-05", "2034-03-05", None, None, None, "2034-12-31", None, None, None]
    assert given(one(spark, "8:30 AM", "8:30 a.m. EST", "12 PM", "12:05 am", "2 pm", "noon"), reference_data.parse_us_time(F.col("v"))) == ["08:30:00", "08:30:00", "12:00:00", "00:05:00", "14:00:00", None]


def test_short_dates(spark):
    rows = one(spark, "20310430", "310430", "810430", "20310430.0", "80430", "0", None, "x", "123456789")
    assert given(rows, fundamentals.short_date(F.col("v"))) == ["2031-04-30", "2031-04-30", "1981-04-30", "2031-04-30", None, None, None, None, None]


def test_changes_keep_their_sign(spark):
    rows = spark.createDataFrame([("s", 1, -2.0), ("s", 2, -1.0), ("t", 1, 0.0), ("t", 2, 3.0), ("u", 1, 4.0)], "series string, observed_on int, value double")
    got = {r.series: (r.change, r.change_pct) for r in reference_data.indicator_change(rows).collect()}
    assert got == {"s": (1.0, -50.0), "t": (3.0, None), "u": (None, None)}


def test_two_sources_of_an_event_are_two(spark):
    rows = spark.createDataFrame([("US", "2031-07-01", "08:30:00", "CPI &amp; more", "bureau"), ("US", "2031-07-01", "08:30:00", " cpi &  MORE ", "bureau"), ("US", "2031-07-01", "08:30:00", "CPI & more", "press"), ("XX", "2031-07-01", "8:30", "CPI", "press")], "market string, event_date string, event_time string, event_name string, source string")
    got = reference_data.normalize_event(rows).collect()
    assert got[0].event_id == got[1].event_id != got[2].event_id
    assert (got[0].scheduled_at, got[3].scheduled_at, got[3].time_zone) == (dt.datetime(2031, 7, 1, 12, 30), None, "UTC")


def test_earnings(spark):
    rows = [("cn", "sz 1", None, "2031-01-02", "16:00:00"), ("HK", "700", "Deep Sea", "2031-01-02", "after close"), ("hk", "DEEP", "", "2031-01-02", None), ("US", "tide", "Tide", "2031-01-02", "16:00:00")]
    frame = spark.createDataFrame([(*r, "Q1", "", None, "list") for r in rows], "market string, symbol string, name string, report_date string, report_time string, fiscal_period string, eps_forecast string, previous_eps string, source string")
    got = [(r.market, r.symbol, r.name, r.time_zone, r.scheduled_at) for r in reference_data.normalize_earnings(frame).select("market", "symbol", F.col("name"), "time_zone", "scheduled_at").collect()]
    assert got == [("CN", "000001", "000001", "Asia/Shanghai", dt.datetime(2031, 1, 2, 8)), ("HK", "00700", "Deep Sea", "Asia/Hong_Kong", None), ("HK", "DEEP", "DEEP", "Asia/Hong_Kong", None), ("US", "TIDE", "Tide", "America/New_York", dt.datetime(2031, 1, 2, 21))]


def test_health_after_a_success(spark):
    rows = spark.createDataFrame([("p", 1, T, False, "boom"), ("p", 2, T + dt.timedelta(1), True, None), ("q", 1, T, True, None), ("q", 2, T + dt.timedelta(1), False, "one"), ("q", 3, T + dt.timedelta(2), False, "two")], "provider string, attempt_no int, attempted_at timestamp, success boolean, error string")
    got = {r.provider: (r.status, r.last_error, r.consecutive_failures, r.last_attempt_at, r.last_success_at) for r in reference_data.provider_health(rows).collect()}
    assert got == {"p": ("healthy", None, 0, T + dt.timedelta(1), T + dt.timedelta(1)), "q": ("unhealthy", "two", 2, T + dt.timedelta(2), T)}


def test_closes_and_sessions(spark):
    rows = spark.createDataFrame([([1.0, None, 2.0, None], 9.0, None, 7.0), ([None], 9.0, 8.0, 7.0), ([], None, None, None)], "closes array<double>, meta_price double, meta_previous double, chart_previous double")
    assert [(r.price, r.previous) for r in quotes.last_nonnull_close(rows).collect()] == [(2.0, 7.0), (9.0, 8.0), (None, None)]
    label = quotes.session_label(F.col("v").cast("int"), [("pre_market", F.lit(1), F.lit(3)), ("regular", F.lit(3), F.lit(9))])
    assert given(one(spark, "3", "4", "10", None), label) == ["pre_market", "regular", "closed", "unknown"]
    frame = spark.createDataFrame([("Normal",), ("",), (None,), ("PreMarket",), ("POST",), ("Overnight",), ("Auction",), ("over",)], "raw_session string")
    assert [(r.session, r.rejected) for r in realtime.session_filter(frame).collect()] == [("regular", False)] * 3 + [("pre_market", False), ("post_market", False), ("overnight", True), ("unknown", False), ("unknown", False)]
    assert not realtime.session_filter(frame, overnight=True).where("rejected").count()


def test_trade_ids(spark):
    import hashlib
    import json

    rows = [("T.X", "2031-03-09T08:30:00Z", "1.50", "300", "BuyUp", 2), ("T.X", "2031-03-09T08:30:00Z", "1.50", "300", "Sell", 2), ("T.X", "2031-03-09T08:30:00Z", "1.50", "300", "Up", 2)]
    got = realtime.trade_id(spark.createDataFrame(rows, "symbol string, ts_text string, price_text string, volume_text string, direction string, batch_index int")).collect()
    want = ["longport:" + hashlib.sha256(json.dumps({"symbol": s, "timestamp": t, "price": p, "volume": v, "direction": d, "index": i}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for s, t, p, v, d, i in rows]
    assert [r.trade_id for r in got] == want and [r.aggressor_side for r in got] == ["BUYER", "SELLER", "NO_AGGRESSOR"]


def test_content_ranks_of_all_digits(spark):
    schema = "n int, x decimal(24,4)"
    a, b, c = (versions.content_rank(spark.createDataFrame([(1, Decimal(x))], schema), ("x",), ()).first().content_rank for x in ("12345678901234567.1000", "12345678901234567.2000", "12345678901234567.1"))
    assert a == c != b
    number = lambda kind, x: versions.content_rank(spark.createDataFrame([(x,)], f"x {kind}"), ("x",), ()).first().content_rank
    assert number("double", 10.5) == number("decimal(10,4)", Decimal("10.5")) == number("decimal(10,1)", Decimal("10.5"))
    assert number("double", 1e7) == number("decimal(10,1)", Decimal("10000000")) == number("long", 10_000_000) and number("double", -0.0) == number("long", 0)
    assert len({number("double", x) for x in (1e-20, 1e300, 0.1, 0.1 + 1e-17, 100.0, 10.0)}) == 6
    with pytest.raises(Exception, match="finite"):
        number("double", float("inf"))


def test_a_rebuild_says_what_it_scanned(spark):
    raw = spark.createDataFrame(raw_bars(90, 1), RAW)
    whole = canonical.observed_rebuild(raw).collect()
    built = canonical.canonical_bars(raw)
    assert {(r.scanned_rows, r.scanned_groups, r.truncated) for r in whole} == {(90, built.count(), False)}
    assert sorted((r.quality_status, r.selected_source, r.groups) for r in whole) == sorted((r.quality_status, r.selected_source, r.groups) for r in canonical.rebuild_summary(built).collect())
    assert [tuple(r) for r in canonical.observed_rebuild(raw, limit=89).collect()] == [(None, None, 0, 0, 90, 0, True)]
    assert canonical.observed_rebuild(raw, limit=90).count() == len(whole) and canonical.observed_rebuild(raw.limit(0)).count() == 0


QUOTE = "symbol string, market string, source string, source_url string, currency string, quote_at timestamp, observed_at timestamp, ingested_at timestamp"


def test_fragments_and_exposure(spark):
    late = T + dt.timedelta(hours=1)
    q = spark.createDataFrame([("600123.SH", "CN", "wire", "https://example.org", "CNY", T, T, late), ("00055.HK", "HK", "wire", "", "HKD", None, T, None), ("600124.SH", "CN", "wire", None, None, None, None, None)], QUOTE)
    f = spark.createDataFrame([("600123", "20301231", "Harbours", T), ("300200", "20301231", " ", T), ("00055", "20301231", "Ships", T)], "symbol string, report_period string, industry string, ingested_at timestamp")
    got = {r.symbol: r for r in reference_data.repository_fragment(q, f, F.lit(late)).collect()}
    assert sorted(got) == ["00055.HK", "300200.SZ", "600123.SH", "600124.SH"]  # no A share has the code 00055
    both, only_f, only_q, bare = got["600123.SH"], got["300200.SZ"], got["00055.HK"], got["600124.SH"]
    assert (both.asset_type, both.currency, both.as_of, both.classifications[0].value, both.classifications[0].scheme) == ("equity", "CNY", T, "Harbours", "eastmoney_basic_industry")
    assert both.evidence[0].asDict() == {"source_id": "wire", "source_url": "https://example.org", "source_record_id": None, "fetched_at": late, "effective_at": T, "source_tier": "primary_market_data", "confidence": "reported"}
    assert (only_f.asset_type, only_f.market, only_f.classifications, only_f.evidence[0].source_id, only_f.evidence[0].source_record_id, only_f.evidence[0].source_tier) == ("equity", "CN", [], "fundamental_snapshot", "fundamental_snapshot:20301231:300200", "primary_filing_aggregation")
    assert (only_q.asset_type, only_q.market, only_q.as_of, only_q.evidence[0].source_record_id) == ("unknown", "HK", T, "fundamental_snapshot:latest:00055")
    assert bare.as_of == late and bare.asset_type == "unknown"

    own = reference_data.repository_fragment(q, f, F.lit(late)).withColumns({"priority": F.lit(0), "source": F.lit("own")})
    more = own.where("symbol <> '300200.SZ'").withColumns({"priority": F.lit(1), "source": F.lit("issuer"), "asset_type": F.when(F.col("symbol") == "00055.HK", "etf").otherwise("fund"), "company_materials": F.array(F.lit("annual report")), "holdings": F.when(F.col("symbol") != "600124.SH", "ten names"), "classifications": F.lit(None).cast(own.schema["classifications"].dataType)})
    out = {r.symbol: r for r in reference_data.merge_exposure(own.unionByName(more)).collect()}
    assert {k: (r.asset_type, r.holdings_status, r.holdings, r.company_materials_status, len(r.evidence)) for k, r in out.items()} == {
        "600123.SH": ("equity", "not_applicable", None, "available", 2), "300200.SZ": ("equity", "not_applicable", None, "unavailable", 1),
        "00055.HK": ("etf", "available", "ten names", "available", 2), "600124.SH": ("fund", "unavailable", None, "available", 2),
    }
    assert [c.value for c in out["600123.SH"].classifications] == ["Harbours"]


def test_instruments(spark):
    good = dict(instrument_id="TIDE.XABC", symbol="TIDE", mic="XABC", market="US", currency="USD", price_precision=2, size_precision=0, tick_size="0.01", lot_size="100", size_increment="1", ts_event=1, ts_init=1)
    cases = [({}, []), ({"tick_size": "0.0"}, ["invalid_tick_size"]), ({"tick_size": ".5"}, ["invalid_tick_size"]), ({"lot_size": "-1"}, ["invalid_lot_size"]), ({"market": "EU"}, ["invalid_market"]), ({"currency": None}, ["invalid_currency"]), ({"ts_event": 2}, ["clock_order"]), ({"size_precision": 1, "size_increment": "10"}, ["invalid_size_precision", "invalid_size_increment"]), ({"mic": "xabc"}, ["id_mismatch", "invalid_mic"])]
    frame = spark.createDataFrame([(i, *(good | c).values()) for i, (c, _) in enumerate(cases)], "n int, instrument_id string, symbol string, mic string, market string, currency string, price_precision int, size_precision int, tick_size string, lot_size string, size_increment string, ts_event int, ts_init int")
    assert [r.errors for r in reference_data.instrument_check(frame).orderBy("n").collect()] == [e for _, e in cases]


@pytest.mark.parametrize("span", [1, 2, None])
def test_pages_against_their_manifest(spark, span):
    at = lambda h: T + dt.timedelta(hours=h)
    rows = [("A", 0), ("B", 0), ("A", 1), ("A", 1), ("B", 0), ("C", 2), ("A", 9), ("B", 9)]
    frame = spark.createDataFrame([("d", i * 3, k, "1h", "raw" if i != 7 else "qfq", at(h)) for i, (k, h) in enumerate(rows)] + [("x", 0, "A", "1h", "raw", at(0))], "dataset_id string, position int, instrument_id string, interval string, adjustment string, window_start timestamp")
    manifests = spark.createDataFrame([("d", ["A", "B"], "1h", "raw", at(0), at(5))], "dataset_id string, instruments array<string>, interval string, adjustment string, start timestamp, end timestamp")
    got = sorted((r.dataset_id, r.position, r.rule) for r in inventory.manifest_check(frame, manifests, span).collect())
    assert [g for g in got if g[0] == "d"] == sorted([("d", 9, "not_strictly_ascending"), ("d", 12, "not_strictly_ascending"), ("d", 15, "instrument_outside_manifest"), ("d", 18, "window_outside_manifest"), ("d", 21, "window_outside_manifest"), ("d", 21, "interval_or_adjustment_differs")])
    assert {g[2] for g in got if g[0] == "x"} == {"instrument_outside_manifest", "interval_or_adjustment_differs", "window_outside_manifest"}
    headers = spark.createDataFrame([(2, 2, 10, False, None), (3, 2, 10, False, None), (9, 9, 5, True, None), (1, 1, 6000, False, "c")], "count int, rows int, page_size int, truncated boolean, next_cursor string")
    assert [r.errors for r in inventory.page_header_check(headers).collect()] == [[], ["count_differs"], ["page_too_large", "cursor_without_rest"], ["invalid_page_size", "cursor_without_rest"]]


def test_ids_of_datasets(spark):
    import hashlib
    import json

    row = spark.createDataFrame([("T.X", "1d", "raw", 3, T, "ab" * 32)], "symbol string, bar_interval string, adjustment string, rows long, newest timestamp, content_sha256 string")
    got = inventory.with_dataset_ids(row, "2031-01-01T00:00:00+00:00", "2031-02-01T00:00:00+00:00").first()
    asked = {"symbol": "T.X", "interval": "1d", "adjustment": "raw", "start": "2031-01-01T00:00:00+00:00", "end": "2031-02-01T00:00:00+00:00"}
    millis = int(T.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got.newest_millis == millis and got.dataset_id == digest(asked)[:24]
    assert got.snapshot_id == digest(asked | {"row_count": 3, "max_ingested_millis": millis, "content_hash": "sha256:" + "ab" * 32})[:32]


def test_differences_in_normal_form(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2, 0.0, "x"), (2, 1.0, 1.0, "y")], "k int, u double, v double, w string")
    b = spark.createDataFrame([(1, 0.3, -0.0, "x"), (2, 1.001, 1.0, "z")], "k int, u double, v double, w string")
    got = sorted((r.k, r.field) for r in inventory.dataset_diff(a, b, ["k"], ["u", "v", "w"]).collect())
    assert got == [(2, "u"), (2, "w")]


def test_funnel_in_percent_of_a_loss(spark):
    tdx = spark.createDataFrame([("000042", f"{y}1231", 9.0 + y % 3, 50.0 * 1.2 ** (y - 2028), None, -4.0, 6.0, 90.0, 27.0, 18.0, 3.0, 5.0) for y in (2028, 2029, 2030)], "symbol string, report_period string, roe_weighted double, revenue_ttm double, revenue double, net_profit_parent double, net_profit_parent_ttm double, total_assets double, total_liabilities double, cash double, operating_cashflow double, capex double")
    fund = spark.createDataFrame([("000042", "n", "i", True, "20310331", 33.0, 2.5)], "symbol string, name string, industry string, is_active boolean, report_period string, pe_dynamic double, pb double")
    bao = lambda *rows: spark.createDataFrame(rows, "symbol string, report_period string, trade_date string, pe_ttm double, pb_mrq double")
    none = spark.createDataFrame([], "symbol string, report_period string, status string")
    row = fundamentals.funnel_metrics(fund, tdx, bao(("000042", "20301231", "2031-01-05", None, 1.5)), none).first()
    assert (row.ocf_to_profit_latest_annual, row.ocf_to_profit_total, row.cash_to_assets_latest, row.debt_ratio_latest) == (-75.0, -75.0, 20.0, 30.0)
    assert row.revenue_cagr_pct == pytest.approx(20) and row.fcf_latest_annual == -2.0 and row.roe_annual_median == 10.0
    assert (row.pe_for_filter, row.pe_source, row.pb_for_filter, row.pb_source) == (33.0, "eastmoney_pe_dynamic", 1.5, "baostock_pb_mrq")
    assert row.quality_status == "multi_source_pending_validation"  # there is a row of valuations, though without a ratio
    assert fundamentals.funnel_metrics(fund, tdx, bao(), none).first().quality_status == "history_ready_valuation_single_source"
    differs = spark.createDataFrame([("000042", "20301231", "difference_over_1pct")], none.schema)
    assert fundamentals.funnel_metrics(fund, tdx, bao(), differs).first().quality_status == "cross_source_difference_over_1pct"
    assert fundamentals.funnel_metrics(fund, tdx.where("report_period > '20290101'"), bao(), none).first().quality_status == "insufficient_annual_history"
    assert fundamentals.funnel_metrics(fund, tdx.limit(0), bao(), none).first().quality_status == "missing_tdx_latest"
    assert fundamentals.screen_funnel(fundamentals.funnel_metrics(fund, tdx, bao(), none), min_roe_median=10, max_pe=33, max_debt_ratio=30, min_annual_periods=3).count() == 1


def test_matrices_of_a_stated_size(spark, monkeypatch):
    from tideframe.operators import bars

    monkeypatch.setattr(bars, "ROW_SYMBOLS", 1)
    rows = spark.createDataFrame([("A", T, 1.5), ("B", T, 2.5), ("A", T + dt.timedelta(1), 3.5)], "symbol string, bar_time timestamp, close double")
    points, names = rows.select("bar_time"), spark.createDataFrame([("A",), ("C",), ("A",)], "symbol string")
    frame = bars.dense_matrix(rows, points, names)
    assert sorted((r.symbol, r.close) for r in frame.collect() if r.close) == [("A", 1.5), ("A", 3.5)] and frame.count() == 4
    assert "NestedLoop" not in frame._jdf.queryExecution().executedPlan().toString()
    for more in ({"most_points": 1}, {"most_symbols": 1}, {"most_cells": 3}):
        with pytest.raises(ValueError, match="at most"):
            bars.dense_matrix(rows, points, names, **more)
    assert bars.dense_matrix(rows, points, names.limit(0)).count() == 0


def test_a_rebuild_joins_old_and_new_once(spark):
    raw = spark.createDataFrame(raw_bars(120, 3), RAW)
    early = raw.where("content_rank < '000060'")
    existing = canonical.canonical_bars(early).withColumn("version", F.lit(3).cast("long"))
    late = raw.where("content_rank >= '000060'")
    got = {(r.symbol, r.bar_time): r for r in canonical.incremental_rebuild(raw, existing, canonical.dirty_ranges(late)).collect()}
    want = {(r.symbol, r.bar_time): r for r in canonical.canonical_bars(raw).collect()}
    old = {(r.symbol, r.bar_time): r for r in existing.collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert (r.source, r.close, r.input_fingerprint, r.source_count) == (want[key].source, want[key].close, want[key].input_fingerprint, want[key].source_count)
        assert r.version == (1 if key not in old else 3 if old[key].input_fingerprint == r.input_fingerprint else 4)
    assert {r.version for r in got.values()} == {1, 3, 4}
