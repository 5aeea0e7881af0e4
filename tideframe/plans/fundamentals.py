"""Queries over fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import asof, fundamentals, versions
from tideframe.plans.registry import query
from tideframe.sources.fixtures import table, view

AS_OF = "1998-06-30"


def revised(name: str, source: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY symbol, report_period ORDER BY ingested_at DESC, version_id DESC) = 1)"


def known(as_of: str) -> str:
    return f"published_at <= '{as_of}' AND CAST(observed_at AS DATE) <= DATE '{as_of}'"


NOW_SQL = ", ".join([revised("f", "fx_fund_hist"), revised("t", "fx_tdx_hist"), revised("b", "fx_bao")])
PIT_SQL = ", ".join([revised("f", "fx_fund_hist", known(AS_OF)), revised("t", "fx_tdx_hist", known(AS_OF)), revised("b", "fx_bao", f"CAST(ingested_at AS DATE) <= DATE '{AS_OF}'")])
LINES = " UNION ALL ".join(
    f"SELECT symbol, report_period, '{m}' AS metric, 'eastmoney' AS source_a, '{s}' AS source_b, CAST(f.{a} AS DOUBLE) AS value_a, CAST({s[0]}.{c} AS DOUBLE) AS value_b FROM f LEFT JOIN {s[0]} USING (symbol, report_period)"
    for m, a, s, c in fundamentals.PAIRS
)
DIFF = "CASE WHEN value_a IS NULL OR value_b IS NULL OR value_a = 0 THEN NULL ELSE abs(value_a - value_b) / abs(value_a) * 100 END"
VALID = f"lines AS ({LINES}), v AS (SELECT *, CASE WHEN d IS NULL THEN 'missing_comparison' WHEN d <= 1 THEN 'consistent' ELSE 'difference_over_1pct' END AS status FROM (SELECT *, {DIFF} AS d FROM lines))"
POWER = "CASE WHEN {0}_last > 0 AND {0}_first > 0 AND span > 0 THEN (power({0}_last / {0}_first, 1e0 / span) - 1) * 100 END"
FUNNEL = f"""{VALID},
cf AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) = 1),
lt AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) = 1),
lb AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC NULLS FIRST, report_period DESC) = 1),
h AS (SELECT symbol, quantile_cont(roe_weighted, 0.5) AS median, min(roe_weighted) AS low, count(*) AS n, min(report_period) AS s, max(report_period) AS e,
  arg_min(revenue_ttm, report_period) FILTER (revenue_ttm IS NOT NULL) AS r_first, arg_max(revenue_ttm, report_period) FILTER (revenue_ttm IS NOT NULL) AS r_last,
  arg_min(net_profit_parent_ttm, report_period) FILTER (net_profit_parent_ttm IS NOT NULL) AS p_first, arg_max(net_profit_parent_ttm, report_period) FILTER (net_profit_parent_ttm IS NOT NULL) AS p_last,
  CAST(max(report_period)[1:4] AS DOUBLE) - CAST(min(report_period)[1:4] AS DOUBLE) AS span,
  arg_max({{'o': operating_cashflow, 'x': capex, 'p': coalesce(net_profit_parent, net_profit_parent_ttm)}}, report_period) AS la, sum(CAST(operating_cashflow AS DECIMAL(24, 4))) AS ocf, sum(CAST(coalesce(net_profit_parent, net_profit_parent_ttm) AS DECIMAL(24, 4))) AS profit
  FROM t WHERE report_period LIKE '%1231' GROUP BY symbol),
c AS (SELECT symbol, report_period, count(*) FILTER (status = 'consistent') AS same, count(*) FILTER (status = 'difference_over_1pct') AS differ FROM v GROUP BY ALL),
m AS (SELECT cf.symbol, cf.name, cf.industry, cf.is_active, cf.report_period, lt.report_period AS tdx_period, coalesce(lb.pe_ttm, cf.pe_dynamic) AS pe_for_filter,
  CASE WHEN lb.pe_ttm IS NOT NULL THEN 'baostock_pe_ttm' ELSE 'eastmoney_pe_dynamic' END AS pe_source, coalesce(lb.pb_mrq, cf.pb) AS pb_for_filter, CASE WHEN lb.pb_mrq IS NOT NULL THEN 'baostock_pb_mrq' ELSE 'eastmoney_pb' END AS pb_source,
  h.median AS roe_annual_median, h.low AS roe_annual_min, coalesce(h.n, 0) AS annual_periods, h.s AS history_start, h.e AS history_end,
  {POWER.format('r')} AS r_cagr, {POWER.format('p')} AS p_cagr,
  CASE WHEN lt.total_assets > 0 THEN lt.total_liabilities / lt.total_assets * 100 END AS debt, lt.operating_cashflow - lt.capex AS fcf,
  CASE WHEN lt.total_assets > 0 THEN lt.cash / lt.total_assets * 100 END AS cash_share, h.la.o - h.la.x AS fcf_annual, CASE WHEN h.la.p <> 0 THEN h.la.o / h.la.p * 100 END AS ocf_annual,
  CASE WHEN h.profit <> 0 THEN CAST(h.ocf AS DOUBLE) / CAST(h.profit AS DOUBLE) * 100 END AS ocf_total,
  CASE WHEN lt.symbol IS NULL THEN 'missing_tdx_latest' WHEN coalesce(c.differ, 0) > 0 THEN 'cross_source_difference_over_1pct' WHEN coalesce(h.n, 0) < 3 THEN 'insufficient_annual_history'
    WHEN lb.symbol IS NULL THEN 'history_ready_valuation_single_source' WHEN coalesce(c.same, 0) > 0 THEN 'multi_source_verified' ELSE 'multi_source_pending_validation' END AS quality_status
  FROM cf LEFT JOIN lt USING (symbol) LEFT JOIN lb USING (symbol) LEFT JOIN h USING (symbol) LEFT JOIN c ON c.symbol = cf.symbol AND c.report_period = lt.report_period)"""
SHOW = """SELECT symbol, industry, is_active, report_period, tdx_period, CAST(pe_for_filter AS DECIMAL(18, 4)) AS pe_for_filter, pe_source, CAST(pb_for_filter AS DECIMAL(18, 4)) AS pb_for_filter, pb_source, CAST(cash_share AS DECIMAL(18, 6)) AS cash_to_assets_latest, CAST(fcf_annual AS DECIMAL(18, 4)) AS fcf_latest_annual, CAST(ocf_annual AS DECIMAL(18, 6)) AS ocf_to_profit_latest_annual,
CAST(roe_annual_median AS DECIMAL(18, 4)) AS roe_annual_median, CAST(roe_annual_min AS DECIMAL(18, 4)) AS roe_annual_min, annual_periods, history_start, history_end,
CAST(r_cagr AS DECIMAL(18, 6)) AS revenue_cagr_pct, CAST(p_cagr AS DECIMAL(18, 6)) AS profit_cagr_pct, CAST(debt AS DECIMAL(18, 6)) AS debt_ratio_latest, CAST(fcf AS DECIMAL(18, 4)) AS fcf_latest,
CAST(ocf_total AS DECIMAL(18, 6)) AS ocf_to_profit_total, quality_status FROM m"""


def shown(df):
    money = lambda c: F.col(c).cast("decimal(18,4)").alias(c)
    fine = lambda c: F.col(c).cast("decimal(18,6)").alias(c)
    return df.select("symbol", "industry", "is_active", "report_period", "tdx_period", money("pe_for_filter"), "pe_source", money("pb_for_filter"), "pb_source", fine("cash_to_assets_latest"), money("fcf_latest_annual"), fine("ocf_to_profit_latest_annual"), money("roe_annual_median"), money("roe_annual_min"), "annual_periods", "history_start", "history_end", fine("revenue_cagr_pct"), fine("profit_cagr_pct"), fine("debt_ratio_latest"), money("fcf_latest"), fine("ocf_to_profit_total"), "quality_status")


def current(spark, sf_dir):
    return tuple(asof.revisions(view(spark, sf_dir, x)) for x in ("fx_fund_hist", "fx_tdx_hist", "fx_bao"))


FUND = "symbol, report_period, published_at, industry, roe_weighted, pe_dynamic, revenue, version_id"


@query("current_snapshot", f"WITH l AS (SELECT report_period, max(CAST(ingested_at AS DATE)) AS day FROM fx_fund_hist GROUP BY 1) SELECT {FUND} FROM fx_fund_hist JOIN l USING (report_period) WHERE CAST(ingested_at AS DATE) = day QUALIFY row_number() OVER (PARTITION BY symbol, report_period ORDER BY ingested_at DESC, version_id DESC) = 1")
def current_snapshot(spark, sf_dir):
    history = view(spark, sf_dir, "fx_fund_hist").withColumn("load_day", F.to_date("ingested_at"))
    return versions.current_snapshot(history, "load_day").select(*FUND.split(", "))


@query("fundamentals_pit", f"WITH {revised('f', 'fx_fund_hist', known(AS_OF))} SELECT {FUND} FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) = 1")
def fundamentals_pit(spark, sf_dir):
    return asof.fundamentals_pit(view(spark, sf_dir, "fx_fund_hist"), AS_OF).select(*FUND.split(", "))


TDX = "symbol, report_period, published_at, roe_weighted, revenue_ttm, total_assets, version_id"


@query("tdx_history_pit", f"WITH {revised('t', 'fx_tdx_hist', known(AS_OF))} SELECT {TDX} FROM t WHERE report_period LIKE '%1231'")
def tdx_history_pit(spark, sf_dir):
    return asof.history_pit(view(spark, sf_dir, "fx_tdx_hist"), AS_OF, annual_only=True).select(*TDX.split(", "))


@query("statements_as_of", f"""WITH s AS (SELECT symbol, report_period AS report_date, 'tdx' AS source, 'income' AS statement, published_at, observed_at, version_id, revenue FROM fx_tdx_hist)
SELECT symbol, report_date, version_id, revenue FROM s WHERE {known(AS_OF)} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC, version_id) <= 3""")
def statements_as_of(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_tdx_hist").select("symbol", F.col("report_period").alias("report_date"), F.col("version_id").alias("source"), F.lit("income").alias("statement"), "published_at", "observed_at", "version_id", "revenue")
    return asof.statements_as_of(rows, AS_OF, "income", 3).select("symbol", "report_date", "version_id", "revenue")


@query("tdx_coverage", "SELECT report_period, count(*) AS rows, min(published_at) AS first_published, max(published_at) AS last_published, max(ingested_at) AS last_ingested FROM fx_tdx_hist GROUP BY 1")
def tdx_coverage(spark, sf_dir):
    return fundamentals.coverage(view(spark, sf_dir, "fx_tdx_hist"))


@query("screen_fundamentals", f"WITH {revised('f', 'fx_fund_hist')} SELECT {FUND} FROM f WHERE report_period = '19981231' AND roe_weighted >= 5 AND pe_dynamic > 0 AND pe_dynamic <= 40 AND is_active ORDER BY symbol LIMIT 40 OFFSET 2")
def screen_fundamentals(spark, sf_dir):
    rows = asof.revisions(view(spark, sf_dir, "fx_fund_hist"))
    return fundamentals.screen_fundamentals(rows, period="19981231", min_roe=5, max_pe=40, active_only=True, limit=40, offset=2).select(*FUND.split(", "))


@query("screen_latest_period", f"WITH {revised('f', 'fx_fund_hist')} SELECT {FUND} FROM f WHERE report_period = (SELECT max(report_period) FROM f) AND industry = 'BUILDING'")
def screen_latest_period(spark, sf_dir):
    return fundamentals.screen_fundamentals(asof.revisions(view(spark, sf_dir, "fx_fund_hist")), industry="BUILDING").select(*FUND.split(", "))


@query("lookup", f"WITH {revised('b', 'fx_bao')}, k AS (SELECT DISTINCT symbol FROM fx_fund_hist WHERE industry = 'MACHINERY') SELECT symbol, report_period, trade_date, pe_ttm, pb_mrq FROM b WHERE symbol IN (SELECT symbol FROM k)")
def lookup(spark, sf_dir):
    keys = view(spark, sf_dir, "fx_fund_hist").where("industry = 'MACHINERY'").select("symbol").distinct()
    return asof.revisions(view(spark, sf_dir, "fx_bao")).join(keys, "symbol", "left_semi").select("symbol", "report_period", "trade_date", "pe_ttm", "pb_mrq")


@query("validate_sources", f"WITH {NOW_SQL}, {VALID} SELECT symbol, report_period, metric, source_a, source_b, value_a, value_b, status, CAST(round(CAST(d AS DECIMAL(38, 12)), 4) AS DECIMAL(24, 4)) AS difference_pct FROM v")
def validate_sources(spark, sf_dir):
    return fundamentals.validate_sources(*current(spark, sf_dir))


@query("merge_validation", f"WITH {NOW_SQL}, {VALID} SELECT metric, status, count(*) AS n FROM v GROUP BY ALL")
def merge_validation(spark, sf_dir):
    """Validation of the history as of a date, overwritten by that of today: the last write of each key counts."""
    f, t, b = (view(spark, sf_dir, x) for x in ("fx_fund_hist", "fx_tdx_hist", "fx_bao"))
    old = fundamentals.validate_sources(asof.history_pit(f, AS_OF), asof.history_pit(t, AS_OF), asof.revisions(b))
    new = fundamentals.validate_sources(*current(spark, sf_dir))
    merged = versions.upsert(old, new, ["symbol", "report_period", "metric", "source_a", "source_b"])
    return merged.groupBy("metric", "status").agg(F.count("*").alias("n"))


@query("funnel_metrics", f"WITH {NOW_SQL}, {FUNNEL} {SHOW}")
def funnel_metrics(spark, sf_dir):
    f, t, b = current(spark, sf_dir)
    return shown(fundamentals.funnel_metrics(f, t, b, fundamentals.validate_sources(f, t, b)))


@query("funnel_as_of", f"WITH {PIT_SQL}, {FUNNEL} {SHOW}")
def funnel_as_of(spark, sf_dir):
    return shown(fundamentals.funnel_as_of(*(view(spark, sf_dir, x) for x in ("fx_fund_hist", "fx_tdx_hist", "fx_bao")), AS_OF))


STORED = f"""stored AS (SELECT symbol, report_period, status, observed_at FROM (SELECT v.*, TIMESTAMP '1998-06-30 12:00:00' + CAST(CAST(v.symbol AS BIGINT) % 3 - 1 AS INTEGER) * INTERVAL '1' DAY AS observed_at FROM v))"""
CUT = FUNNEL.replace("c AS (SELECT symbol, report_period, count(*) FILTER (status = 'consistent') AS same, count(*) FILTER (status = 'difference_over_1pct') AS differ FROM v GROUP BY ALL)", f"{STORED}, c AS (SELECT symbol, report_period, count(*) FILTER (status = 'consistent') AS same, count(*) FILTER (status = 'difference_over_1pct') AS differ FROM stored WHERE CAST(observed_at AS DATE) <= DATE '{AS_OF}' GROUP BY ALL)")


@query("funnel_as_of_stored", f"WITH {PIT_SQL}, {CUT} {SHOW}")
def funnel_as_of_stored(spark, sf_dir):
    """The funnel at a date with stored checks, of which a third were made after it."""
    f, t, b = (view(spark, sf_dir, x) for x in ("fx_fund_hist", "fx_tdx_hist", "fx_bao"))
    checks = fundamentals.validate_sources(asof.history_pit(f, AS_OF), asof.history_pit(t, AS_OF), asof.revisions(b.where(F.to_date("ingested_at") <= F.lit(AS_OF).cast("date"))))
    stored = checks.withColumn("observed_at", F.expr("TIMESTAMP_NTZ'1998-06-30 12:00:00' + cast(cast(symbol AS bigint) % 3 - 1 AS int) * INTERVAL '1' DAY"))
    return shown(fundamentals.funnel_as_of(f, t, b, AS_OF, stored))


@query("screen_funnel", f"WITH {NOW_SQL}, {FUNNEL} {SHOW} WHERE roe_annual_median >= 8 AND pe_for_filter > 0 AND pe_for_filter <= 45 AND debt <= 70 AND annual_periods >= 2 AND is_active ORDER BY m.roe_annual_median DESC NULLS LAST, symbol LIMIT 100")
def screen_funnel(spark, sf_dir):
    f, t, b = current(spark, sf_dir)
    metrics = fundamentals.funnel_metrics(f, t, b, fundamentals.validate_sources(f, t, b))
    return shown(fundamentals.screen_funnel(metrics, min_roe_median=8, max_pe=45, max_debt_ratio=70, min_annual_periods=2, active_only=True, limit=100))


@query(
    "merge_fundamentals",
    f"""WITH {NOW_SQL}, lf AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) = 1), lt AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) = 1),
lb AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC) = 1)
SELECT symbol, coalesce(lb.pe_ttm, lf.pe_dynamic) AS pe, coalesce(lt.roe_weighted, lf.roe_weighted, lb.roe_avg) AS roe, coalesce(lf.revenue, lt.revenue) AS revenue,
concat_ws(';', CASE WHEN lf.version_id IS NOT NULL THEN 'performance' END, CASE WHEN lt.version_id IS NOT NULL THEN 'balance' END, CASE WHEN lb.version_id IS NOT NULL THEN 'valuation' END) AS provenance
FROM lf FULL JOIN lt USING (symbol) FULL JOIN lb USING (symbol)""",
)
def merge_fundamentals(spark, sf_dir):
    f, t, b = (asof.latest_period(x) for x in current(spark, sf_dir))
    fields = {"pe": [("valuation", "pe_ttm"), ("performance", "pe_dynamic")], "roe": [("balance", "roe_weighted"), ("performance", "roe_weighted"), ("valuation", "roe_avg")], "revenue": [("performance", "revenue"), ("balance", "revenue")]}
    return fundamentals.merge_fundamentals({"performance": f, "balance": t, "valuation": b}, fields)


@query(
    "tdx_normalise",
    """WITH e AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol, concat(CAST(year(o_orderdate) AS VARCHAR), '1231') AS report_period, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) * 10000 END AS revenue,
CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) * 20000 END AS assets, CASE WHEN o_orderkey % 4 = 3 OR (o_orderkey % 4 = 0 AND year(o_orderdate) >= 2000) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published_at, o_orderkey AS position FROM orders)
SELECT symbol, report_period, revenue, assets, published_at, position FROM e QUALIFY row_number() OVER (PARTITION BY symbol, report_period ORDER BY (revenue IS NOT NULL)::INT + (assets IS NOT NULL)::INT + (published_at IS NOT NULL)::INT DESC, position) = 1""",
)
def tdx_normalise(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol"), F.concat(F.year("o_orderdate").cast("string"), F.lit("1231")).alias("report_period"), F.when(key % 3 != 0, key).alias("r1"), F.lit(None).cast("long").alias("r0"),
        F.when(key % 2 != 0, key * 2).alias("assets"), F.when(key % 4 == 0, F.date_format("o_orderdate", "yyMMdd").cast("int").cast("string")).when(key % 4 == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(key % 4 == 2, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".0"))).otherwise("80430").alias("published_at"), key.alias("position"),
    )
    return fundamentals.tdx_normalise(rows, ("revenue", "assets"), {"revenue": ("r0", "r1")}).select("symbol", "report_period", "revenue", "assets", "published_at", "position")


@query("baostock_snapshot", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) * 100 END AS roe_avg, CAST(o_orderkey AS DOUBLE) AS pe_ttm FROM orders")
def baostock_snapshot(spark, sf_dir):
    roe = F.when(F.col("o_orderkey") % 4 == 0, "-").otherwise(F.col("o_custkey").cast("string"))
    body = F.to_json(F.struct(F.struct(roe.alias("roeAvg")).alias("profit"), F.struct(F.col("o_orderkey").cast("string").alias("peTTM")).alias("valuation")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("payload_json"))
    return fundamentals.baostock_snapshot(rows, {"roe_avg": ("profit", "roeAvg", True), "pe_ttm": ("valuation", "peTTM", False)})


@query("last_record_by_symbol", "SELECT lpad(CAST(o_custkey % 500 AS VARCHAR), 6, '0') AS symbol, max(o_orderkey) AS position FROM orders WHERE o_custkey % 500 <> 0 GROUP BY 1")
def last_record_by_symbol(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).cast("string").alias("symbol"), F.col("o_orderkey").alias("position"))
    return fundamentals.last_record_by_symbol(rows)
