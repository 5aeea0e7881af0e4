"""Fundamentals: merging sources, screening, cross-source validation and the screening funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.scalars import difference_pct, difference_status
from tideframe.operators.asof import history_pit, latest_period, revisions
from tideframe.operators.versions import newest

# Compared metrics as (name, column of fundamentals, source b, column of source b).
PAIRS = (
    ("roe_weighted", "roe_weighted", "tdx", "roe_weighted"),
    ("roe_avg", "roe_weighted", "baostock", "roe_avg"),
    ("revenue", "revenue", "tdx", "revenue"),
    ("net_profit", "net_profit", "tdx", "net_profit_parent"),
    ("total_assets", "total_assets", "tdx", "total_assets"),
    ("total_liabilities", "total_liabilities", "tdx", "total_liabilities"),
    ("operating_cashflow", "operating_cashflow", "tdx", "operating_cashflow"),
)


def merge_fundamentals(sources: dict[str, DataFrame], fields: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """One row for each symbol of any source; a field is the first non-null of its (source, column) alternatives.

    All sources go through one union and one aggregate instead of a chain of full outer joins.
    """
    parts = None
    for name, frame in sources.items():
        row = frame.select("symbol", F.struct(*(c for c in frame.columns if c != "symbol")).alias(name))
        parts = row if parts is None else parts.unionByName(row, allowMissingColumns=True)
    one = parts.groupBy("symbol").agg(*(F.first(n, ignorenulls=True).alias(n) for n in sources))
    present = F.concat_ws(";", *(F.when(F.col(n).isNotNull(), F.lit(n)) for n in sources))
    return one.select("symbol", *(F.coalesce(*(F.col(f"{s}.{c}") for s, c in alternatives)).alias(k) for k, alternatives in fields.items()), present.alias("provenance"))


def last_record_by_symbol(rows: DataFrame, position: str = "position") -> DataFrame:
    """Six-digit symbols; of several records the last one; codes of zeros only are dropped."""
    code = F.lpad(F.col("symbol").cast("string"), 6, "0")
    return newest(rows.withColumn("symbol", code).where(F.col("symbol") != "000000"), ("symbol",), (position,))


def most_complete(rows: DataFrame, fields: list[str], position: str = "position") -> DataFrame:
    """Of several rows of a symbol and period the one with most values, the first on ties."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    return newest(rows.withColumn("_filled", filled).withColumn("_order", -F.col(position)), ("symbol", "report_period"), ("_filled", "_order")).drop("_filled", "_order")


def short_date(text: Column) -> Column:
    """A number of the form YYMMDD (80 to 99 are the last century) or YYYYMMDD as YYYY-MM-DD; anything else is null."""
    digits = text.try_cast("double").try_cast("long").cast("string")
    whole = F.when(F.length(digits) == 6, F.concat(F.when(F.substring(digits, 1, 2) >= "80", "19").otherwise("20"), digits)).when(F.length(digits) == 8, digits)
    return F.when(whole.isNotNull(), F.concat(F.substring(whole, 1, 4), F.lit("-"), F.substring(whole, 5, 2), F.lit("-"), F.substring(whole, 7, 2)))


def screen_fundamentals(rows: DataFrame, period: str | None = None, symbol: str | None = None, industry: str | None = None, min_roe: float | None = None, max_pe: float | None = None, active_only: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Current rows through the filters. Without a period: the newest of all, or of the symbol if one is given."""
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    if period is not None:
        rows = rows.where(F.col("report_period") == period)
    else:
        rows = rows.join(F.broadcast(rows.agg(F.max("report_period").alias("report_period"))), "report_period", "left_semi")  # one row
    if industry is not None:
        rows = rows.where(F.col("industry") == industry)
    if min_roe is not None:
        rows = rows.where(F.col("roe_weighted") >= min_roe)
    if max_pe is not None:
        rows = rows.where((F.col("pe_dynamic") > 0) & (F.col("pe_dynamic") <= max_pe))
    if active_only:
        rows = rows.where("is_active")
    if limit is None:
        return rows
    return rows.orderBy("symbol").offset(offset).limit(limit)


def coverage(history: DataFrame) -> DataFrame:
    """For each period: rows, publication span and last load."""
    return history.groupBy("report_period").agg(F.count("*").alias("rows"), F.min("published_at").alias("first_published"), F.max("published_at").alias("last_published"), F.max("ingested_at").alias("last_ingested"))


def validate_sources(fundamentals: DataFrame, tdx: DataFrame, bao: DataFrame) -> DataFrame:
    """Seven comparisons of each symbol and period, by two joins and one unpivot."""
    keys = ["symbol", "report_period"]
    b = {"tdx": tdx, "baostock": bao}
    joined = fundamentals.select(*keys, *dict.fromkeys(c for _, c, _, _ in PAIRS))
    for source, frame in b.items():
        used = dict.fromkeys(c for _, _, s, c in PAIRS if s == source)
        joined = joined.join(frame.select(*keys, *(F.col(c).alias(f"_{source}_{c}") for c in used)), keys, "left")
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit("eastmoney").alias("source_a"), F.lit(s).alias("source_b"), F.col(a).cast("double").alias("value_a"), F.col(f"_{s}_{c}").cast("double").alias("value_b")) for m, a, s, c in PAIRS))
    each = joined.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
    difference = difference_pct(F.col("value_a"), F.col("value_b"))
    # The status goes by the exact difference; the number shown is rounded.
    return each.withColumn("status", difference_status(difference)).withColumn("difference_pct", F.round(difference.cast("decimal(38,12)"), 4).cast("decimal(24,4)"))


def percent_of(a: Column, b: Column) -> Column:
    """a in percent of a positive b."""
    return F.when(b > 0, a / b * 100)


def percent_of_any(a: Column, b: Column) -> Column:
    """a in percent of b, which may be a loss but not 0."""
    return F.when(b != 0, a / b * 100)


def cagr(first: Column, last: Column, years: Column) -> Column:
    """Yearly growth in percent, where there are years and both ends are positive."""
    return F.when((years > 0) & (first > 0) & (last > 0), (F.pow(last / first, F.lit(1.0) / years) - 1) * 100)


def annual_history(tdx: DataFrame) -> DataFrame:
    """Aggregates over the year-end reports of each symbol."""
    rows = tdx.where(F.col("report_period").endswith("1231"))
    period = F.col("report_period")
    revenue, profit = F.col("revenue_ttm"), F.col("net_profit_parent_ttm")
    known = lambda c, p: F.when(c.isNotNull(), p)
    return rows.groupBy("symbol").agg(
        F.expr("percentile(roe_weighted, 0.5)").alias("roe_annual_median"),
        F.min("roe_weighted").alias("roe_annual_min"),
        F.count("*").alias("annual_periods"),
        F.min(period).alias("history_start"),
        F.max(period).alias("history_end"),
        F.min_by(revenue, known(revenue, period)).alias("_revenue_first"),
        F.max_by(revenue, known(revenue, period)).alias("_revenue_last"),
        F.min_by(profit, known(profit, period)).alias("_profit_first"),
        F.max_by(profit, known(profit, period)).alias("_profit_last"),
        F.max_by(F.struct("operating_cashflow", "capex", F.coalesce("net_profit_parent", "net_profit_parent_ttm").alias("profit")), period).alias("_latest"),
        F.sum(F.col("operating_cashflow").cast("decimal(24,4)")).alias("_ocf"),
        F.sum(F.coalesce("net_profit_parent", "net_profit_parent_ttm").cast("decimal(24,4)")).alias("_profit"),
    )


def funnel_metrics(fundamentals: DataFrame, tdx: DataFrame, bao: DataFrame, validation: DataFrame) -> DataFrame:
    """Screening metrics of each symbol of fundamentals. All inputs are current rows by (symbol, report_period).

    Five left joins on the symbol, so one partitioning by symbol serves them all.
    """
    current = latest_period(fundamentals)
    last_tdx = latest_period(tdx).select("symbol", F.col("report_period").alias("tdx_period"), F.struct("total_assets", "total_liabilities", "cash", "operating_cashflow", "capex").alias("t"))
    # PostgreSQL's descending order has nulls first, so a row without a trade date counts as the latest.
    order = F.struct(F.col("trade_date").isNull().alias("n"), F.col("trade_date"), F.col("report_period"))
    last_bao = bao.groupBy("symbol").agg(F.max_by(F.struct("pe_ttm", "pb_mrq"), order).alias("b"))
    history = annual_history(tdx)
    status = lambda s: F.count_if(F.col("status") == s)
    checks = validation.groupBy("symbol", F.col("report_period").alias("tdx_period")).agg(status("consistent").alias("_same"), status("difference_over_1pct").alias("_differ"))
    joined = current.join(last_tdx, "symbol", "left").join(last_bao, "symbol", "left").join(history, "symbol", "left").join(checks, ["symbol", "tdx_period"], "left")
    span = (F.substring("history_end", 1, 4).cast("int") - F.substring("history_start", 1, 4).cast("int")).cast("double")
    periods = F.coalesce("annual_periods", F.lit(0)).cast("long")
    quality = (
        F.when(F.col("tdx_period").isNull(), "missing_tdx_latest")
        .when(F.coalesce("_differ", F.lit(0)) > 0, "cross_source_difference_over_1pct")
        .when(periods < 3, "insufficient_annual_history")
        .when(F.col("b").isNull(), "history_ready_valuation_single_source")
        .when(F.coalesce("_same", F.lit(0)) > 0, "multi_source_verified")
        .otherwise("multi_source_pending_validation")
    )
    return joined.select(
        "symbol", "name", "industry", "is_active", "report_period", "tdx_period",
        F.coalesce("b.pe_ttm", "pe_dynamic").alias("pe_for_filter"),
        F.when(F.col("b.pe_ttm").isNotNull(), "baostock_pe_ttm").otherwise("eastmoney_pe_dynamic").alias("pe_source"),
        F.coalesce("b.pb_mrq", "pb").alias("pb_for_filter"),
        F.when(F.col("b.pb_mrq").isNotNull(), "baostock_pb_mrq").otherwise("eastmoney_pb").alias("pb_source"),
        "roe_annual_median", "roe_annual_min", periods.alias("annual_periods"), "history_start", "history_end",
        cagr(F.col("_revenue_first"), F.col("_revenue_last"), span).alias("revenue_cagr_pct"),
        cagr(F.col("_profit_first"), F.col("_profit_last"), span).alias("profit_cagr_pct"),
        percent_of(F.col("t.total_liabilities"), F.col("t.total_assets")).alias("debt_ratio_latest"),
        percent_of(F.col("t.cash"), F.col("t.total_assets")).alias("cash_to_assets_latest"),
        (F.col("t.operating_cashflow") - F.col("t.capex")).alias("fcf_latest"),
        (F.col("_latest.operating_cashflow") - F.col("_latest.capex")).alias("fcf_latest_annual"),
        percent_of_any(F.col("_latest.operating_cashflow"), F.col("_latest.profit")).alias("ocf_to_profit_latest_annual"),
        percent_of_any(F.col("_ocf").cast("double"), F.col("_profit").cast("double")).alias("ocf_to_profit_total"),
        quality.alias("quality_status"),
    )


def funnel_as_of(fundamentals: DataFrame, tdx: DataFrame, bao: DataFrame, as_of: str, validation: DataFrame | None = None) -> DataFrame:
    """The funnel over what was knowable at a date. validation: stored checks with observed_at, of which those made by then count; without them they are made of the same rows."""
    f, t = history_pit(fundamentals, as_of), history_pit(tdx, as_of)
    b = revisions(bao.where(F.to_date("ingested_at") <= F.lit(as_of).cast("date")))
    known = validate_sources(f, t, b) if validation is None else validation.where(F.to_date("observed_at") <= F.lit(as_of).cast("date"))
    return funnel_metrics(f, t, b, known)


def screen_funnel(metrics: DataFrame, min_roe_median: float | None = None, min_revenue_cagr: float | None = None, min_profit_cagr: float | None = None, max_pe: float | None = None, max_debt_ratio: float | None = None, min_annual_periods: int | None = None, active_only: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filters on the projected metrics, best median return first."""
    for column, low in (("roe_annual_median", min_roe_median), ("revenue_cagr_pct", min_revenue_cagr), ("profit_cagr_pct", min_profit_cagr), ("annual_periods", min_annual_periods)):
        if low is not None:
            metrics = metrics.where(F.col(column) >= low)
    if max_pe is not None:
        metrics = metrics.where((F.col("pe_for_filter") > 0) & (F.col("pe_for_filter") <= max_pe))
    if max_debt_ratio is not None:
        metrics = metrics.where(F.col("debt_ratio_latest") <= max_debt_ratio)
    if active_only:
        metrics = metrics.where("is_active")
    if limit is None:
        return metrics
    return metrics.orderBy(F.col("roe_annual_median").desc_nulls_last(), "symbol").offset(offset).limit(limit)


def statement_rows(rows: DataFrame, dates: tuple[str, ...] = ("REPORT_DATE", "report_date", "end_date", "date")) -> DataFrame:
    """Statement rows (payload_json) with report_date, the first ten characters of the first date they have; rows without one go."""
    found = F.coalesce(*(F.get_json_object("payload_json", f"$.{d}") for d in dates))
    return rows.withColumn("report_date", F.substring(found, 1, 10)).where(F.col("report_date").isNotNull() & (F.col("report_date") != ""))


def numbered_periods(rows: DataFrame) -> DataFrame:
    """Rows with their place among the symbol's periods, the newest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("report_period").desc())))


def tdx_normalise(rows: DataFrame, money: tuple[str, ...], alternatives: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Money columns in units of ten thousand scaled up, published_at from YYMMDD, duplicate columns as their first value, the fullest row of each symbol and period."""
    out = rows
    for name, columns in (alternatives or {}).items():
        out = out.withColumn(name, F.coalesce(*columns))
    out = out.withColumns({c: F.col(c).cast("double") * 10_000 for c in money} | {"published_at": short_date(F.col("published_at"))})
    return most_complete(out, [*money, "published_at"])


BAO_BLOCKS = ("profit", "operation", "growth", "balance", "cash_flow", "dupont", "valuation")


def baostock_snapshot(rows: DataFrame, fields: dict[str, tuple[str, str, bool]], body: str = "payload_json") -> DataFrame:
    """Flat columns of a JSON of seven blocks. fields: name -> (block, key, whether it is a ratio to give in percent); blanks and dashes are null."""
    from tideframe.functions.scalars import number

    columns = {}
    for name, (block, key, percent) in fields.items():
        value = number(F.get_json_object(body, f"$.{block}.{key}"))
        columns[name] = value * 100 if percent else value
    return rows.withColumns(columns).drop(body)
