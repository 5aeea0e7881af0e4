"""Scalar functions as native column expressions; no Python runs for a row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Interval names and their seconds.
INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "1d": 86400}


def interval_seconds(name: Column) -> Column:
    out = F.lit(None).cast("long")
    for k, v in INTERVALS.items():
        out = F.when(name == k, F.lit(v).cast("long")).otherwise(out)
    return out


def json_safe(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def _digits6(symbol: Column) -> Column:
    """At least six characters, with zeros in front."""
    text = F.trim(symbol.cast("string"))
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def exchange_for_symbol(symbol: Column) -> Column:
    """Exchange by the first digit of the six-digit code: 4, 8, 9 Beijing, 5, 6 Shanghai, else Shenzhen."""
    first = F.substring(_digits6(symbol), 1, 1)
    return F.when(first.isin("4", "8", "9"), "XBSE").when(first.isin("5", "6"), "XSHG").otherwise("XSHE")


def instrument_id(symbol: Column) -> Column:
    return F.concat_ws(".", F.lit("CN"), exchange_for_symbol(symbol), _digits6(symbol))


def latest_broad_report_period(day: Column) -> Column:
    """The newest quarter end that most companies have reported on by a date."""
    year, month = F.year(day), F.month(day)
    last = F.concat((year - 1).cast("string"), F.lit("0930"))
    now = year.cast("string")
    return F.when(month >= 11, F.concat(now, F.lit("0930"))).when(month >= 9, F.concat(now, F.lit("0630"))).when(month >= 5, F.concat(now, F.lit("0331"))).otherwise(last)


def normalize_report_period(text: Column) -> Column:
    """Eight digits that end a quarter, else null."""
    digits = F.regexp_replace(text.cast("string"), "[^0-9]", "")
    return F.when((F.length(digits) == 8) & F.substring(digits, 5, 4).isin("0331", "0630", "0930", "1231"), digits)


def market_of(symbol: Column) -> Column:
    text = F.upper(symbol)
    return F.when(text.rlike(r"\.(SH|SZ|BJ)$"), "CN").when(text.endswith(".HK"), "HK").otherwise("US")


def canonical_instrument(symbol: Column) -> Column:
    """struct(instrument_id, symbol, market, exchange) of a code in any of the usual spellings; null if unknown."""
    text = F.upper(F.trim(symbol))
    code, suffix = F.regexp_extract(text, r"^([0-9]{6})(?:\.(SH|SS|SZ|BJ))?$", 1), F.regexp_extract(text, r"^([0-9]{6})(?:\.(SH|SS|SZ|BJ))?$", 2)
    first = F.substring(code, 1, 1)
    inferred = F.when(first.isin("5", "6", "9"), "SH").otherwise("SZ")
    place = F.when(suffix == "SS", "SH").when(suffix != "", suffix).otherwise(inferred)
    mic = F.when(place == "SH", "XSHG").when(place == "BJ", "XBSE").otherwise("XSHE")
    hk = F.regexp_extract(text, r"^([0-9]{1,5})\.HK$", 1)
    hk = F.when(F.length(hk) > 0, F.lpad(hk, 5, "0"))
    us = F.regexp_extract(text, r"^([A-Z][A-Z0-9]*(?:[.-][A-Z])?)(?:\.US)?$", 1)
    us = F.when(F.length(us) > 0, F.regexp_replace(us, r"\.", "-"))
    row = lambda i, s, m, e: F.struct(i.alias("instrument_id"), s.alias("symbol"), F.lit(m).alias("market"), e.alias("exchange"))
    cn = row(F.concat_ws(".", F.lit("CN"), mic, code), F.concat_ws(".", code, place), "CN", mic)
    other = F.when(hk.isNotNull(), row(F.concat_ws(".", F.lit("HK"), F.lit("XHKG"), hk), F.concat(hk, F.lit(".HK")), "HK", F.lit("XHKG")))
    other = other.when(us.isNotNull(), row(F.concat_ws(".", F.lit("US"), us), us, "US", F.lit("US")))
    return F.when(code != "", cn).otherwise(other)


def normalize_a_symbol(symbol: Column) -> Column:
    """Six digits and SH, SZ or BJ; null if there aren't six digits."""
    text = F.upper(F.trim(symbol))
    code, suffix = F.regexp_extract(text, r"^([0-9]{6})(?:\.(SH|SS|SZ|BJ))?$", 1), F.regexp_extract(text, r"^([0-9]{6})(?:\.(SH|SS|SZ|BJ))?$", 2)
    first = F.substring(code, 1, 1)
    place = F.when(suffix == "SS", "SH").when(suffix != "", suffix).when(first.isin("5", "6", "9"), "SH").when(first.isin("4", "8"), "BJ").otherwise("SZ")
    return F.when(code != "", F.concat_ws(".", code, place))


def normalize_yahoo_symbol(symbol: Column) -> Column:
    """Four-digit Hong Kong codes, currency pairs with =X, class shares with a dash, Shanghai as SS."""
    text = F.upper(F.trim(symbol))
    hk = F.regexp_extract(text, r"^0*([0-9]+)\.HK$", 1)
    pair = F.regexp_extract(text, r"^([A-Z]{3})/?([A-Z]{3})=?X?$", 0)
    fx = F.concat(F.regexp_replace(F.regexp_replace(text, "/", ""), "=X$", ""), F.lit("=X"))
    return F.when(hk != "", F.concat(F.lpad(hk, 4, "0"), F.lit(".HK"))).when((pair != "") & (text.contains("/") | text.endswith("=X")), fx).when(text.rlike(r"^[0-9]{6}\.SH$"), F.regexp_replace(text, r"\.SH$", ".SS")).when(text.rlike(r"^[A-Z]+\.[A-Z]$"), F.regexp_replace(text, r"\.", "-")).otherwise(text)


def number(text: Column) -> Column:
    """A number, or null for blanks, dashes and anything else."""
    cleaned = F.regexp_replace(F.trim(text.cast("string")), ",", "")
    return F.when(cleaned.isin("", "-", "--"), None).otherwise(json_safe(cleaned.try_cast("double")))


def text_or_null(text: Column) -> Column:
    cleaned = F.trim(text.cast("string"))
    return F.when(cleaned.isin("", "-", "--"), None).otherwise(cleaned)


def coalesce_number(*texts: Column) -> Column:
    return F.coalesce(*(number(x) for x in texts))


def utc_ms(text: Column) -> Column:
    """A timestamp cut to milliseconds; text without a zone is UTC."""
    return F.date_trunc("millisecond", text.try_cast("timestamp"))


def difference_pct(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull() | (a == 0), None).otherwise(F.abs(a - b) / F.abs(a) * 100)


def difference_status(difference: Column) -> Column:
    """By the difference before rounding."""
    return F.when(difference.isNull(), "missing_comparison").when(difference <= 1, "consistent").otherwise("difference_over_1pct")


def canonical_hash(fields: Mapping[str, Column]) -> Column:
    """sha256: over the JSON of the fields by name."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256))


def provider_code(symbol: Column) -> Column:
    """sh., sz. or bj. and six digits."""
    code = F.lpad(F.regexp_replace(symbol.cast("string"), "[^0-9]", ""), 6, "0")
    first = F.substring(code, 1, 1)
    return F.concat(F.when(first.isin("5", "6", "9"), "sh.").when(first.isin("4", "8"), "bj.").otherwise("sz."), code)


def normalize_longport_symbol(symbol: Column) -> Column:
    """Ticker and region: mainland codes as they are, Hong Kong ones without zeros in front, US classes with a dot; null for the rest."""
    known = canonical_instrument(symbol)
    name, market = known["symbol"], known["market"]
    hk = F.concat(F.regexp_extract(name, r"^0*([0-9]+)\.HK$", 1), F.lit(".HK"))
    us = F.concat(F.regexp_replace(name, "-", "."), F.lit(".US"))
    return F.when(market == "CN", normalize_a_symbol(symbol)).when(market == "HK", hk).when(market == "US", us)


def eastmoney_symbol(symbol: Column) -> Column:
    """SH, SZ or BJ by the exchange, and six digits."""
    code = _digits6(F.regexp_replace(symbol.cast("string"), "[^0-9]", ""))
    exchange = exchange_for_symbol(code)
    return F.concat(F.when(exchange == "XSHG", "SH").when(exchange == "XBSE", "BJ").otherwise("SZ"), code)


def redact(text: Column) -> Column:
    """Secrets by the end of their names, connection strings and URLs, and absolute paths masked."""
    value = r"(?:bearer\s+|basic\s+)?(?:\"[^\"]*\"|'[^']*'|[^\s,;]+)"
    out = F.regexp_replace(text, rf"(?i)(password|passwd|token|secret|api[_-]?key|authorization)(\s*[=:]\s*){value}", "$1$2[REDACTED]")
    out = F.regexp_replace(out, r"(?i)\b[a-z][a-z0-9+.-]*://[^\s]+", "[REDACTED_DSN]")
    return F.regexp_replace(out, r"(?<![\w:/.-])/(?:[\w.-]+/)+[^\s,;]+", "[REDACTED_PATH]")


def normalize_candidates(rows: DataFrame, classes: tuple[str, ...], limit: int) -> DataFrame:
    """Search results of the wanted classes, the first of each symbol, in their order."""
    from pyspark.sql import Window

    usable = rows.where(F.col("asset_class").isin(*classes) & F.col("symbol").isNotNull())
    first = usable.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("position"))).where("_n = 1").drop("_n")
    return first.orderBy("position").limit(limit)
