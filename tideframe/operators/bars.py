"""Reading bars: ranges, pages, cross-sections, matrices, projections and freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.scalars import interval_seconds
from tideframe.operators.versions import SERIES, latest_raw


def recent_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series."""
    order = Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc())
    return bars.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def bars_range(bars: DataFrame, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Bars from start to end, both included. With limit: the first ones of each series, and whether more exist."""
    found = bars.where(F.col("bar_time").between(start, end))
    if limit is None:
        return found
    order = Window.partitionBy(*SERIES).orderBy("bar_time")
    numbered = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit + 1)
    more = F.max("_n").over(Window.partitionBy(*SERIES)) > limit
    return numbered.withColumn("truncated", more).where(F.col("_n") <= limit).drop("_n")


def bars_page(bars: DataFrame, size: int, after: Column | None = None) -> DataFrame:
    """Bars after a time, with the page of `size` bars that each is on, from 0 for each series."""
    found = bars if after is None else bars.where(F.col("bar_time") > after)
    order = Window.partitionBy(*SERIES).orderBy("bar_time")
    return found.withColumn("page", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def raw_range(raw: DataFrame, start: Column, end: Column, sources: Sequence[str] | None = None) -> DataFrame:
    """Newest versions from start to end; of given sources if not None (none given: no rows)."""
    found = raw.where(F.col("bar_time").between(start, end))
    if sources is not None:
        found = found.where(F.col("source").isin(list(sources)))  # part of the key, so safe before the newest is taken
    return latest_raw(found)


def raw_page(raw: DataFrame, after_time: Column, after_source: str, size: int) -> DataFrame:
    """The next rows of each series in the order (bar_time, source)."""
    beyond = (F.col("bar_time") > after_time) | ((F.col("bar_time") == after_time) & (F.col("source") > after_source))
    order = Window.partitionBy(*SERIES).orderBy("bar_time", "source")
    return latest_raw(raw.where(beyond)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n")


def cross_section(bars: DataFrame, at: Column, symbols: DataFrame | None = None) -> DataFrame:
    """All symbols at one time."""
    found = bars.where(F.col("bar_time") == at)
    return found if symbols is None else found.join(symbols, "symbol", "left_semi")


def cross_section_page(bars: DataFrame, at: Column, after: str, size: int) -> DataFrame:
    return cross_section(bars, at).where(F.col("symbol") > after).orderBy("symbol").limit(size)


def matrix(bars: DataFrame, points: DataFrame, symbols: DataFrame) -> DataFrame:
    """The cells of points (bar_time) by symbols that have a bar."""
    return bars.join(points, "bar_time", "left_semi").join(symbols, "symbol", "left_semi")


ROW_SYMBOLS = 1000  # symbols of a share


def dense_matrix(bars: DataFrame, points: DataFrame, symbols: DataFrame, value: str = "close", most_points: int | None = None, most_symbols: int | None = None, most_cells: int | None = None) -> DataFrame:
    """Every cell of a request, null where there is no bar. A request of more points, symbols or cells than are allowed is refused.

    Symbols are dealt out in shares, and each point goes to every share, so the cells come from a join by share, however large either side is.
    """
    times, names = points.select("bar_time").distinct(), symbols.select("symbol").where("symbol IS NOT NULL").distinct()
    n, m = times.count(), names.count()
    if any(most is not None and size > most for size, most in ((n, most_points), (m, most_symbols), (n * m, most_cells))):
        raise ValueError(f"a matrix has at most {most_points} points, {most_symbols} symbols and {most_cells} cells")
    shares = -(-m // ROW_SYMBOLS) or 1
    each = times.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    cells = each.join(names.withColumn("_share", F.pmod(F.xxhash64("symbol"), F.lit(shares)).cast("int")), "_share").drop("_share")
    return cells.join(bars.select("bar_time", "symbol", value), ["bar_time", "symbol"], "left")


def raw_batch(raw: DataFrame, times: DataFrame, source: str) -> DataFrame:
    """Rows of one source at given times."""
    return latest_raw(raw.where(F.col("source") == source).join(times, "bar_time", "left_semi"))


def map_canonical(bars: DataFrame) -> DataFrame:
    """The output form: epoch seconds, ISO time, and provenance in one struct."""
    at = F.col("bar_time").cast("timestamp")
    return bars.select(
        "symbol", "bar_interval", "adjustment", F.unix_seconds(at).alias("timestamp"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("bar_at"),
        "open", "high", "low", "close", "volume", "amount",
        F.struct(F.col("source").alias("selected_source"), "source_count", "quality_status", "input_fingerprint").alias("source_payload"),
    )


def decimal_text(value: Column, digits: int = 6) -> Column:
    """A plain decimal without trailing zeros."""
    text = value.cast(f"decimal(38,{digits})").cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def historical_bar(bars: DataFrame) -> DataFrame:
    """Window start and end, event and ingestion times, prices as decimal text."""
    start = F.col("bar_time").cast("timestamp")
    end = F.timestamp_seconds(F.unix_seconds(start) + interval_seconds(F.col("bar_interval")))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return bars.select("symbol", "bar_interval", "adjustment", "source", text(start).alias("window_start"), text(end).alias("window_end"), text(end).alias("ts_event"), text(F.col("ingested_at")).alias("ts_init"), *(decimal_text(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")))


def freshness(bars: DataFrame, now: Column, ttl: int = 900) -> DataFrame:
    """Newest ingestion of each series against now: fresh within ttl seconds, else stale."""
    newest = bars.groupBy(*SERIES).agg(F.max("ingested_at").alias("newest"))
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("newest").cast("timestamp"))).cast("long")
    return newest.withColumn("age_seconds", age).withColumn("status", F.when(F.col("newest").isNull(), "empty").when(F.col("age_seconds") <= ttl, "fresh").otherwise("stale"))


def quote_freshness(quotes: DataFrame, now: Column, fresh: int = 60, usable: int = 604_800) -> DataFrame:
    """Age by the first known of ingestion, observation and quote time: fresh, stale or expired."""
    columns = [c for c in ("ingested_at", "observed_at", "quote_at") if c in quotes.columns]
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.coalesce(*columns).cast("timestamp"))
    out = quotes.withColumn("age_seconds", age.cast("long"))
    return out.withColumn("status", F.when(F.col("age_seconds").isNull(), "expired").when(F.col("age_seconds") <= fresh, "fresh").when(F.col("age_seconds") <= usable, "stale").otherwise("expired"))


def read_many(requests: DataFrame, rows: DataFrame, key: str = "symbol") -> DataFrame:
    """requests (symbols array) in their order, each symbol with its row or an error."""
    each = requests.select(*[c for c in requests.columns if c != "symbols"], F.posexplode("symbols").alias("position", key))
    found = each.join(rows.withColumn("_found", F.lit(True)), key, "left")
    error = F.when(F.trim(F.coalesce(key, F.lit(""))) == "", "invalid_symbol").when(F.col("_found").isNull(), "not_found")
    return found.withColumn("error", error).drop("_found")
