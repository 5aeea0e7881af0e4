"""Quotes and order books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(books: DataFrame) -> DataFrame:
    """Best bid and ask (first usable level by position), spread and basis points of the middle; both sides are needed.

    bids and asks are arrays of struct(position, price, size).
    """
    usable = lambda c: F.array_sort(F.filter(c, lambda x: x["price"] > 0))
    out = books.withColumn("best_bid", F.get(usable("bids"), F.lit(0))["price"]).withColumn("best_ask", F.get(usable("asks"), F.lit(0))["price"])
    gap, middle = F.col("best_ask") - F.col("best_bid"), (F.col("best_ask") + F.col("best_bid")) / 2
    return out.withColumn("spread", gap).withColumn("spread_bps", F.when(middle != 0, gap / middle * 10_000))


def quote_change(price: Column, previous: Column) -> tuple[Column, Column]:
    change = F.when(previous.isNotNull(), price - previous)
    return change, F.when(previous != 0, (price - previous) / previous * 100)


def latest_session_quote(rows: DataFrame, sessions: tuple[str, ...] = ("regular", "pre_market", "post_market", "overnight")) -> DataFrame:
    """Of the sessions' struct(ts, price) columns the newest with a price, with change against previous_close."""
    each = [F.when(F.col(s)["price"] > 0, F.struct(F.col(s)["ts"].alias("ts"), F.lit(s).alias("session"), F.col(s)["price"].alias("price"))) for s in sessions]
    out = rows.withColumn("_best", F.array_max(F.array_compact(F.array(*each))))
    out = out.withColumns({"quote_at": F.col("_best.ts"), "session": F.col("_best.session"), "price": F.col("_best.price")}).drop("_best")
    change, percent = quote_change(F.col("price"), F.col("previous_close"))
    return out.withColumn("change", change).withColumn("change_pct", percent)


def last_nonnull_close(rows: DataFrame) -> DataFrame:
    """price: the last close of an array that isn't null, else the meta price; previous: the meta previous close, else the chart's."""
    known = F.filter("closes", lambda x: x.isNotNull())
    return rows.withColumn("price", F.coalesce(F.try_element_at(known, F.lit(-1)), "meta_price")).withColumn("previous", F.coalesce("meta_previous", "chart_previous"))


def newest_known(rows: DataFrame, key: str, order: str, value: str, n: int = 2) -> DataFrame:
    """(key, closes): the n newest values that aren't null, oldest first. Others go before the shuffle, so no group is held whole."""
    newest = Window.partitionBy(key).orderBy(F.col(value).isNotNull().desc(), F.col(order).desc(), F.col(value).desc())
    kept = rows.select(key, order, value).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    kept = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("x"))
    return kept.select(key, F.filter(F.transform("x", lambda x: x["v"]), lambda x: x.isNotNull()).alias("closes"))


def session_label(ts: Column, periods: list[tuple[str, Column, Column]]) -> Column:
    """The first period (name, start, end; ends included) that holds ts, else closed; unknown without a time."""
    label = F.lit("closed")
    for name, start, end in reversed(periods):
        label = F.when(ts.between(start, end), name).otherwise(label)
    return F.when(ts.isNull(), "unknown").otherwise(label)


def validate_quote(rows: DataFrame, markets: tuple[str, ...] = ("CN", "HK", "US")) -> DataFrame:
    """rows with errors, the list of what is wrong."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in ("symbol", "market", "source", "price") if c in rows.columns]
    market = F.when(~F.coalesce(F.col("market").isin(*markets), F.lit(True)), F.lit("unknown_market"))
    price = F.when(F.isnan(F.col("price").cast("double")) | (F.col("price") <= 0), F.lit("invalid_price"))
    return rows.withColumn("errors", F.array_compact(F.array(*missing, market, price)))
