"""Which of many stored versions of a row counts. Newest-wins is an aggregate, not a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("symbol", "bar_interval", "adjustment")
RAW_KEY = (*SERIES, "source", "bar_time")
CANONICAL_KEY = (*SERIES, "bar_time")
# What bars are dealt out by. Spark takes a column of one constant value out of keys to group or join by, but not out of what rows were
# dealt by, and then deals them anew; interval and adjustment often are constant, and add little to spread rows by.
DEAL = ("symbol", "bar_time")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the one with the largest order columns (null lowest), without the columns to drop."""
    kept = [c for c in df.columns if c not in drop]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in kept if c not in keys)), F.struct(*order)).alias("_row"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in kept))


def latest_raw(bars: DataFrame, deal: Sequence[str] = DEAL, more: Sequence[str] = (), ranks: bool = True) -> DataFrame:
    """Newest ingestion, then highest content rank, of each series, source and bar time (and more columns, if any).

    deal: some of the keys, to shuffle whole rows by before they are sorted and combined. That is right where most keys have few
    rows, so that combining first would only sort everything once more, and lets later steps by the same columns go without a shuffle.
    Ranks that are hexadecimal digits are shuffled as bytes, half as long; other ones as they are. ranks: whether the result has them.
    """
    text = F.col("content_rank")
    rows = bars.withColumn("_digits", F.unhex(text))
    rows = rows.withColumn("_digits", F.when(F.lower(F.hex("_digits")) == text, F.col("_digits")))
    rows = rows.withColumn("content_rank", F.when(F.col("_digits").isNull(), text)).repartition(*deal)
    rows = rows.withColumn("content_rank", F.coalesce(F.lower(F.hex("_digits")), text)).drop("_digits")
    return newest(rows, (*RAW_KEY, *more), ("ingested_at", "content_rank"), () if ranks else ("content_rank",))


def latest_canonical(bars: DataFrame) -> DataFrame:
    return newest(bars, CANONICAL_KEY, ("version",))


def latest_quotes(quotes: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """The current quote of each symbol, of those in symbols if given."""
    chosen = quotes if symbols is None else quotes.join(symbols, "symbol", "left_semi")
    return newest(chosen, ("symbol",), ("ingested_at", "content_rank"))


def quote_versions(log: DataFrame) -> DataFrame:
    """The log without rows that repeat the payload before them; version counts from 1 for each symbol."""
    order = Window.partitionBy("symbol").orderBy("ingested_at", "content_rank")
    changed = log.withColumn("_before", F.lag("payload_json").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    changed = changed.where(F.col("_first") | ~F.col("payload_json").eqNullSafe(F.col("_before"))).drop("_before", "_first")
    return changed.withColumn("version", F.row_number().over(order).cast("long"))


def current_snapshot(history: DataFrame, load: str = "ingested_at") -> DataFrame:
    """Rows of the last load of each period: what a replaced period still holds. An empty load leaves the one before."""
    last = history.groupBy("report_period").agg(F.max(load).alias("_last"))
    kept = history.join(last, "report_period").where(F.col(load) == F.col("_last")).drop("_last")
    return newest(kept, ("symbol", "report_period"), (load, "version_id"))


def plain_number(value: Column, exact: bool = False) -> Column:
    """A number as its shortest plain text, however it was stored, without trailing or negative zeros; NaN and infinity are errors. exact: it is a decimal, all of whose digits count."""
    double = value.cast("double")
    text = value.cast("string")
    plain = text if exact else F.when(text.try_cast("decimal(38,18)").cast("double") == double, text.try_cast("decimal(38,18)").cast("string")).otherwise(text)
    plain = F.when(plain.contains(".") & ~plain.contains("E"), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(value == 0, F.lit("0")).when(F.isnan(double) | (F.abs(double) == float("inf")), F.raise_error(F.lit("numbers of a version must be finite"))).otherwise(plain)


def content_rank(bars: DataFrame, numbers: Sequence[str], texts: Sequence[str], times: Sequence[str] = ()) -> DataFrame:
    """bars with content_rank, 52 hexadecimal digits of a hash of the content, the same however the row was stored."""
    decimal = {c for c, kind in bars.dtypes if kind.startswith("decimal")}
    fields = {c: plain_number(F.col(c), c in decimal) for c in numbers} | {c: F.col(c).cast("string") for c in texts} | {c: F.unix_millis(F.col(c).cast("timestamp")) for c in times}
    text = F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"})
    return bars.withColumn("content_rank", F.substring(F.sha2(text, 256), 1, 52))


def superseded_counts(raw: DataFrame) -> DataFrame:
    """Stored rows, rows that count, and the difference, in one pass over the keys."""
    groups = raw.groupBy(*RAW_KEY).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("physical_rows"), F.count("*").alias("logical_rows")).withColumn("superseded", F.col("physical_rows") - F.col("logical_rows"))


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str], replace: bool = True) -> DataFrame:
    """current with the updates: they win over equal keys, or are left out where replace is false."""
    if replace:
        return current.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)
    return current.unionByName(updates.join(current.select(*keys), list(keys), "left_anti"))
