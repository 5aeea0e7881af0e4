"""From provider payloads to typed rows, and the tables' readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.scalars import json_safe, market_of, number, text_or_null, utc_ms

RAW_BAR = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("symbol", "market", "bar_interval", "adjustment")]
    + [T.StructField("bar_time", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount", "raw_close", "adjustment_factor")]
    + [T.StructField(c, T.StringType()) for c in ("source", "source_sequence", "raw_artifact_id", "content_rank")]
    + [T.StructField(c, T.TimestampType()) for c in ("observed_at", "ingested_at")]
)
REQUIRED = ("symbol", "market", "bar_interval", "adjustment", "bar_time", "open", "high", "low", "close", "volume", "source", "observed_at", "ingested_at")
NUMBERS = ("open", "high", "low", "close", "volume", "amount", "raw_close", "adjustment_factor")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A typed scan: nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def read_bars(spark: SparkSession, path: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Bars of a month-partitioned table; a time range also prunes the months."""
    rows = spark.read.schema(T.StructType([*RAW_BAR.fields, T.StructField("bar_month", T.StringType())])).parquet(path)
    for bound, low in ((start, True), (end, False)):
        if bound is not None:
            month, at = F.date_format(bound, "yyyyMM"), F.col("bar_time")
            rows = rows.where((F.col("bar_month") >= month) & (at >= bound) if low else (F.col("bar_month") <= month) & (at <= bound))
    return rows


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Month partitions, sorted within files by series and time, so that reads prune by month and skip by symbol."""
    rows = bars.withColumn("bar_month", F.date_format("bar_time", "yyyyMM"))
    rows.repartition("bar_month", F.pmod(F.xxhash64("symbol"), F.lit(16))).sortWithinPartitions("bar_month", "symbol", "bar_interval", "adjustment", "bar_time").write.mode(mode).partitionBy("bar_month").parquet(path)


def replace_partition(rows: DataFrame, path: str, *keys: str) -> None:
    """Overwrite just the partitions that rows hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def normalize_bars(bars: DataFrame) -> DataFrame:
    """Typed bars with error (null: valid): times in UTC milliseconds, finite doubles, all required columns there."""
    times = {c: utc_ms(F.col(c)) for c in ("bar_time", "observed_at", "ingested_at")}
    known = {c for c, kind in bars.dtypes if kind == "double"}  # whose text would only be read back to the same number
    doubles = {c: json_safe(F.col(c)) if c in known else number(F.col(c)) for c in NUMBERS if c in bars.columns}
    typed = bars.withColumns(times | doubles)
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED))
    return typed.withColumn("error", F.when(missing != "", F.concat(F.lit("missing: "), missing)))


def prepare_raw_bars(bars: DataFrame) -> DataFrame:
    """bar_time from text or epoch seconds, observed_at and source_sequence by default from it, market from the symbol."""
    at = F.coalesce(F.col("bar_at").try_cast("timestamp"), F.timestamp_seconds(F.col("epoch")))
    out = bars.withColumn("bar_time", at)
    return out.withColumns({"observed_at": F.coalesce("provenance_at", "bar_time"), "source_sequence": F.coalesce("sequence", F.col("epoch").cast("string")), "market": market_of(F.col("symbol"))})


def explode_envelope(rows: DataFrame, body: str = "body") -> DataFrame:
    """Rows of {"fields": [...], "items": [[...]]} with row_index, symbol, row_date and a map of the fields."""
    parsed = rows.withColumn("_b", F.from_json(body, "fields array<string>, items array<array<string>>"))
    each = parsed.select(*[c for c in rows.columns if c != body], F.col("_b.fields").alias("_f"), F.posexplode("_b.items").alias("row_index", "_i"))
    record = F.map_from_entries(F.filter(F.arrays_zip(F.col("_f").alias("key"), F.col("_i").alias("value")), lambda x: x["key"].isNotNull()))
    out = each.withColumn("record", record).drop("_f", "_i")
    pick = lambda *k: F.coalesce(*(F.col("record")[x] for x in k))
    return out.withColumn("symbol", pick("ts_code", "symbol")).withColumn("row_date", pick("trade_date", "ann_date", "date"))


CHART = "timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>, adjclose array<double>"


def explode_chart(rows: DataFrame, adjusted: bool, body: str = "body") -> DataFrame:
    """Bars of a chart's parallel arrays, one for each timestamp that has a close. adjusted: the adjusted close where there is one, and other prices times it over the raw close."""
    c = F.from_json(body, CHART)
    zipped = F.arrays_zip(*(c[x].alias(x) for x in ("timestamp", "open", "high", "low", "close", "volume", "adjclose")))
    each = rows.select(*[x for x in rows.columns if x != body], F.posexplode(zipped).alias("row_index", "b")).where("b.timestamp IS NOT NULL")
    own = F.col("b.adjclose") if adjusted else F.lit(None).cast("double")
    factor = F.when(own.isNotNull() & (F.col("b.close") != 0), own / F.col("b.close")).otherwise(F.lit(1.0))
    out = each.withColumn("adjustment_factor", factor).withColumn("bar_time", F.timestamp_seconds("b.timestamp"))
    prices = {x: F.col(f"b.{x}") * F.col("adjustment_factor") for x in ("open", "high", "low")}
    return out.withColumns({**prices, "close": F.coalesce(own, "b.close"), "volume": F.col("b.volume"), "raw_close": F.col("b.close")}).where("close IS NOT NULL").drop("b")


def minute_bars(rows: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """Bars of naive local times in UTC, without those that have no close."""
    return rows.where("close IS NOT NULL").withColumn("bar_time", F.to_utc_timestamp(F.col("trade_time").try_cast("timestamp"), zone))


def parse_delimited_quote(rows: DataFrame, line: str = "line") -> DataFrame:
    """Quotes of lines like var x="name,open,previous,price,...": 32 fields and a positive price, else error."""
    parts = F.split(F.regexp_extract(line, '="([^"]*)"', 1), ",")
    out = rows.withColumn("_p", parts)
    at = lambda i: F.get("_p", F.lit(i))
    out = out.withColumns({"name": text_or_null(at(0)), "open": number(at(1)), "previous_close": number(at(2)), "price": number(at(3)), "high": number(at(4)), "low": number(at(5)), "volume": number(at(8)), "amount": number(at(9)), "quote_at": F.concat_ws(" ", at(30), at(31)).try_cast("timestamp")})
    return out.withColumn("error", F.when(F.size("_p") < 32, "too_few_fields").when(~F.coalesce(F.col("price") > 0, F.lit(False)), "no_price")).drop("_p")


def scaled_quote(rows: DataFrame, columns: tuple[str, ...], decimals: str = "decimals") -> DataFrame:
    """Integer fields divided by ten to the decimals; dashes are null."""
    return rows.withColumns({c: number(F.col(c)) / F.pow(F.lit(10.0), F.col(decimals)) for c in columns})


def artifact_rows(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Rows of a JSON body's payload, or of its legacy records, as JSON text with their place."""
    rows = F.coalesce(F.from_json(F.get_json_object(body, "$.payload"), "array<string>"), F.from_json(F.get_json_object(body, "$.records"), "array<string>"))
    return bodies.select(*[c for c in bodies.columns if c != body], F.posexplode(rows).alias("row_index", "record"))
