"""What is stored: coverage, gaps, sources, partitions, and the identity of its content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.scalars import interval_seconds
from tideframe.operators.ranges import before_each, range_size
from tideframe.operators.versions import SERIES


def layers(**frames: DataFrame) -> DataFrame:
    """Frames in one, each with its name as layer."""
    out = None
    for name, frame in frames.items():
        tagged = frame.withColumn("layer", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def unique_symbols(rows: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(count("symbol").alias("symbols"), count("market").alias("markets"))


def artifact_inventory(artifacts: DataFrame, top: int | None = 200) -> DataFrame:
    found = artifacts.groupBy("dataset", "source").agg(F.count("*").alias("artifacts"), F.sum("byte_size").cast("long").alias("bytes"), F.min("ingested_at").alias("first_ingested"), F.max("ingested_at").alias("last_ingested"))
    return found if top is None else found.orderBy(F.col("artifacts").desc(), "dataset", "source").limit(top)


def newest_age(rows: DataFrame, now: Column, time: str = "observed_at") -> DataFrame:
    """Seconds since the newest time; 0 if there are no rows."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.max(time).cast("timestamp"))
    return rows.agg(F.when(F.count("*") == 0, F.lit(0)).otherwise(age).cast("long").alias("age_seconds"))


def rows_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("rows"))


def rollup_rows(rows: DataFrame, *by: str) -> DataFrame:
    """Counts with subtotals."""
    return rows.rollup(*by).agg(F.count("*").alias("rows"))


def symbol_coverage(rows: DataFrame, top: int | None = 200) -> DataFrame:
    first, last = F.min("bar_time"), F.max("bar_time")
    found = rows.groupBy("symbol", "bar_interval").agg(F.count("*").alias("rows"), first.alias("first_time"), last.alias("last_time"), F.datediff(last, first).cast("int").alias("span_days"), F.min("market").alias("market"))
    return found if top is None else found.orderBy(F.col("rows").desc(), "symbol", "bar_interval").limit(top)


def source_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("layer", "source").agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.min("observed_at").alias("first_observed"), F.max("observed_at").alias("last_observed"))


def ingest_per_hour(raw: DataFrame) -> DataFrame:
    return raw.groupBy(F.date_trunc("hour", "ingested_at").cast("timestamp_ntz").alias("hour"), "source").agg(F.count("*").alias("rows"))


def continuity_gaps(bars: DataFrame, top: int | None = 200) -> DataFrame:
    """Series steps longer than 1.5 times the interval (4 times for days): how many, and the longest."""
    order = Window.partitionBy(*SERIES).orderBy("bar_time")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    steps = bars.withColumn("_before", F.lag("bar_time").over(order)).withColumn("_gap", seconds("bar_time") - F.unix_seconds(F.col("_before").cast("timestamp")))
    most = interval_seconds(F.col("bar_interval")) * F.when(F.col("bar_interval") == "1d", F.lit(4.0)).otherwise(F.lit(1.5))
    found = steps.groupBy("symbol", "bar_interval").agg(F.count_if(F.col("_gap") > most).alias("gaps"), F.max(F.when(F.col("_gap") > most, F.col("_gap"))).alias("longest_seconds")).where("gaps > 0")
    return found if top is None else found.orderBy(F.col("gaps").desc(), F.col("longest_seconds").desc(), "symbol").limit(top)


def partition_rows(**frames: DataFrame) -> DataFrame:
    """Rows and months of each table."""
    month = F.date_format("bar_time", "yyyyMM")
    return layers(**{k: v.select(month.alias("bar_month")) for k, v in frames.items()}).groupBy("layer").agg(F.count("*").alias("rows"), F.count_distinct("bar_month").alias("months"))


def filter_values(rows: DataFrame, columns: Sequence[str] = ("market", "bar_interval", "symbol")) -> DataFrame:
    """The distinct values of each column, as (name, value)."""
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns))).alias("x"))
    return pairs.select("x.name", "x.value").distinct()


def _lines(content: Sequence[str], time: str, *more: Column) -> Column:
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in content))
    return F.struct(F.col(time).alias("t"), F.unhex(F.sha2(line, 256)).alias("h"), *more)


def _joined(hashes: Column) -> Column:
    """The hash of the hashes' hexadecimal texts in time order; they come as bytes, half as long in a shuffle."""
    return F.sha2(F.concat_ws("", F.transform(F.sort_array(hashes), lambda r: F.lower(F.hex(r["h"])))), 256)


def dataset_identity(rows: DataFrame, content: Sequence[str], time: str = "bar_time") -> DataFrame:
    """Hash of each series, their number and newest ingestion: rows are hashed in time order by month, then the months' hashes, so an array holds a month."""
    month, lines = F.date_format(time, "yyyyMM"), _lines(content, time)
    joined = lambda c: _joined(F.collect_list(c))
    months = rows.groupBy(*SERIES, month.alias("t")).agg(joined(lines).alias("h"), F.count("*").alias("rows"), F.max("ingested_at").alias("newest"))
    return months.groupBy(*SERIES).agg(F.sum("rows").cast("long").alias("rows"), F.max("newest").alias("newest"), joined(F.struct("t", F.unhex("h").alias("h"))).alias("content_sha256"))


def with_dataset_ids(identity: DataFrame, start: str, end: str) -> DataFrame:
    """dataset_identity() of a time range (ISO texts) with newest_millis, dataset_id (what is asked for) and snapshot_id (what it holds)."""
    out = identity.withColumn("newest_millis", F.coalesce(F.unix_millis(F.col("newest").cast("timestamp")), F.lit(0).cast("long")))
    asked = {"adjustment": F.col("adjustment"), "end": F.lit(end), "interval": F.col("bar_interval"), "start": F.lit(start), "symbol": F.col("symbol")}
    held = asked | {"content_hash": F.concat(F.lit("sha256:"), "content_sha256"), "max_ingested_millis": F.col("newest_millis"), "row_count": F.col("rows")}
    digest = lambda fields: F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items())))), 256)
    return out.withColumn("dataset_id", F.substring(digest(asked), 1, 24)).withColumn("snapshot_id", F.substring(digest(held), 1, 32))


def snapshot_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Series whose identity differs, or that only one side has."""
    b = before.select(*SERIES, F.col("content_sha256").alias("before_sha256"))
    a = after.select(*SERIES, F.col("content_sha256").alias("after_sha256"))
    return b.join(a, list(SERIES), "full_outer").withColumn("changed", ~F.col("before_sha256").eqNullSafe(F.col("after_sha256")))


def changed_since(rows: DataFrame, content: Sequence[str], before: Column, time: str = "bar_time") -> DataFrame:
    """snapshot_changed() from the identity of the rows where before holds to that of all rows, in one pass: a month's rows are hashed once, and joined for either side."""
    lines = F.collect_list(_lines(content, time, F.coalesce(before, F.lit(False)).alias("b")))
    months = rows.groupBy(*SERIES, F.date_format(time, "yyyyMM").alias("t")).agg(lines.alias("_all"))
    early = F.filter("_all", lambda r: r["b"])
    months = months.select(*SERIES, "t", _joined(F.col("_all")).alias("_after"), F.when(F.size(early) > 0, _joined(early)).alias("_before"))
    side = lambda c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct("t", F.unhex(c).alias("h"))))
    both = months.groupBy(*SERIES).agg(side("_before").alias("_b"), side("_after").alias("_a"))
    out = both.select(*SERIES, F.when(F.size("_b") > 0, _joined(F.col("_b"))).alias("before_sha256"), _joined(F.col("_a")).alias("after_sha256"))
    return out.withColumn("changed", ~F.col("before_sha256").eqNullSafe(F.col("after_sha256")))


def page_check(rows: DataFrame, key: Sequence[str] = ("bar_time",)) -> DataFrame:
    """For each series: rows, repeated keys, and keys out of order by arrival (column position)."""
    order = Window.partitionBy(*SERIES).orderBy("position")
    now = F.struct(*key)
    steps = rows.withColumn("_before", F.lag(now).over(order)).withColumn("_now", now)
    return steps.groupBy(*SERIES).agg(F.count("*").alias("rows"), F.count_if(F.col("_now") == F.col("_before")).alias("repeated"), F.count_if(F.col("_now") < F.col("_before")).alias("descending"))


FEW = 1 << 17  # rows that may be sent to every executor, some megabytes


def manifest_check(rows: DataFrame, manifests: DataFrame, span: int | None = None) -> DataFrame:
    """One row (dataset_id, position, rule) for each rule that a row of a page breaks.

    rows: dataset_id, position, instrument_id, interval, adjustment, window_start. manifests: dataset_id, instruments (an array), interval, adjustment,
    start, end. Rows must be of their manifest's instruments, interval, adjustment and time range (ends included), and strictly
    ascend by window_start, then instrument_id, in the order of their positions.
    """
    facts = manifests.select("dataset_id", F.col("interval").alias("_interval"), F.col("adjustment").alias("_adjustment"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    members = manifests.select("dataset_id", F.explode("instruments").alias("instrument_id")).distinct().withColumn("_member", F.lit(True))
    listed = manifests.agg(F.count("*"), F.sum(F.size("instruments"))).first()
    few = F.broadcast if listed[0] + (listed[1] or 0) <= FEW else (lambda d: d)
    size = span or range_size(rows, F.col("position"))
    keyed = rows.withColumn("_range", F.floor(F.col("position") / size)).withColumn("_now", F.struct("window_start", "instrument_id"))
    last = keyed.groupBy("dataset_id", "_range").agg(F.max_by("_now", "position").alias("_last"), F.max("position").alias("_at"))
    past = before_each(last, ["dataset_id"], "_range", "_last", "_at").select("dataset_id", "_range", F.col("before").alias("_past"))
    order = Window.partitionBy("dataset_id", "_range").orderBy("position")
    steps = keyed.join(past, ["dataset_id", "_range"]).withColumn("_before", F.coalesce(F.lag("_now").over(order), "_past"))
    checked = steps.join(few(facts), "dataset_id", "left").join(few(members), ["dataset_id", "instrument_id"], "left")
    same = F.col("interval").eqNullSafe(F.col("_interval")) & F.col("adjustment").eqNullSafe(F.col("_adjustment"))
    rules = (
        (F.col("_member").isNotNull(), "instrument_outside_manifest"),
        (same, "interval_or_adjustment_differs"),
        (F.coalesce(F.col("window_start").between(F.col("_start"), F.col("_end")), F.lit(False)), "window_outside_manifest"),
        (F.col("_before").isNull() | (F.col("_now") > F.col("_before")), "not_strictly_ascending"),
    )
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules)))
    return checked.select("dataset_id", "position", F.explode(broken).alias("rule"))


def page_header_check(pages: DataFrame) -> DataFrame:
    """pages (count, rows, page_size, truncated, next_cursor) with errors, the list of what their headers get wrong."""
    rules = (
        (F.col("count") == F.col("rows"), "count_differs"),
        (F.col("count") <= F.col("page_size"), "page_too_large"),
        (F.col("page_size").between(1, 5000), "invalid_page_size"),
        (F.col("truncated") == F.col("next_cursor").isNotNull(), "cursor_without_rest"),
    )
    return pages.withColumn("errors", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules))))


def normal_number(value: Column) -> Column:
    """15 significant digits, without negative zero."""
    rounded = F.format_string("%.14e", value).cast("double")
    return F.when(value.isNull(), None).when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def dataset_diff(expected: DataFrame, actual: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Field-level differences: (keys, field, expected, actual); a missing row is one line with field '<row>'. Floating-point numbers are compared in their normal form."""

    def texts(df: DataFrame) -> Column:
        floating = {c for c, kind in df.dtypes if kind in ("double", "float")}
        return F.struct(*((normal_number(F.col(c)) if c in floating else F.col(c)).cast("string").alias(c) for c in compared))

    e = expected.select(*keys, texts(expected).alias("_e"))
    a = actual.select(*keys, texts(actual).alias("_a"))
    joined = e.join(a, list(keys), "full_outer")
    fields = [F.when(~F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"_e.{c}").alias("expected"), F.col(f"_a.{c}").alias("actual"))) for c in compared]
    row = F.array(F.struct(F.lit("<row>").alias("field"), F.when(F.col("_e").isNotNull(), "present").alias("expected"), F.when(F.col("_a").isNotNull(), "present").alias("actual")))
    lines = F.when(F.col("_e").isNull() | F.col("_a").isNull(), row).otherwise(F.filter(F.array(*fields), lambda x: x.isNotNull()))
    return joined.select(*keys, F.explode(lines).alias("x")).select(*keys, "x.*")
