"""Point-in-time reads: the latest row at or before a time, and what was knowable then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators.ranges import before_each, range_size
from tideframe.operators.versions import newest


def bars_as_of(bars: DataFrame, point: Column, lookback: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The latest bar of each key within lookback seconds before point, both ends included."""
    low = point - F.make_dt_interval(secs=F.lit(lookback))  # of the point's own type, so that both bounds reach the scan
    inside = (F.col("bar_time") <= point) & (F.col("bar_time") >= low)
    return newest(bars.where(inside), keys, ("bar_time",))


def with_effective_time(bars: DataFrame, point: Column) -> DataFrame:
    """effective_bar_at, staleness_seconds (0 at least) and whether the bar is of the point's very second."""
    age = F.unix_seconds(point.cast("timestamp")) - F.unix_seconds(F.col("bar_time").cast("timestamp"))
    out = bars.withColumn("effective_bar_at", F.col("bar_time")).withColumn("staleness_seconds", F.greatest(F.lit(0).cast("long"), age))
    return out.withColumn("match_kind", F.when(F.col("staleness_seconds") == 0, "exact").otherwise("prior_within_lookback"))


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _span(tolerance: int) -> int:
    return 16 * max(tolerance, 1)


def in_spans(rows: DataFrame, time: str, tolerance: int) -> DataFrame:
    """rows with _span, the span of 16 tolerances that their time is in; those that reach into the next span are in that one too."""
    reach = F.array(F.floor(_seconds(time) / _span(tolerance)), F.floor((_seconds(time) + tolerance) / _span(tolerance)))
    return rows.withColumn("_span", F.explode(F.array_distinct(reach)))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tolerance: int | None = None, span: int | None = None, spanned: bool = False) -> DataFrame:
    """left with the values of the latest row of right at or before its time, within tolerance seconds.

    Both sides go through one window in time order, rows of right first on equal times, so the work is linear:
    no range join. The carried struct is the last one seen. Series are cut into spans of time, so that no task holds a whole one: with a
    tolerance into spans of 16 tolerances, where a row of right that reaches into the next span is put there too; without one
    into spans of some ten thousand rows, where the last row before a span is put at its beginning.
    spanned: right is in the spans of the tolerance (in_spans()) and dealt out by keys and _span, so only left, which has no _span of its own, is shuffled.
    """
    carried = F.struct(F.col(right_time).alias("matched_time"), *values)
    if tolerance is None:
        span = span or range_size(right, _seconds(right_time))
        rows = right.withColumn("_span", F.floor(_seconds(right_time) / span))
    else:
        span = _span(tolerance)
        rows = right if spanned else in_spans(right, right_time, tolerance)
    rows = rows.select(*by, "_span", F.col(right_time).alias("_time"), F.lit(0).alias("_side"), carried.alias("_value"))
    own = [c for c in left.columns if c not in by]
    spot = F.floor(_seconds(left_time) / span)
    if spanned:
        left, spot = left.withColumn("_span", spot).repartition(*by, "_span"), F.col("_span")
    points = left.select(*by, spot.alias("_span"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*own).alias("_left"))
    if tolerance is None:
        last = rows.groupBy(*by, "_span").agg(F.max("_time").alias("_time"), F.max_by("_value", "_time").alias("_value"))
        asked = points.select(*by, "_span").distinct()
        spans = last.unionByName(asked, allowMissingColumns=True).groupBy(*by, "_span").agg(F.max("_time").alias("_time"), F.max_by("_value", "_time").alias("_value"))
        first = before_each(spans, by, "_span", "_value", "_time").where("before IS NOT NULL")
        rows = rows.unionByName(first.select(*by, "_span", F.col("before.matched_time").alias("_time"), F.lit(0).alias("_side"), F.col("before").alias("_value")))
    both = rows.unionByName(points, allowMissingColumns=True)
    order = Window.partitionBy(*by, "_span").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = both.withColumn("_match", F.last("_value", ignorenulls=True).over(order)).where("_side = 1")
    if tolerance is not None:
        near = _seconds("_time") - _seconds("_match.matched_time") <= tolerance
        joined = joined.withColumn("_match", F.when(near, F.col("_match")))
    return joined.select(*by, "_left.*", "_match.matched_time", *(F.col(f"_match.{v}").alias(v) for v in values))


def bars_at(bars: DataFrame, points: DataFrame, lookback: int, keys: Sequence[str] = ("symbol",), time: str = "as_of", spanned: bool = False) -> DataFrame:
    """points (keys and a time, any number of rows) each with its key's latest bar within lookback seconds before it, if there is one.

    effective_bar_at, staleness_seconds and match_kind say how old the bar is; they are null, and match_kind is missing, without one.
    spanned: as in asof_join().
    """
    values = [c for c in bars.columns if c not in (*keys, "bar_time") and not (spanned and c == "_span")]
    found = asof_join(points, bars, keys, time, "bar_time", values, lookback, spanned=spanned).withColumnRenamed("matched_time", "effective_bar_at")
    age = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.col("effective_bar_at").cast("timestamp"))
    kind = F.when(age.isNull(), "missing").when(age == 0, "exact").otherwise("prior_within_lookback")
    return found.withColumn("staleness_seconds", age.cast("long")).withColumn("match_kind", kind)


def knowable(history: DataFrame, as_of: str) -> DataFrame:
    """Rows published, and observed by us, on or before a date (ISO text)."""
    clocks = [c for c in ("observed_at", "ingested_at", "fetched_at") if c in history.columns]
    return history.where((F.col("published_at") <= as_of) & (F.to_date(F.coalesce(*clocks)) <= F.lit(as_of).cast("date")))


def revisions(history: DataFrame, keys: Sequence[str] = ("symbol", "report_period")) -> DataFrame:
    """The latest revision of each key."""
    clocks = [c for c in ("ingested_at", "fetched_at") if c in history.columns]
    ranked = history.withColumn("_clock", F.coalesce(*clocks))
    return newest(ranked, keys, ("_clock", "version_id")).drop("_clock")


def latest_period(rows: DataFrame) -> DataFrame:
    """Each symbol's row of its latest period."""
    return newest(rows, ("symbol",), ("report_period",))


def fundamentals_pit(history: DataFrame, as_of: str) -> DataFrame:
    """What was known at a date of each symbol's latest period known then. Filters belong after it."""
    return latest_period(revisions(knowable(history, as_of)))


def history_pit(history: DataFrame, as_of: str, annual_only: bool = False) -> DataFrame:
    """The latest revision known at a date of every period, or of year ends only."""
    rows = knowable(history, as_of)
    return revisions(rows.where(F.col("report_period").endswith("1231")) if annual_only else rows)


def statements_as_of(rows: DataFrame, as_of: str, statement: str, periods: int) -> DataFrame:
    """The newest periods of a statement that were known at a date."""
    order = Window.partitionBy("symbol").orderBy(F.col("report_date").desc(), F.col("source"))
    known = knowable(rows, as_of).where(F.col("statement") == statement)
    return known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= periods).drop("_n")


def instrument_valid(definitions: DataFrame) -> DataFrame:
    """The newest definition of each instrument among those whose event isn't after its arrival."""
    return newest(definitions.where("ts_event <= ts_init"), ("instrument_id",), ("ts_init",))
