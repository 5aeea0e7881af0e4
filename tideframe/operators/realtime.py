"""Realtime events in batch form: trade bars, late trades, event checks, gaps, delivery. The stateful stream is in streaming/."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators.ranges import before_each, range_size

BAR_KEY = ("instrument_id", "source", "session")
# Event types that every subscriber gets.
STATUS_TYPES = ("status",)


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the UTC window that holds ts, in epoch seconds."""
    return (F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")


def with_lateness(trades: DataFrame, seconds: int, span: int | None = None) -> DataFrame:
    """trades with window (epoch seconds) and late: its key had already opened a newer window when it arrived.

    Arrivals go by ranges of span numbers (by default as many as hold some ten thousand trades). The newest window of a key's earlier ranges
    comes from the ranges' maxima, that of earlier arrivals in the range from a window over it, so a busy key is spread over all tasks.
    """
    size = span or range_size(trades, F.col("arrival_seq"))
    rows = trades.withColumn("window", window_start(F.col("ts_event"), seconds)).withColumn("_range", F.floor(F.col("arrival_seq") / size))
    newest = rows.groupBy(*BAR_KEY, "_range").agg(F.max("window").alias("_newest"))
    known = before_each(newest, BAR_KEY, "_range", "_newest", "_newest").select(*(F.col(k).alias(f"_{k}") for k in BAR_KEY), F.col("_range").alias("_at"), F.col("before").alias("_past"))
    same = F.col("_range") == F.col("_at")
    for k in BAR_KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    earlier = Window.partitionBy(*BAR_KEY, "_range").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(known, same, "left").withColumn("_newest", F.greatest(F.max("window").over(earlier), "_past"))
    return out.withColumn("late", F.coalesce(F.col("_newest") > F.col("window"), F.lit(False))).select(*trades.columns, "window", "late")


def trade_bars(trades: DataFrame, seconds: int, with_late: bool = False) -> DataFrame:
    """Bars of each instrument, source and session; open and close by arrival. Late trades are left out unless wanted."""
    rows = trades.withColumn("window", window_start(F.col("ts_event"), seconds)) if with_late else with_lateness(trades, seconds).where("NOT late")
    return rows.groupBy(*BAR_KEY, "window").agg(
        F.min_by("price", "arrival_seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "arrival_seq").alias("close"),
        F.sum(F.col("size").cast("decimal(28,6)")).cast("double").alias("volume"), F.count("*").alias("trades"),
    )


def late_trades(trades: DataFrame, seconds: int) -> DataFrame:
    return with_lateness(trades, seconds).where("late").withColumn("reason", F.lit("late_trade_dropped"))


def validate_events(events: DataFrame) -> DataFrame:
    """events with errors: clocks in order, and what the type of payload asks for. Stateless, so fit for streams."""
    number = lambda c: F.col(c).cast("double")
    has = lambda c: c in events.columns
    checks = [((F.col("ts_event") <= F.col("ts_ingest")) & (F.col("ts_ingest") <= F.col("ts_publish")), "clock_order")]
    kind = F.col("event_type")
    if has("price"):
        checks.append((~(kind == "trade") | ((number("price") > 0) & (number("size") > 0)), "trade_not_positive"))
    if has("bid"):
        checks.append((~(kind == "quote") | ((number("bid") > 0) & (number("ask") >= number("bid"))), "quote_crossed"))
    if has("high"):
        inside = (number("low") <= F.least(number("open"), number("close"))) & (number("high") >= F.greatest(number("open"), number("close")))
        checks.append((~(kind == "bar") | inside, "bar_inconsistent"))
    if has("bids"):
        checks.append((~(kind == "book") | ((F.size("bids") <= 1) & (F.size("asks") <= 1)), "book_too_deep"))
    return events.withColumn("errors", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks))))


def reject_invalid(events: DataFrame) -> DataFrame:
    """events, invalid ones turned into degraded status events of the same sequence, so that no number is missing."""
    checked = validate_events(events)
    bad = F.size("errors") > 0
    return checked.withColumn("quality", F.when(bad, "degraded").otherwise("ok")).withColumn("event_type", F.when(bad, "status").otherwise(F.col("event_type")))


def sequence_gaps(events: DataFrame, key: str = "stream_id") -> DataFrame:
    """Missing stretches of each stream's sequence."""
    order = Window.partitionBy(key).orderBy("sequence")
    steps = events.withColumn("_before", F.lag("sequence").over(order)).where(F.col("sequence") > F.col("_before") + 1)
    return steps.select(key, (F.col("_before") + 1).alias("gap_start"), (F.col("sequence") - 1).alias("gap_end"), (F.col("sequence") - F.col("_before") - 1).alias("missing"))


def delivery_runs(events: DataFrame, subscriptions: DataFrame, span: int | None = None) -> DataFrame:
    """Each subscriber's stream, run by run: first_sequence, last_sequence, delivered and reason.

    A full event (subscribed, or a status) is a run of its own; the sequences between two of them are one run, delivered as a
    watermark. So the result grows with the matches, not with subscribers times events. subscriptions: (subscriber, instrument_id, event_type).
    """
    kinds = F.col("event_type").isin(*STATUS_TYPES)
    named = subscriptions.select("subscriber").distinct()
    wanted = events.where(~kinds).join(subscriptions.select("subscriber", "instrument_id", "event_type").distinct(), ["instrument_id", "event_type"])
    statuses = events.where(kinds).select(F.lit(0).alias("_all"), "sequence", "event_type").join(named.withColumn("_all", F.lit(0)), "_all")
    full = wanted.select("subscriber", "sequence", "event_type").union(statuses.select("subscriber", "sequence", "event_type"))
    ends = events.agg((F.min("sequence") - 1).alias("low"), (F.max("sequence") + 1).alias("high")).first()
    if ends.low is None:
        return full.select("subscriber", F.col("sequence").alias("first_sequence"), F.col("sequence").alias("last_sequence"), F.col("event_type").alias("delivered"), F.lit(None).cast("string").alias("reason"))
    # one more row behind each subscriber's last event, whose run goes to the end of the stream
    marked = full.union(named.select("subscriber", F.lit(ends.high).cast("long"), F.lit(None).cast("string")))
    size = span or range_size(events, F.col("sequence"))
    rows = marked.withColumn("_range", F.floor(F.col("sequence") / size))
    last = before_each(rows.groupBy("subscriber", "_range").agg(F.max("sequence").alias("_last")), ["subscriber"], "_range", "_last", "_last")
    order = Window.partitionBy("subscriber", "_range").orderBy("sequence")
    steps = rows.join(last.select("subscriber", "_range", "before"), ["subscriber", "_range"])
    steps = steps.withColumn("_before", F.coalesce(F.lag("sequence").over(order), "before", F.lit(ends.low)))
    event = F.when(F.col("sequence") < ends.high, F.struct(F.col("sequence").alias("first_sequence"), F.col("sequence").alias("last_sequence"), F.col("event_type").alias("delivered"), F.lit(None).cast("string").alias("reason")))
    gap = F.when(
        F.col("sequence") - F.col("_before") > 1,
        F.struct((F.col("_before") + 1).alias("first_sequence"), (F.col("sequence") - 1).alias("last_sequence"), F.lit("watermark").alias("delivered"), F.lit("filtered").alias("reason")),
    )
    return steps.select("subscriber", F.explode(F.array_compact(F.array(gap, event))).alias("r")).select("subscriber", "r.*")


def filtered_delivery(events: DataFrame, subscriptions: DataFrame, span: int | None = None) -> DataFrame:
    """delivery_runs() with a row for each of the stream's sequences: the runs that are filtered are written out."""
    runs = delivery_runs(events, subscriptions, span)
    own = runs.where("reason IS NULL").select("subscriber", F.col("first_sequence").alias("sequence"), "delivered", "reason")
    each = runs.where("reason IS NOT NULL").select("subscriber", F.explode(F.sequence("first_sequence", "last_sequence")).alias("sequence"), "delivered", "reason")
    there = events.select("sequence").distinct()  # numbers that no event has are in no stream
    return own.unionByName(each.join(there, "sequence", "left_semi"))


def replay_from(events: DataFrame, after: int, retained: int = 4096) -> DataFrame:
    """Events after a sequence, with whether the stream still holds all of them."""
    last = events.agg(F.max("sequence").alias("_last"))
    out = events.join(F.broadcast(last), F.lit(True)).where(F.col("sequence") > after)
    return out.withColumn("complete", F.col("_last") - after <= retained).drop("_last")


def trade_id(trades: DataFrame) -> DataFrame:
    """trades with trade_id, a hash of what a push says, and the aggressor's side.

    A push has symbol, ts_text (ISO), price_text, volume_text, direction and batch_index. Hashed is its compact JSON with sorted
    names, so an id is the same wherever it is made.
    """
    push = F.struct(
        F.coalesce(F.col("direction").cast("string"), F.lit("None")).alias("direction"), F.col("batch_index").cast("long").alias("index"), F.col("price_text").alias("price"), F.col("symbol"), F.col("ts_text").alias("timestamp"), F.col("volume_text").alias("volume"),
    )
    side = F.upper(F.coalesce(F.col("direction").cast("string"), F.lit("")))
    out = trades.withColumn("trade_id", F.concat(F.lit("longport:"), F.sha2(F.to_json(push, {"ignoreNullFields": "false"}), 256)))
    return out.withColumn("aggressor_side", F.when(side.contains("BUY"), "BUYER").when(side.contains("SELL"), "SELLER").otherwise("NO_AGGRESSOR"))


def depth_to_events(depth: DataFrame) -> DataFrame:
    """A depth push (bids, asks arrays of struct(price, size)) as a book event of one level, and a quote if both sides are there."""
    bid, ask = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    book = F.struct(F.lit("order_book").alias("event_type"), bid["price"].alias("bid"), ask["price"].alias("ask"), F.lit("degraded").alias("quality"))
    quote = F.when(bid.isNotNull() & ask.isNotNull(), F.struct(F.lit("quote").alias("event_type"), bid["price"].alias("bid"), ask["price"].alias("ask"), F.lit("degraded").alias("quality")))
    rest = [c for c in depth.columns if c not in ("bids", "asks")]
    return depth.select(*rest, F.explode(F.array_compact(F.array(book, quote))).alias("e")).select(*rest, "e.*")


def session_filter(events: DataFrame, overnight: bool = False, raw: str = "raw_session") -> DataFrame:
    """events with session (what isn't known is unknown, not regular), and rejected for overnight ones unless these are enabled."""
    text = F.lower(F.coalesce(raw, F.lit("")))
    session = F.when(text.contains("pre"), "pre_market").when(text.contains("post"), "post_market").when(text.contains("overnight"), "overnight").when(text.isin("", "normal", "regular"), "regular").otherwise("unknown")
    return events.withColumn("session", session).withColumn("rejected", (F.col("session") == "overnight") & F.lit(not overnight))
