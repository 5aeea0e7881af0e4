"""Queries over realtime events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import realtime, versions
from tideframe.plans import bars  # noqa: F401  (registers incremental_rebuild)
from tideframe.plans.registry import ORACLES, query, work_folder
from tideframe.sources.fixtures import table, view
from tideframe.streaming import canonical as upkeep
from tideframe.streaming import trades as stream

HOUR = 3600
WINDOWED = "w AS (SELECT *, CAST(floor(epoch(ts_event) / 3600) * 3600 AS BIGINT) AS win FROM fx_trade), l AS (SELECT *, coalesce(max(win) OVER (PARTITION BY instrument_id, source, session ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > win, FALSE) AS late FROM w)"
BARS = 'SELECT instrument_id, source, session, win AS "window", arg_min(price, arrival_seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, arrival_seq) AS close, sum(size) AS volume, count(*) AS trades FROM l WHERE NOT late GROUP BY ALL'


def trades(spark, sf_dir):
    """Trades with a strict order of arrival."""
    return view(spark, sf_dir, "fx_trade").withColumn("arrival_seq", F.col("arrival_seq") * 2 + (F.col("sequence") % 10 == 0).cast("int"))


def strict(sql: str) -> str:
    """The same order of arrival for the oracle."""
    return sql.replace("FROM fx_trade)", "FROM (SELECT * REPLACE (arrival_seq * 2 + CASE WHEN sequence % 10 = 0 THEN 1 ELSE 0 END AS arrival_seq) FROM fx_trade))")


@query("trade_bars", strict(f"WITH {WINDOWED} {BARS}"))
def trade_bars(spark, sf_dir):
    return realtime.trade_bars(trades(spark, sf_dir), HOUR)


@query("late_trades", strict(f"WITH {WINDOWED} SELECT sequence, instrument_id, session, win AS \"window\", 'late_trade_dropped' AS reason FROM l WHERE late"))
def late_trades(spark, sf_dir):
    return realtime.late_trades(trades(spark, sf_dir), HOUR).select("sequence", "instrument_id", "session", "window", "reason")


SLICES, LATENESS = 3, 20  # runs of the stream, and days that the watermark stays behind


def in_slices(spark, rows, order, start):
    """Appends rows to a folder slice by slice of their order, and lets start(stream of the folder) run to its end after each."""
    top = work_folder(spark, "stream")
    last = rows.agg(F.max(order)).first()[0] or 0
    number = F.floor(F.col(order) * SLICES / (last + 1))
    for k in range(SLICES):
        rows.where(number == k).write.mode("append").parquet(f"{top}/in")
        start(stream.events_stream(spark, f"{top}/in", rows.schema), top)
    return top


def _streamed(spark, sf_dir):
    """All trades as a file stream in order of arrival, into a table of the shared folder."""

    def run(source, top):
        bars_ = stream.trade_bar_stream(source, HOUR, f"{LATENESS} days")
        stream.run_to_end(stream.bars_sink(bars_, f"{top}/out", f"{top}/checkpoint"), spark)

    top = in_slices(spark, trades(spark, sf_dir), "arrival_seq", run)
    return spark.read.schema(stream.OUTPUT).parquet(f"{top}/out")


@query("stream_late_trades", strict(f"WITH {WINDOWED} SELECT instrument_id, session, win AS \"window\", arrival_seq FROM l WHERE late"))
def stream_late_trades(spark, sf_dir):
    return _streamed(spark, sf_dir).where("kind = 'late_trade_dropped'").select("instrument_id", "session", "window", "arrival_seq")


# A key's newest bar is still open while the stream's watermark hasn't passed its end.
CLOSED = f'WITH {WINDOWED}, b AS ({BARS}) SELECT * FROM b QUALIFY "window" < max("window") OVER (PARTITION BY instrument_id, source, session) OR "window" + 3600 <= (SELECT max(epoch(ts_event)) FROM fx_trade) - {LATENESS} * 86400'


@query("stream_trade_bars", strict(CLOSED))
def stream_trade_bars(spark, sf_dir):
    return _streamed(spark, sf_dir).where("kind = 'bar'").select(*realtime.BAR_KEY, "window", "open", "high", "low", "close", "volume", "trades")


@query("stream_distinct_trades", "SELECT concat('S', CAST(sequence % 40 AS VARCHAR)) AS symbol, sequence, CAST(1 AS BIGINT) AS pushes FROM fx_trade")
def stream_distinct_trades(spark, sf_dir):
    """Trades, every seventh pushed twice and every 21st three times in a row, as a stream that lets each through once."""
    rows = view(spark, sf_dir, "fx_trade").select(F.concat(F.lit("S"), (F.col("sequence") % 40).cast("string")).alias("symbol"), F.col("ts_event").cast("timestamp").alias("ts_event"), "sequence", "price", "size")
    times = F.when(F.col("sequence") % 21 == 0, 3).when(F.col("sequence") % 7 == 0, 2).otherwise(1)
    pushes = rows.select("*", F.explode(F.sequence(F.lit(1), times)).alias("_push")).drop("_push")

    def run(source, top):
        named = realtime.trade_id(source.select("*", F.col("sequence").cast("string").alias("ts_text"), F.col("price").cast("string").alias("price_text"), F.col("size").cast("string").alias("volume_text"), F.lit("Up").alias("direction"), F.lit(0).alias("batch_index")))
        stream.run_to_end(stream.bars_sink(stream.distinct_trades(named, f"{LATENESS} days"), f"{top}/out", f"{top}/checkpoint"))

    top = in_slices(spark, pushes, "sequence", run)
    out = spark.read.parquet(f"{top}/out")
    return out.groupBy("symbol", "sequence").agg(F.count("*").alias("pushes"))


@query("sequence_gaps", "WITH e AS (SELECT instrument_id AS stream_id, sequence, lag(sequence) OVER (PARTITION BY instrument_id ORDER BY sequence) AS before FROM fx_trade) SELECT stream_id, before + 1 AS gap_start, sequence - 1 AS gap_end, sequence - before - 1 AS missing FROM e WHERE sequence > before + 1")
def sequence_gaps(spark, sf_dir):
    return realtime.sequence_gaps(view(spark, sf_dir, "fx_trade").withColumnRenamed("instrument_id", "stream_id"))


SUBSCRIBED = "s AS (SELECT DISTINCT concat('c', CAST(s_nationkey % 3 AS VARCHAR)) AS subscriber, concat('I', CAST(s_nationkey % 5 AS VARCHAR), '.XSIM') AS instrument_id, CASE s_suppkey % 2 WHEN 0 THEN 'view' ELSE 'click' END AS event_type FROM supplier)"


def envelope(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), F.concat(F.lit("I"), (F.col("user_id") % 5).cast("string"), F.lit(".XSIM")).alias("instrument_id"), F.when(F.col("event_type") == "error", "status").otherwise(F.col("event_type")).alias("event_type"))


@query(
    "filtered_delivery",
    f"""WITH {SUBSCRIBED}, e AS (SELECT event_id AS sequence, concat('I', CAST(user_id % 5 AS VARCHAR), '.XSIM') AS instrument_id, CASE event_type WHEN 'error' THEN 'status' ELSE event_type END AS event_type FROM events),
f AS (SELECT c.subscriber, e.sequence, e.event_type, e.event_type = 'status' OR EXISTS (SELECT 1 FROM s WHERE s.subscriber = c.subscriber AND s.instrument_id = e.instrument_id AND s.event_type = e.event_type) AS full_event FROM e, (SELECT DISTINCT subscriber FROM s) c)
SELECT subscriber, sequence, CASE WHEN full_event THEN event_type ELSE 'watermark' END AS delivered, CASE WHEN NOT full_event THEN 'filtered' END AS reason FROM f""",
)
def filtered_delivery(spark, sf_dir):
    return realtime.filtered_delivery(envelope(spark, sf_dir), subscriptions(spark, sf_dir))


def subscriptions(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), (F.col("s_nationkey") % 3).cast("string")).alias("subscriber"), F.concat(F.lit("I"), (F.col("s_nationkey") % 5).cast("string"), F.lit(".XSIM")).alias("instrument_id"), F.when(F.col("s_suppkey") % 2 == 0, "view").otherwise("click").alias("event_type")).distinct()


@query(
    "delivery_runs",
    f"""WITH {SUBSCRIBED}, e AS (SELECT event_id AS sequence, concat('I', CAST(user_id % 5 AS VARCHAR), '.XSIM') AS instrument_id, CASE event_type WHEN 'error' THEN 'status' ELSE event_type END AS event_type FROM events),
f AS (SELECT c.subscriber, e.sequence, e.event_type, e.event_type = 'status' OR EXISTS (SELECT 1 FROM s WHERE s.subscriber = c.subscriber AND s.instrument_id = e.instrument_id AND s.event_type = e.event_type) AS full_event FROM e, (SELECT DISTINCT subscriber FROM s) c),
g AS (SELECT *, sequence - row_number() OVER (PARTITION BY subscriber, full_event ORDER BY sequence) AS run FROM f)
SELECT subscriber, sequence AS first_sequence, sequence AS last_sequence, event_type AS delivered, NULL AS reason FROM f WHERE full_event
UNION ALL SELECT subscriber, min(sequence), max(sequence), 'watermark', 'filtered' FROM g WHERE NOT full_event GROUP BY subscriber, run""",
)
def delivery_runs(spark, sf_dir):
    return realtime.delivery_runs(envelope(spark, sf_dir), subscriptions(spark, sf_dir))


@query("replay_from", "SELECT event_id AS sequence, (SELECT max(event_id) FROM events) - 500 <= 4096 AS complete FROM events WHERE event_id > 500")
def replay_from(spark, sf_dir):
    return realtime.replay_from(envelope(spark, sf_dir), 500).select("sequence", "complete")


CHECKED = "c AS (SELECT sequence, array_to_string(list_filter([CASE WHEN sequence % 11 = 0 THEN 'clock_order' END, CASE WHEN NOT (price > 0.5) THEN 'trade_not_positive' END], lambda x: x IS NOT NULL), ',') AS errors FROM fx_trade)"


def clocked(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_trade").withColumn("event_type", F.lit("trade")).withColumn("ts_ingest", F.col("ts_event")).withColumn("price", F.col("price") - 0.5)
    return rows.withColumn("ts_publish", F.expr("CASE WHEN sequence % 11 = 0 THEN ts_event - INTERVAL '1' SECOND ELSE ts_event END"))


@query("validate_events", f"WITH {CHECKED} SELECT sequence, errors FROM c")
def validate_events(spark, sf_dir):
    return realtime.validate_events(clocked(spark, sf_dir)).select("sequence", F.array_join("errors", ",").alias("errors"))


@query("reject_invalid", f"WITH {CHECKED} SELECT sequence, CASE WHEN errors = '' THEN 'trade' ELSE 'status' END AS event_type, CASE WHEN errors = '' THEN 'ok' ELSE 'degraded' END AS quality FROM c")
def reject_invalid(spark, sf_dir):
    return realtime.reject_invalid(clocked(spark, sf_dir)).select("sequence", "event_type", "quality")


@query(
    "trade_id",
    """SELECT sequence, concat('longport:', sha256(concat('{"direction":"', CASE sequence % 3 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Sell' ELSE 'Neutral' END, '","index":', sequence % 4, ',"price":"', CAST(price AS DECIMAL(18, 2)),
'","symbol":"', instrument_id, '","timestamp":"', sequence, '","volume":"', CAST(size AS BIGINT), '"}'))) AS trade_id, CASE sequence % 3 WHEN 0 THEN 'BUYER' WHEN 1 THEN 'SELLER' ELSE 'NO_AGGRESSOR' END AS aggressor_side FROM fx_trade""",
)
def trade_id(spark, sf_dir):
    direction = F.expr("CASE sequence % 3 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Sell' ELSE 'Neutral' END")
    rows = view(spark, sf_dir, "fx_trade").select("sequence", F.col("instrument_id").alias("symbol"), F.col("sequence").cast("string").alias("ts_text"), F.col("price").cast("decimal(18,2)").cast("string").alias("price_text"), F.col("size").cast("long").cast("string").alias("volume_text"), direction.alias("direction"), (F.col("sequence") % 4).alias("batch_index"))
    return realtime.trade_id(rows).select("sequence", "trade_id", "aggressor_side")


@query("depth_to_events", "SELECT event_id, 'order_book' AS event_type, value AS bid, CASE WHEN event_id % 3 > 0 THEN value + 1 END AS ask FROM events UNION ALL SELECT event_id, 'quote', value, value + 1 FROM events WHERE event_id % 3 > 0")
def depth_to_events(spark, sf_dir):
    level = lambda p: F.array(F.struct(p.alias("price"), F.lit(1.0).alias("size")))
    none = F.filter(level(F.col("value")), lambda x: F.lit(False))
    rows = table(spark, sf_dir, "events").select("event_id", level(F.col("value")).alias("bids"), F.when(F.col("event_id") % 3 > 0, level(F.col("value") + 1)).otherwise(none).alias("asks"))
    return realtime.depth_to_events(rows).select("event_id", "event_type", "bid", "ask")


RAW_SESSIONS = "CASE event_id % 6 WHEN 0 THEN 'Overnight' WHEN 1 THEN 'PreMarket' WHEN 2 THEN 'PostMarket' WHEN 3 THEN 'Normal' WHEN 4 THEN 'Auction' END"


@query("session_filter", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'overnight' WHEN 1 THEN 'pre_market' WHEN 2 THEN 'post_market' WHEN 4 THEN 'unknown' ELSE 'regular' END AS session, event_id % 6 = 0 AS rejected FROM events")
def session_filter(spark, sf_dir):
    return realtime.session_filter(table(spark, sf_dir, "events").select("event_id", F.expr(RAW_SESSIONS).alias("raw_session"))).select("event_id", "session", "rejected")


@query("stream_canonical", "SELECT bar_time, count(DISTINCT symbol) AS bars FROM fx_raw_bar GROUP BY 1")
def stream_canonical(spark, sf_dir):
    return stream_canonical_rows(spark, sf_dir).groupBy("bar_time").agg(F.count_distinct("symbol").alias("bars"))


@query("stream_canonical_rows")
def stream_canonical_rows(spark, sf_dir):
    """All raw bars in two batches: those ingested from 2000 on arrive after the rest and refresh what they touch."""
    top = work_folder(spark, "stream")
    rows = view(spark, sf_dir, "fx_raw_bar")
    late = F.col("ingested_at") >= F.lit("2000-01-01").cast("timestamp_ntz")
    for part in (rows.where(~late), rows.where(late)):
        part.write.mode("append").parquet(f"{top}/in")
        source = stream.events_stream(spark, f"{top}/in", rows.schema)
        stream.run_to_end(upkeep.canonical_stream(source, f"{top}/store", f"{top}/checkpoint", buckets=2))
    return upkeep.read_canonical(spark, f"{top}/store").select("symbol", "bar_interval", "adjustment", "bar_time", "close", "source", "version")


ORACLES["stream_canonical_rows"] = ORACLES["incremental_rebuild"]  # the same rows, built in batch


@query("windowed_bars", strict(f"WITH {WINDOWED} {BARS.replace('WHERE NOT late ', '')}"))
def windowed_bars(spark, sf_dir):
    out = stream.windowed_bars(trades(spark, sf_dir), HOUR, "1 day")
    return out.select(*realtime.BAR_KEY, F.unix_seconds("w.start").alias("window"), "open", "high", "low", "close", "volume", "trades")


@query("stream_latest_quotes", "SELECT symbol, source, price, ingested_at FROM fx_quote QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ingested_at DESC, content_rank DESC) = 1")
def stream_latest_quotes(spark, sf_dir):
    """All quotes as one stream; each batch stores the quotes that it changed, and the newest of them stands."""
    top = work_folder(spark, "quotes")
    rows = view(spark, sf_dir, "fx_quote")
    rows.write.parquet(f"{top}/in")
    source = stream.events_stream(spark, f"{top}/in", rows.schema)
    stream.run_to_end(stream.bars_sink(stream.latest_quote_stream(source), f"{top}/out", f"{top}/checkpoint").outputMode("update"))
    return versions.latest_quotes(spark.read.schema(rows.schema).parquet(f"{top}/out")).select("symbol", "source", "price", "ingested_at")
