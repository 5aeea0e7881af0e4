"""Queries over calendars, instruments, providers, artifacts, quotes and ingest transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions import scalars
from tideframe.operators import bars, inventory, quotes, reference_data, versions
from tideframe.plans.registry import query
from tideframe.sources import ingest
from tideframe.sources.fixtures import table, view

NOW = "2024-02-01 00:00:00"


@query("economic_calendar", "SELECT event_id, country, event_date, event_time, event_name, impact, actual FROM fx_calendar WHERE event_date BETWEEN '2024-01-05' AND '2024-01-20' AND country = 'US' AND impact = 'High' ORDER BY event_date, event_time, event_id LIMIT 300")
def economic_calendar(spark, sf_dir):
    return reference_data.economic_calendar(view(spark, sf_dir, "fx_calendar"), "2024-01-05", "2024-01-20", "US", "High", 300).select("event_id", "country", "event_date", "event_time", "event_name", "impact", "actual")


@query("earnings_calendar", "SELECT event_id, country AS market, event_date FROM fx_calendar WHERE event_date BETWEEN '2024-01-05' AND '2024-01-20' AND country = 'CN' AND event_name IN (SELECT DISTINCT event_type FROM events WHERE value > 50)")
def earnings_calendar(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_calendar").select("event_id", F.col("country").alias("market"), "event_date", F.col("event_name").alias("symbol"))
    want = table(spark, sf_dir, "events").where("value > 50").select(F.col("event_type").alias("symbol")).distinct()
    return reference_data.earnings_calendar(rows, "2024-01-05", "2024-01-20", "CN", want).select("event_id", "market", "event_date")


@query("indicators", "SELECT event_name AS name, country, max(event_date) AS latest_date, count(*) AS n FROM fx_calendar WHERE country = 'US' GROUP BY ALL")
def indicators(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_calendar").groupBy(F.col("event_name").alias("name"), "country").agg(F.max("event_date").alias("latest_date"), F.count("*").alias("n"))
    return reference_data.indicators(rows, country="US")


@query("normalize_event", "SELECT event_id AS row_id, substr(sha256(concat_ws('|', lower(country), event_date, event_time, lower(event_name), source)), 1, 24) AS event_id, CASE country WHEN 'US' THEN 'America/New_York' ELSE 'Asia/Shanghai' END AS time_zone, CASE WHEN event_time NOT LIKE '%.%' THEN strptime(concat(event_date, ' ', event_time), '%Y-%m-%d %H:%M:%S') AT TIME ZONE CASE country WHEN 'US' THEN 'America/New_York' ELSE 'Asia/Shanghai' END AT TIME ZONE 'UTC' END AS scheduled_at FROM fx_calendar")
def normalize_event(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_calendar").withColumnRenamed("event_id", "row_id").withColumnRenamed("country", "market")
    return reference_data.normalize_event(rows).select("row_id", "event_id", "time_zone", "scheduled_at")


@query(
    "normalize_earnings",
    """WITH e AS (SELECT event_id AS row_id, CASE user_id % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'HK' ELSE 'US' END AS market, CASE user_id % 3 WHEN 0 THEN lpad(CAST(event_id % 100000 AS VARCHAR), 6, '0') WHEN 1 THEN lpad(CAST(event_id AS VARCHAR), CAST(greatest(5, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0') ELSE concat('T', event_id) END AS symbol,
strftime(ts, '%Y-%m-%d') AS report_date, CASE WHEN event_id % 4 = 0 THEN '16:30:00' WHEN event_id % 4 = 1 THEN 'after close' ELSE '' END AS report_time FROM events)
SELECT row_id, market, symbol, symbol AS name, substr(sha256(concat_ws('|', lower(market), lower(symbol), report_date, report_time, 'q2', 'calendar')), 1, 24) AS event_id,
CASE WHEN report_time = '16:30:00' THEN strptime(concat(report_date, ' ', report_time), '%Y-%m-%d %H:%M:%S') AT TIME ZONE CASE market WHEN 'US' THEN 'America/New_York' WHEN 'HK' THEN 'Asia/Hong_Kong' ELSE 'Asia/Shanghai' END AT TIME ZONE 'UTC' END AS scheduled_at FROM e""",
)
def normalize_earnings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS row_id", "CASE user_id % 3 WHEN 0 THEN 'cn' WHEN 1 THEN ' HK' ELSE 'Us' END AS market",
        "CASE user_id % 3 WHEN 0 THEN concat('sz', cast(event_id % 100000 AS string)) WHEN 1 THEN concat(cast(event_id AS string), '.hk') ELSE concat('t', cast(event_id AS string)) END AS symbol",
        "cast(NULL AS string) AS name", "date_format(ts, 'yyyy-MM-dd') AS report_date", "CASE WHEN event_id % 4 = 0 THEN '16:30:00' WHEN event_id % 4 = 1 THEN 'after&nbsp; close ' END AS report_time",
        "'Q2' AS fiscal_period", "'1.5' AS eps_forecast", "cast(NULL AS string) AS previous_eps", "'calendar' AS source",
    )
    return reference_data.normalize_earnings(rows).select("row_id", "market", "symbol", "name", "event_id", "scheduled_at")


@query("parse_us_dates", "SELECT event_id, CASE event_id % 6 WHEN 4 THEN concat('2033', substr(CAST(CAST(ts AS DATE) AS VARCHAR), 5)) WHEN 5 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day, concat(strftime(ts, '%H:%M'), ':00') AS time FROM events")
def parse_us_dates(spark, sf_dir):
    """Long and short months, with and without a comma, ISO dates, dates without a year, and words that are no months."""
    rows, day = table(spark, sf_dir, "events"), lambda p: F.date_format("ts", p)
    kinds = [day("MMMM d, yyyy"), day("MMM d, yyyy"), day("MMMM d yyyy"), day("yyyy-MM-dd"), day("MMM d"), F.concat(F.lit("Quarter "), day("d, yyyy"))]
    text = F.concat_ws(" ", F.lit("Released:"), F.get(F.array(*kinds), (F.col("event_id") % 6).cast("int")), F.lit("- at"), F.when(F.col("event_id") % 2 == 0, day("h:mm a")).otherwise(F.concat(day("h:mm "), F.lower(F.substring(day("a"), 1, 1)), F.lit(".m."))))
    return rows.select("event_id", reference_data.parse_us_date(text, F.lit(2033)).alias("day"), reference_data.parse_us_time(text).alias("time"))


@query("dedupe_calendar", "SELECT user_id AS identity, max(event_id) AS position FROM events GROUP BY 1")
def dedupe_calendar(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("event_id"), F.col("event_id").alias("position"))
    return reference_data.dedupe_calendar(rows).select(F.col("event_id").cast("long").alias("identity"), "position")


@query("indicator_change", "WITH e AS (SELECT user_id, event_id, value - 50 AS value FROM events), o AS (SELECT user_id AS series, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, lead(value) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS previous FROM e) SELECT series, value, previous, value - previous AS change, CASE WHEN previous <> 0 THEN (value - previous) / previous * 100 END AS change_pct FROM o WHERE n = 1")
def indicator_change(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("observed_on"), (F.col("value") - 50).alias("value"))
    return reference_data.indicator_change(rows).drop("observed_on")


@query("calendar_snapshot", "SELECT 'economic' AS section, event_id, event_date, impact FROM fx_calendar WHERE impact = 'High' UNION ALL SELECT 'earnings', event_id, event_date, NULL FROM fx_calendar WHERE country = 'CN'")
def calendar_snapshot(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_calendar")
    both = reference_data.snapshot(economic=rows.where("impact = 'High'"), earnings=rows.where("country = 'CN'").drop("impact"))
    return both.select("section", "event_id", "event_date", "impact")


# The latest quote of each symbol, and the latest fundamental of codes that some quotes of the CN market have as well.
FRAGMENTS = """q AS (SELECT symbol, market, source, CASE WHEN user_id % 2 = 0 THEN concat('https://example.org/', split_part(symbol, '.', 1)) ELSE '' END AS source_url, CASE market WHEN 'CN' THEN 'CNY' END AS currency, quote_at, ingested_at FROM (
SELECT concat(lpad(CAST(user_id AS VARCHAR), 6, '0'), CASE user_id % 3 WHEN 0 THEN '.SZ' WHEN 1 THEN '.HK' ELSE '.US' END) AS symbol, user_id, CASE user_id % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'HK' ELSE 'US' END AS market, event_type AS source, CASE WHEN event_id % 5 > 0 THEN ts - INTERVAL '1' HOUR END AS quote_at, ts AS ingested_at,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1),
d AS (SELECT symbol AS code, report_period, CASE WHEN symbol LIKE '%7' THEN ' ' ELSE industry END AS industry, ingested_at FROM fx_fund_hist QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_period DESC, ingested_at DESC, version_id DESC) = 1),
j AS (SELECT coalesce(q.symbol, concat(d.code, CASE WHEN substr(d.code, 1, 1) IN ('5', '6', '9') THEN '.SH' WHEN substr(d.code, 1, 1) IN ('4', '8') THEN '.BJ' ELSE '.SZ' END)) AS symbol, coalesce(q.market, 'CN') AS market, d.code IS NOT NULL AS has_d, q.symbol IS NOT NULL AS has_q, q.currency, q.source, coalesce(q.source_url, '') AS url, nullif(trim(d.industry), '') AS industry,
coalesce(q.ingested_at, d.ingested_at) AS fetched_at, coalesce(q.quote_at, q.ingested_at, d.ingested_at) AS effective_at, coalesce(d.report_period, 'latest') AS period, coalesce(split_part(q.symbol, '.', 1), d.code) AS code
FROM q FULL JOIN d ON split_part(q.symbol, '.', 1) = d.code AND q.market = 'CN')"""


def fragment(spark, sf_dir):
    quotes_ = table(spark, sf_dir, "events").selectExpr(
        "concat(lpad(cast(user_id AS string), 6, '0'), CASE user_id % 3 WHEN 0 THEN '.SZ' WHEN 1 THEN '.HK' ELSE '.US' END) AS symbol", "CASE user_id % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'HK' ELSE 'US' END AS market", "event_type AS source", "CASE WHEN user_id % 2 = 0 THEN concat('https://example.org/', lpad(cast(user_id AS string), 6, '0')) ELSE '' END AS source_url",
        "CASE WHEN user_id % 3 = 0 THEN 'CNY' END AS currency", "CASE WHEN event_id % 5 > 0 THEN ts - INTERVAL '1' HOUR END AS quote_at", "ts AS observed_at", "ts AS ingested_at", "event_id AS content_rank",
    )
    history = versions.newest(view(spark, sf_dir, "fx_fund_hist"), ("symbol",), ("report_period", "ingested_at", "version_id"))
    latest = history.withColumn("industry", F.when(F.col("symbol").endswith("7"), " ").otherwise(F.col("industry")))
    return reference_data.repository_fragment(versions.latest_quotes(quotes_), latest, F.lit(NOW).cast("timestamp"))


@query(
    "repository_fragment",
    f"""WITH {FRAGMENTS} SELECT symbol, market, CASE WHEN has_d THEN 'equity' ELSE 'unknown' END AS asset_type, currency, effective_at AS as_of, industry, CASE WHEN has_q THEN source ELSE 'fundamental_snapshot' END AS source_id, nullif(url, '') AS source_url,
CASE WHEN url = '' THEN concat('fundamental_snapshot:', period, ':', code) END AS source_record_id, fetched_at, CASE WHEN has_q THEN 'primary_market_data' ELSE 'primary_filing_aggregation' END AS source_tier FROM j""",
)
def repository_fragment(spark, sf_dir):
    proof = F.get("evidence", F.lit(0))
    out = fragment(spark, sf_dir).select("symbol", "market", "asset_type", "currency", F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.get("classifications", F.lit(0))["value"].alias("industry"), *(proof[c].alias(c) for c in ("source_id", "source_url", "source_record_id", "fetched_at", "source_tier")))
    return out.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


@query(
    "merge_exposure",
    f"""WITH {FRAGMENTS}, m AS (SELECT DISTINCT concat(lpad(CAST(user_id AS VARCHAR), 6, '0'), CASE user_id % 3 WHEN 0 THEN '.SZ' WHEN 1 THEN '.HK' ELSE '.US' END) AS symbol, user_id % 8 = 0 AS fund FROM events WHERE user_id % 4 = 0)
SELECT symbol, CASE WHEN has_d THEN 'equity' WHEN m.fund THEN 'etf' ELSE 'unknown' END AS asset_type, market, currency, effective_at AS as_of, industry AS classifications, CASE WHEN m.symbol IS NOT NULL THEN concat('report of ', symbol) ELSE '' END AS materials,
CASE WHEN m.symbol IS NOT NULL THEN 'available' ELSE 'unavailable' END AS company_materials_status, CASE WHEN NOT has_d AND m.fund THEN 'available' ELSE 'not_applicable' END AS holdings_status, CASE WHEN m.symbol IS NOT NULL THEN 2 ELSE 1 END AS proofs
FROM j LEFT JOIN m USING (symbol)""",
)
def merge_exposure(spark, sf_dir):
    """What the repository knows, and after it materials of every fourth user's symbol, every second of which is said to be a fund."""
    own = fragment(spark, sf_dir).withColumn("priority", F.lit(0)).withColumn("source", F.lit("repository"))
    at = F.lit("1990-01-01").cast("timestamp")
    users = table(spark, sf_dir, "events").where("user_id % 4 = 0").select("user_id").distinct().withColumn("symbol", F.concat(F.lpad(F.col("user_id").cast("string"), 6, "0"), F.expr("CASE user_id % 3 WHEN 0 THEN '.SZ' WHEN 1 THEN '.HK' ELSE '.US' END")))
    proof = reference_data.evidence(F.lit("issuer"), at, at, F.lit("issuer"), F.lit("https://example.org/"), F.lit(""))
    more = users.select("symbol", F.when(F.col("user_id") % 8 == 0, "etf").otherwise("unknown").alias("asset_type"), F.lit(None).cast("string").alias("market"), F.lit(None).cast("string").alias("currency"), at.alias("as_of"), F.array(F.concat(F.lit("report of "), "symbol")).alias("company_materials"), F.lit("constituents").alias("holdings"), F.array(proof).alias("evidence"), F.lit(1).alias("priority"), F.lit("issuer").alias("source"))
    out = reference_data.merge_exposure(own.unionByName(more, allowMissingColumns=True))
    return out.select("symbol", "asset_type", "market", "currency", F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.get("classifications", F.lit(0))["value"].alias("classifications"), F.array_join("company_materials", ",").alias("materials"), "company_materials_status", "holdings_status", F.size("evidence").alias("proofs"))


@query("serve_stale", f"WITH a AS (SELECT symbol, max(ingested_at) AS as_of FROM fx_quote GROUP BY 1) SELECT symbol, CAST(floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(as_of)) AS BIGINT) AS age_seconds, CASE WHEN floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(as_of)) <= 86400 THEN 'fresh' WHEN floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(as_of)) <= 604800 THEN 'stale' ELSE 'unavailable' END AS state FROM a")
def serve_stale(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_quote").groupBy("symbol").agg(F.max("ingested_at").alias("as_of"))
    return reference_data.serve_stale(rows, F.lit(NOW).cast("timestamp")).select("symbol", "age_seconds", "state")


@query("quote_freshness", f"SELECT symbol, content_rank, CAST(floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ingested_at)) AS BIGINT) AS age_seconds, CASE WHEN floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ingested_at)) <= 60 THEN 'fresh' WHEN floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ingested_at)) <= 604800 THEN 'stale' ELSE 'expired' END AS status FROM fx_quote")
def quote_freshness(spark, sf_dir):
    return bars.quote_freshness(view(spark, sf_dir, "fx_quote"), F.lit(NOW).cast("timestamp")).select("symbol", "content_rank", "age_seconds", "status")


@query("resolve_mapping", "WITH r AS (SELECT 'provider:longport' AS namespace, concat('L', CAST(l_partkey % 150 AS VARCHAR)) AS external_symbol FROM lineitem GROUP BY ALL) SELECT namespace, external_symbol, instrument_id FROM r JOIN fx_symbol_map USING (namespace, external_symbol)")
def resolve_mapping(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.lit("provider:longport").alias("namespace"), F.concat(F.lit("L"), (F.col("l_partkey") % 150).cast("string")).alias("external_symbol")).distinct()
    return reference_data.resolve_mapping(asked, view(spark, sf_dir, "fx_symbol_map"))


@query("mapping_conflicts", "SELECT namespace, external_symbol, count(DISTINCT instrument_id) AS instruments, min(instrument_id) AS first, max(instrument_id) AS last FROM fx_symbol_map GROUP BY ALL HAVING count(DISTINCT instrument_id) > 1")
def mapping_conflicts(spark, sf_dir):
    return reference_data.mapping_conflicts(view(spark, sf_dir, "fx_symbol_map"))


INSTRUMENT = {
    "instrument_id": "instrument_id", "symbol": "symbol", "mic": "mic", "market": "CASE WHEN p_no % 11 = 0 THEN 'EU' ELSE market END", "currency": "CASE WHEN p_no % 13 = 0 THEN 'usd' ELSE 'USD' END", "price_precision": "price_precision",
    "tick_size": "CASE WHEN p_no % 7 = 0 THEN '0.00' WHEN p_no % 7 = 1 THEN '01' ELSE '0.01' END", "lot_size": "CASE WHEN p_no % 17 = 0 THEN '-1' ELSE '100' END", "ts_event": "CASE WHEN p_no % 19 = 0 THEN 2 ELSE 1 END", "ts_init": "1 + 0 * p_no",
}


@query(
    "instrument_check",
    f"""WITH n AS (SELECT *, CAST(substr(symbol, 2) AS BIGINT) AS p_no FROM fx_instrument), c AS (SELECT p_no, {", ".join(f"{v} AS {k}" for k, v in INSTRUMENT.items())} FROM n)
SELECT instrument_id, array_to_string(list_filter([CASE WHEN market = 'EU' THEN 'invalid_market' END, CASE WHEN currency = 'usd' THEN 'invalid_currency' END, CASE WHEN price_precision NOT BETWEEN 0 AND 18 THEN 'invalid_precision' END,
CASE WHEN tick_size <> '0.01' THEN 'invalid_tick_size' END, CASE WHEN lot_size <> '100' THEN 'invalid_lot_size' END, CASE WHEN ts_event > ts_init THEN 'clock_order' END], lambda x: x IS NOT NULL), ',') AS errors FROM c""",
)
def instrument_check(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_instrument").withColumn("p_no", F.expr("cast(substr(symbol, 2) AS bigint)")).selectExpr(*(f"{v} AS {k}" for k, v in INSTRUMENT.items()))
    return reference_data.instrument_check(rows).select("instrument_id", F.array_join("errors", ",").alias("errors"))


@query(
    "provider_health",
    """WITH g AS (SELECT provider, count(*) AS attempts, max(attempted_at) FILTER (success) AS last_success_at, arg_max(error, attempt_no) FILTER (NOT success) AS error, max(attempt_no) FILTER (success) AS ok, arg_max(success, attempt_no) AS last, arg_max(attempted_at, attempt_no) AS last_attempt_at FROM fx_attempt GROUP BY 1)
SELECT provider, attempts, CASE WHEN last THEN 'healthy' ELSE 'unhealthy' END AS status, last_attempt_at, last_success_at, CASE WHEN NOT last THEN error END AS last_error, (SELECT count(*) FROM fx_attempt a WHERE a.provider = g.provider AND NOT a.success AND a.attempt_no > coalesce(g.ok, -1)) AS consecutive_failures FROM g""",
)
def provider_health(spark, sf_dir):
    return reference_data.provider_health(view(spark, sf_dir, "fx_attempt"))


@query("latest_runs", "SELECT attempt_no, provider, attempted_at FROM fx_attempt ORDER BY attempted_at DESC, attempt_no DESC LIMIT 25")
def latest_runs(spark, sf_dir):
    return reference_data.latest_runs(view(spark, sf_dir, "fx_attempt"), 25, "attempted_at", "attempt_no").select("attempt_no", "provider", "attempted_at")


@query("artifacts", "SELECT artifact_id, source, byte_size FROM fx_artifact WHERE dataset = 'en' ORDER BY ingested_at DESC, artifact_id DESC LIMIT 20")
def artifacts(spark, sf_dir):
    return reference_data.artifacts(view(spark, sf_dir, "fx_artifact"), "en", 20).select("artifact_id", "source", "byte_size")


@query("latest_artifact", "SELECT dataset, json_extract_string(metadata_json, '$.report_period') AS value, arg_max(artifact_id, (ingested_at, artifact_id)) AS artifact_id FROM fx_artifact GROUP BY ALL")
def latest_artifact(spark, sf_dir):
    return reference_data.latest_artifact(view(spark, sf_dir, "fx_artifact"), "report_period").select("dataset", "value", "artifact_id")


@query("artifact_inventory", "SELECT dataset, source, count(*) AS artifacts, CAST(sum(byte_size) AS BIGINT) AS bytes, min(ingested_at) AS first_ingested, max(ingested_at) AS last_ingested FROM fx_artifact GROUP BY ALL ORDER BY artifacts DESC, dataset, source LIMIT 200")
def artifact_inventory(spark, sf_dir):
    return inventory.artifact_inventory(view(spark, sf_dir, "fx_artifact"))


@query("newest_quote_age", f"SELECT CAST(floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(max(observed_at))) AS BIGINT) AS age_seconds FROM fx_quote")
def newest_quote_age(spark, sf_dir):
    return inventory.newest_age(view(spark, sf_dir, "fx_quote"), F.lit(NOW).cast("timestamp"))


@query("first_available", """WITH r AS (SELECT symbol, arg_min(source, (CASE source WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 1073741824 END, source)) AS source FROM fx_quote WHERE price > 5 GROUP BY 1),
c AS (SELECT symbol, arg_max(price, (ingested_at, content_rank)) AS price FROM fx_quote GROUP BY 1) SELECT symbol, coalesce(r.source, 'cache') AS source, r.source IS NULL AS stale FROM r FULL JOIN c USING (symbol)""")
def first_available(spark, sf_dir):
    """Every symbol of the table: from the first source that answers (with a price over 5), else from the newest stored quote."""
    rows = view(spark, sf_dir, "fx_quote")
    ranks = spark.createDataFrame(reference_data.priorities(["purchase", "click", "view"]), "source string, rank int")
    return reference_data.first_available(rows.where("price > 5"), ranks, versions.latest_quotes(rows)).select("symbol", "source", "stale")


@query("latest_quotes", "SELECT symbol, source, price, ingested_at FROM fx_quote QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ingested_at DESC, content_rank DESC) = 1")
def latest_quotes(spark, sf_dir):
    return versions.latest_quotes(view(spark, sf_dir, "fx_quote")).select("symbol", "source", "price", "ingested_at")


@query("quote_versions", "WITH l AS (SELECT *, lag(payload_json) OVER w AS before, row_number() OVER w AS n FROM fx_quote WINDOW w AS (PARTITION BY symbol ORDER BY ingested_at, content_rank)) SELECT symbol, content_rank, payload_json, row_number() OVER (PARTITION BY symbol ORDER BY ingested_at, content_rank) AS version FROM l WHERE n = 1 OR payload_json IS DISTINCT FROM before")
def quote_versions(spark, sf_dir):
    return versions.quote_versions(view(spark, sf_dir, "fx_quote")).select("symbol", "content_rank", "payload_json", "version")


def plain_sql(column: str) -> str:
    """A double's plain text without trailing zeros."""
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0*$|(\\.[0-9]*[1-9])0+$', '\\1')"


@query(
    "content_rank",
    f"""SELECT symbol, source, bar_time, source_sequence, substr(sha256(concat('{{"amount":', coalesce('"' || {plain_sql("amount")} || '"', 'null'), ',"bar_time":', CAST(epoch_ms(bar_time) AS VARCHAR), ',"close":"', {plain_sql("close")},
'","open":"', {plain_sql("open")}, '","source":"', source, '","symbol":"', symbol, '"}}')), 1, 52) AS content_rank FROM fx_raw_bar""",
)
def content_rank(spark, sf_dir):
    return versions.content_rank(view(spark, sf_dir, "fx_raw_bar"), ["open", "close", "amount"], ["symbol", "source"], ["bar_time"]).select("symbol", "source", "bar_time", "source_sequence", "content_rank")


@query("spread", "WITH b AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS bid, max(value) FILTER (event_type = 'click') AS ask FROM events GROUP BY 1) SELECT user_id, bid AS best_bid, ask AS best_ask, ask - bid AS spread, (ask - bid) / ((ask + bid) / 2) * 10000 AS spread_bps FROM b")
def spread(spark, sf_dir):
    side = lambda t: F.max(F.when(F.col("event_type") == t, F.col("value")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(side("view").alias("v"), side("click").alias("c"))
    level = lambda i, p: F.struct(F.lit(i).alias("position"), p.alias("price"), F.lit(1.0).alias("size"))
    books = rows.select("user_id", F.array(level(2, F.lit(0.5)), level(0, F.lit(0.0)), level(1, F.col("v"))).alias("bids"), F.array(level(1, F.col("c")), level(0, F.lit(-1.0))).alias("asks"))
    return quotes.spread(books).select("user_id", "best_bid", "best_ask", "spread", "spread_bps")


@query("session_quote", "WITH g AS (SELECT user_id, max(ts) FILTER (event_type = 'view' AND value > 0) AS regular, max(ts) FILTER (event_type = 'click' AND value > 0) AS pre FROM events GROUP BY 1) SELECT user_id, greatest(regular, pre) AS quote_at, CASE WHEN pre IS NULL OR regular > pre THEN 'regular' ELSE 'pre_market' END AS session FROM g WHERE regular IS NOT NULL OR pre IS NOT NULL")
def session_quote(spark, sf_dir):
    last = lambda t: F.max_by(F.struct("ts", F.col("value").alias("price")), F.when((F.col("event_type") == t) & (F.col("value") > 0), F.col("ts")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(last("view").alias("regular"), last("click").alias("pre_market")).withColumn("previous_close", F.lit(10.0))
    return quotes.latest_session_quote(rows, ("regular", "pre_market")).where("quote_at IS NOT NULL").select("user_id", "quote_at", "session")


@query("last_nonnull_close", "WITH v AS (SELECT user_id, list(value ORDER BY event_id) FILTER (event_type <> 'error') AS c FROM events GROUP BY 1) SELECT user_id, coalesce(c[-1], 1.5) AS price, CASE WHEN user_id % 3 > 0 THEN 2.5 WHEN user_id % 2 = 0 THEN 3.5 END AS previous, coalesce(c[-2], 2.5) AS last_but_one FROM v")
def last_nonnull_close(spark, sf_dir):
    closes = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    own, chart = F.when(F.col("user_id") % 3 > 0, 2.5), F.when(F.col("user_id") % 2 == 0, 3.5)
    rows = quotes.newest_known(closes, "user_id", "event_id", "v").select("user_id", "closes", F.lit(1.5).alias("meta_price"), own.alias("meta_previous"), chart.alias("chart_previous"))
    return quotes.last_nonnull_close(rows).select("user_id", "price", "previous", F.coalesce(F.try_element_at("closes", F.lit(-2)), F.lit(2.5)).alias("last_but_one"))


@query("session_label", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'unknown' WHEN hour(ts) BETWEEN 4 AND 8 THEN 'pre' WHEN hour(ts) BETWEEN 9 AND 15 THEN 'regular' WHEN hour(ts) BETWEEN 16 AND 19 THEN 'post' ELSE 'closed' END AS label FROM events")
def session_label(spark, sf_dir):
    periods = [("pre", F.lit(4), F.lit(8)), ("regular", F.lit(9), F.lit(15)), ("post", F.lit(16), F.lit(19))]
    return table(spark, sf_dir, "events").select("event_id", quotes.session_label(F.when(F.col("event_id") % 9 > 0, F.hour("ts")), periods).alias("label"))


@query("validate_quote", "SELECT content_rank, CASE WHEN market = 'US' THEN 'unknown_market' ELSE '' END || CASE WHEN market = 'US' AND price <= 0 THEN ',' ELSE '' END || CASE WHEN price <= 0 THEN 'invalid_price' ELSE '' END AS errors FROM fx_quote")
def validate_quote(spark, sf_dir):
    return quotes.validate_quote(view(spark, sf_dir, "fx_quote"), ("CN", "HK")).select("content_rank", F.array_join("errors", ",").alias("errors"))


@query("explode_envelope", "SELECT event_id, 0 AS row_index, CAST(user_id AS VARCHAR) AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS row_date, event_type AS kind FROM events")
def explode_envelope(spark, sf_dir):
    body = F.to_json(F.struct(F.array(F.lit("ts_code"), F.lit("date"), F.lit("kind")).alias("fields"), F.array(F.array(F.col("user_id").cast("string"), F.to_date("ts").cast("string"), F.col("event_type"))).alias("items")))
    rows = ingest.explode_envelope(table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return rows.select("event_id", "row_index", "symbol", "row_date", F.col("record")["kind"].alias("kind"))


@query(
    "explode_chart",
    """WITH c AS (SELECT symbol, source, row_number() OVER (PARTITION BY symbol, source ORDER BY bar_time, content_rank) - 1 AS row_index, bar_time, open, CASE WHEN amount IS NOT NULL THEN close END AS raw_close, CASE WHEN volume > 100 THEN close * 0.5 END AS own FROM fx_raw_bar)
SELECT symbol, source, CAST(row_index AS INTEGER) AS row_index, bar_time, open * CASE WHEN own IS NOT NULL AND raw_close <> 0 THEN own / raw_close ELSE 1.0 END AS open, coalesce(own, raw_close) AS close, raw_close, CASE WHEN own IS NOT NULL AND raw_close <> 0 THEN own / raw_close ELSE 1.0 END AS adjustment_factor
FROM c WHERE coalesce(own, raw_close) IS NOT NULL""",
)
def explode_chart(spark, sf_dir):
    """A chart for each symbol and source, with raw closes and adjusted ones missing here and there."""
    bar = F.struct("bar_time", "content_rank", "open", "high", "low", F.when(F.col("amount").isNotNull(), F.col("close")).alias("close"), "volume", F.when(F.col("volume") > 100, F.col("close") * 0.5).alias("adjclose"))
    charts = view(spark, sf_dir, "fx_raw_bar").groupBy("symbol", "source").agg(F.sort_array(F.collect_list(bar)).alias("x"))
    each = lambda c: F.transform("x", lambda b: b[c]).alias(c)
    times = F.transform("x", lambda b: F.unix_seconds(b["bar_time"].cast("timestamp"))).alias("timestamp")
    body = F.to_json(F.struct(times, *(each(c) for c in ("open", "high", "low", "close", "volume", "adjclose"))), {"ignoreNullFields": "false"})
    out = ingest.explode_chart(charts.select("symbol", "source", body.alias("body")), True)
    return out.select("symbol", "source", "row_index", F.col("bar_time").cast("timestamp_ntz").alias("bar_time"), "open", "close", "raw_close", "adjustment_factor")


@query("minute_bars", "SELECT event_id, date_trunc('second', ts) - INTERVAL 8 HOUR AS bar_time, value AS close FROM events WHERE event_type <> 'error'")
def minute_bars(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("trade_time"), F.when(F.col("event_type") != "error", F.col("value")).alias("close"))
    return ingest.minute_bars(rows).select("event_id", F.col("bar_time").cast("timestamp_ntz").alias("bar_time"), "close")


@query(
    "delimited_quote",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS name, CASE WHEN event_type <> 'view' THEN 1.5 END AS open, CASE WHEN event_type <> 'view' THEN value END AS price, CASE WHEN event_type <> 'view' THEN CAST(user_id AS DOUBLE) END AS volume,
CASE WHEN event_type <> 'view' THEN date_trunc('second', ts) END AS quote_at, CASE WHEN event_type = 'view' THEN 'too_few_fields' WHEN value > 0 THEN NULL ELSE 'no_price' END AS error FROM events""",
)
def delimited_quote(spark, sf_dir):
    fields = F.concat_ws(",", F.col("event_type"), F.lit("1.5"), F.lit("2"), F.col("value").cast("string"), *(F.lit("0") for _ in range(4)), F.col("user_id").cast("string"), *(F.lit("0") for _ in range(21)), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))
    line = F.concat(F.lit('var q="'), F.when(F.col("event_type") == "view", F.lit("")).otherwise(fields), F.lit('";'))
    rows = ingest.parse_delimited_quote(table(spark, sf_dir, "events").select("event_id", line.alias("line")))
    return rows.select("event_id", "name", "open", "price", "volume", F.col("quote_at").cast("timestamp_ntz").alias("quote_at"), "error")


@query("scaled_quote", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) / 100 END AS price FROM part")
def scaled_quote(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("-").alias("price"), F.lit(2).alias("decimals"))
    return ingest.scaled_quote(rows, ("price",)).select("p_partkey", "price")


@query("artifact_rows", "SELECT event_id, 0 AS row_index, event_type AS kind FROM events")
def artifact_rows(spark, sf_dir):
    record = F.to_json(F.array(F.struct(F.col("event_type").alias("kind"))))
    body = F.concat(F.lit('{"'), F.when(F.col("event_id") % 2 == 0, "payload").otherwise("records"), F.lit('": '), record, F.lit("}"))
    rows = ingest.artifact_rows(table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return rows.select("event_id", "row_index", F.get_json_object("record", "$.kind").alias("kind"))


@query("normalize_bars", "SELECT symbol, source, source_sequence, bar_time, CASE WHEN amount IS NULL THEN 'missing: close' END AS error FROM fx_raw_bar")
def normalize_bars(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_raw_bar").withColumn("close", F.when(F.col("amount").isNotNull(), F.col("close").cast("string")).otherwise("-"))
    return ingest.normalize_bars(rows).select("symbol", "source", "source_sequence", F.col("bar_time").cast("timestamp_ntz").alias("bar_time"), "error")


@query("prepare_raw_bars", "SELECT symbol, source_sequence AS own, bar_time, bar_time AS observed_at, CASE WHEN source = 'sina' THEN CAST(epoch(bar_time)::BIGINT AS VARCHAR) ELSE source_sequence END AS source_sequence, 'US' AS market FROM fx_raw_bar")
def prepare_raw_bars(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_raw_bar")
    at = F.col("bar_time").cast("timestamp")
    shaped = rows.select("symbol", F.col("source_sequence").alias("own"), F.when(F.col("source") == "sina", None).otherwise(F.date_format("bar_time", "yyyy-MM-dd HH:mm:ss")).alias("bar_at"), F.unix_seconds(at).alias("epoch"), F.lit(None).cast("timestamp").alias("provenance_at"), F.when(F.col("source") != "sina", F.col("source_sequence")).alias("sequence"))
    out = ingest.prepare_raw_bars(shaped)
    return out.select("symbol", "own", F.col("bar_time").cast("timestamp_ntz").alias("bar_time"), F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "source_sequence", "market")


CODE = "lpad(CAST(p_partkey * 37 % 1000000 AS VARCHAR), 6, '0')"
FIRST = f"substr({CODE}, 1, 1)"


@query(
    "normalize_symbols",
    f"""SELECT p_partkey, CASE WHEN {FIRST} IN ('4', '8', '9') THEN 'XBSE' WHEN {FIRST} IN ('5', '6') THEN 'XSHG' ELSE 'XSHE' END AS exchange,
concat({CODE}, CASE WHEN {FIRST} IN ('5', '6', '9') THEN '.SH' WHEN {FIRST} IN ('4', '8') THEN '.BJ' ELSE '.SZ' END) AS a_symbol,
concat('CN.', CASE WHEN {FIRST} IN ('5', '6', '9') THEN 'XSHG' ELSE 'XSHE' END, '.', {CODE}) AS instrument,
concat(CASE WHEN {FIRST} IN ('5', '6', '9') THEN 'sh.' WHEN {FIRST} IN ('4', '8') THEN 'bj.' ELSE 'sz.' END, {CODE}) AS provider_code,
concat(lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0'), '.HK') AS hk, concat(CAST(p_partkey % 10000 AS VARCHAR), '.HK') AS longport,
concat(CASE WHEN {FIRST} IN ('4', '8', '9') THEN 'BJ' WHEN {FIRST} IN ('5', '6') THEN 'SH' ELSE 'SZ' END, {CODE}) AS eastmoney, CASE p_size % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'HK' ELSE 'US' END AS market FROM part""",
)
def normalize_symbols(spark, sf_dir):
    code = F.lpad((F.col("p_partkey") * 37 % 1_000_000).cast("string"), 6, "0")
    suffix = F.when(F.col("p_size") % 3 == 0, ".SZ").when(F.col("p_size") % 3 == 1, ".HK").otherwise("")
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.exchange_for_symbol(code).alias("exchange"), scalars.normalize_a_symbol(code).alias("a_symbol"), scalars.canonical_instrument(code)["instrument_id"].alias("instrument"), scalars.provider_code(code).alias("provider_code"),
        scalars.normalize_yahoo_symbol(F.concat((F.col("p_partkey") % 10_000).cast("string"), F.lit(".hk"))).alias("hk"), scalars.market_of(F.concat(code, suffix)).alias("market"),
        scalars.normalize_longport_symbol(F.concat((F.col("p_partkey") % 10_000).cast("string"), F.lit(".hk"))).alias("longport"), scalars.eastmoney_symbol(code).alias("eastmoney"),
    )


@query("report_periods", "SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 11 THEN concat(CAST(year(o_orderdate) AS VARCHAR), '0930') WHEN month(o_orderdate) >= 9 THEN concat(CAST(year(o_orderdate) AS VARCHAR), '0630') WHEN month(o_orderdate) >= 5 THEN concat(CAST(year(o_orderdate) AS VARCHAR), '0331') ELSE concat(CAST(year(o_orderdate) - 1 AS VARCHAR), '0930') END AS broad, CASE WHEN strftime(o_orderdate, '%m%d') IN ('0331', '0630', '0930', '1231') THEN strftime(o_orderdate, '%Y%m%d') END AS exact FROM orders")
def report_periods(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.latest_broad_report_period(F.col("o_orderdate")).alias("broad"), scalars.normalize_report_period(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("exact"))


@query("canonical_hash", """SELECT p_partkey, concat('sha256:', sha256(concat('{"brand":"', p_brand, '","none":null,"size":', CAST(p_size AS VARCHAR), '}'))) AS content FROM part""")
def canonical_hash(spark, sf_dir):
    fields = {"size": F.col("p_size"), "brand": F.col("p_brand"), "none": F.lit(None).cast("string")}
    return table(spark, sf_dir, "part").select("p_partkey", scalars.canonical_hash(fields).alias("content"))


@query("clean_numbers", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_retailprice ELSE NULL END AS value FROM part")
def clean_numbers(spark, sf_dir):
    text = F.when(F.col("p_size") % 4 == 0, " - ").when(F.col("p_size") % 4 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_size") % 4 == 2, F.col("p_retailprice").cast("string")).otherwise("NaN")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.coalesce_number(F.lit(""), text).alias("value"))


@query("redact", "SELECT page_id, concat('page ', CAST(page_id AS VARCHAR), ' access_token=[REDACTED], Authorization: [REDACTED] passwd=[REDACTED] at [REDACTED_PATH] and [REDACTED_DSN] or [REDACTED_DSN]') AS text FROM pages")
def redact(spark, sf_dir):
    page = F.col("page_id").cast("string")
    text = F.concat(F.lit("page "), page, F.lit(" access_token=abc"), page, F.lit(", Authorization: Bearer z"), page, F.lit(" passwd=hunter2 at /var/data/x.log and https://u:p@h/"), page, F.lit(" or postgres://db.local/x"))
    return table(spark, sf_dir, "pages").select("page_id", scalars.redact(text).alias("text"))


@query("statement_rows", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS report_date FROM events WHERE event_type <> 'error'")
def statement_rows(spark, sf_dir):
    from tideframe.operators.fundamentals import statement_rows as rows_of

    field = F.when(F.col("event_type") == "view", "report_date").when(F.col("event_type") == "error", "other").otherwise("end_date")
    body = F.concat(F.lit('{"'), field, F.lit('": "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"}'))
    return rows_of(table(spark, sf_dir, "events").select("event_id", body.alias("payload_json"))).select("event_id", "report_date")


@query("read_many", "SELECT CAST(s_suppkey AS INTEGER) AS request, CAST(p AS INTEGER) AS position, concat('prov', CAST((s_suppkey + p) % 12 AS VARCHAR)) AS symbol, CASE WHEN (s_suppkey + p) % 12 >= 8 THEN 'not_found' END AS error FROM supplier, (SELECT unnest([0, 1, 2]) AS p)")
def read_many(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("request"), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda p: F.concat(F.lit("prov"), ((F.col("s_suppkey") + p) % 12).cast("string"))).alias("symbols"))
    rows = view(spark, sf_dir, "fx_attempt").groupBy(F.col("provider").alias("symbol")).agg(F.count("*").alias("n"))
    found = bars.read_many(asked, rows)
    return found.select("request", "position", "symbol", "error")


@query("instrument_valid", "SELECT concat('P', CAST(l_partkey AS VARCHAR)) AS instrument_id, max(l_orderkey * 10 + l_linenumber) AS ts_init FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1")
def instrument_valid(spark, sf_dir):
    from tideframe.operators.asof import instrument_valid as valid

    arrival = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("instrument_id"), arrival.alias("ts_init"), (arrival + F.when(F.col("l_linenumber") > 4, 1).otherwise(0)).alias("ts_event"))
    return valid(rows).select("instrument_id", "ts_init")


@query("normalize_candidates", "SELECT concat('S', CAST(p_size AS VARCHAR)) AS symbol, min(p_partkey) AS position FROM part WHERE p_size % 3 <> 0 GROUP BY 1 ORDER BY position LIMIT 20")
def normalize_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("symbol"), F.when(F.col("p_size") % 3 == 0, "bond").otherwise("stock").alias("asset_class"), F.col("p_partkey").alias("position"))
    return scalars.normalize_candidates(rows, ("stock", "fund"), 20).select("symbol", "position")


@query("quote_change", "SELECT event_id, value - previous AS change, CASE WHEN previous <> 0 THEN (value - previous) / previous * 100 END AS change_pct FROM (SELECT event_id, value, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id + 1 AS DOUBLE) END AS previous FROM events)")
def quote_change(spark, sf_dir):
    previous = F.when(F.col("event_type") == "view", F.lit(0.0)).when(F.col("event_type") == "error", None).otherwise((F.col("user_id") + 1).cast("double"))
    change, percent = quotes.quote_change(F.col("value"), previous)
    return table(spark, sf_dir, "events").select("event_id", change.alias("change"), percent.alias("change_pct"))


@query("json_safe", "SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE value END AS value, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS text FROM events")
def json_safe(spark, sf_dir):
    value = F.when(F.col("event_type") == "view", F.lit(float("nan"))).when(F.col("event_type") == "error", F.lit(float("inf"))).otherwise(F.col("value"))
    text = F.when(F.col("event_type") == "view", " - ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", scalars.json_safe(value).alias("value"), scalars.text_or_null(text).alias("text"))


@query("month_of", "SELECT o_orderkey, CASE WHEN o_orderkey % 14 BETWEEN 1 AND 12 THEN make_date(CAST(year(o_orderdate) AS BIGINT), CAST(o_orderkey % 14 AS BIGINT), 1) END AS month FROM orders")
def month_of(spark, sf_dir):
    period = F.concat(F.lit("M"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reference_data.month_of(F.year("o_orderdate"), period).alias("month"))


@query("explode_mappings", "SELECT CASE WHEN p_size % 2 = 0 THEN 'provider:longport' ELSE 'broker:longport' END AS namespace, concat('L', CAST(p_partkey AS VARCHAR)) AS external_symbol, concat('P', CAST(p_partkey AS VARCHAR), CASE p_size % 2 WHEN 0 THEN '.XNAS' ELSE '.XHKG' END) AS instrument_id FROM part")
def explode_mappings(spark, sf_dir):
    none = F.create_map().cast("map<string,string>")
    one = F.create_map(F.lit("longport"), F.concat(F.lit("L"), F.col("p_partkey").cast("string")))
    even = F.col("p_size") % 2 == 0
    rows = table(spark, sf_dir, "part").select(F.when(even, one).otherwise(none).alias("provider_symbols"), F.when(even, none).otherwise(one).alias("broker_symbols"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.when(even, ".XNAS").otherwise(".XHKG")).alias("instrument_id"))
    return reference_data.explode_mappings(rows)
