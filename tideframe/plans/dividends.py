"""Queries over dividends and filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import dividends, filings
from tideframe.plans.registry import query
from tideframe.sources.fixtures import table, view

ROW = "dividend_id, symbol, fiscal_year, amount_per_share, currency, announcement_date, payment_date, confirmation_status, event_status, source_priority, source_document_id"
RESOLVED = """resolved AS (SELECT * FROM (SELECT *, coalesce(expected_payment_date, payment_date, announcement_date) AS event_date FROM fx_div) QUALIFY row_number() OVER (PARTITION BY symbol, amount_per_share, currency, event_date
ORDER BY source_priority, confirmation_status <> 'confirmed', (record_date IS NULL)::INT + (ex_date IS NULL)::INT + (payment_date IS NULL)::INT, source_document_id = '', fiscal_year, announcement_date, dividend_id) = 1)"""


def resolved(spark, sf_dir):
    return dividends.resolve_events(view(spark, sf_dir, "fx_div"))


@query("resolve_events", f"WITH {RESOLVED} SELECT {ROW}, event_date FROM resolved")
def resolve_events(spark, sf_dir):
    return resolved(spark, sf_dir).select(*ROW.split(", "), "event_date")


COLLAPSED = ("dividend_id", "symbol", "fiscal_year", "currency", "amount_per_share", "announcement_date", "payment_date", "expected_payment_date", "confirmation_status", "event_status", "source", "source_document_id")
# The rows kept so far are a list; the place of the first one like the next row decides whether that row is added, takes the place or goes.
ONE_DATED = "(k.amount_per_share = n[1].amount_per_share AND (k.pay IS NULL) <> (n[1].pay IS NULL))"
PLACE = f"""list_position(list_transform(kept, lambda k: (k.pay IS NOT DISTINCT FROM n[1].pay OR {ONE_DATED}) AND NOT (k.doc AND n[1].doc AND k.source <> n[1].source)
AND ({ONE_DATED} OR k.doc <> n[1].doc) AND abs(k.amount_per_share - n[1].amount_per_share) <= 0.01 * greatest(abs(k.amount_per_share), abs(n[1].amount_per_share), 1)), TRUE)"""
COLLAPSE = f"""{RESOLVED}, marked AS (SELECT *, concat('p', CAST(source_priority AS VARCHAR)) AS source, coalesce(source_document_id, '') <> '' AS doc, coalesce(payment_date, expected_payment_date) AS pay FROM resolved),
listed AS (SELECT list([{{{", ".join(f"'{c}': {c}" for c in (*COLLAPSED, "doc", "pay"))}}}] ORDER BY announcement_date NULLS FIRST, dividend_id) AS l FROM marked GROUP BY symbol, fiscal_year, currency),
folded AS (SELECT unnest(list_reduce(l, lambda kept, n: CASE WHEN {PLACE} IS NULL THEN kept || n
WHEN (n[1].pay IS NOT NULL AND kept[{PLACE}].pay IS NULL) OR (n[1].doc AND NOT (kept[{PLACE}].amount_per_share = n[1].amount_per_share AND (kept[{PLACE}].pay IS NULL) <> (n[1].pay IS NULL))) THEN kept[:{PLACE} - 1] || n || kept[{PLACE} + 1:] ELSE kept END)) AS k FROM listed),
collapsed AS (SELECT {", ".join(f"k.{c}" for c in COLLAPSED)}, CAST(year(k.pay) AS INTEGER) AS year FROM folded)"""


def collapsed(spark, sf_dir):
    events = resolved(spark, sf_dir).withColumn("source", F.concat(F.lit("p"), F.col("source_priority").cast("string")))
    return dividends.collapse_precision_duplicates(events.select(*COLLAPSED))


@query("collapse_precision_duplicates", f"WITH {COLLAPSE} SELECT {', '.join(COLLAPSED)} FROM collapsed")
def collapse_precision_duplicates(spark, sf_dir):
    return collapsed(spark, sf_dir)


@query(
    "dividend_summary",
    f"""WITH {COLLAPSE}, s AS (SELECT symbol, year, count(*) AS events, CAST(sum(amount_per_share) AS DECIMAL(28, 6)) AS total, CAST(coalesce(sum(amount_per_share) FILTER (confirmation_status = 'confirmed'), 0) AS DECIMAL(28, 6)) AS confirmed_total,
bool_and(confirmation_status = 'confirmed') AS fully_confirmed, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies, coalesce(string_agg(DISTINCT currency, ',' ORDER BY currency) FILTER (confirmation_status = 'confirmed'), '') AS confirmed_currencies
FROM collapsed WHERE event_status = 'active' AND year IS NOT NULL GROUP BY symbol, year),
i AS (SELECT symbol, fiscal_year AS year, count(*) AS incomplete FROM collapsed WHERE year IS NULL GROUP BY ALL),
b AS (SELECT symbol, year, coalesce(s.events, 0) AS events, coalesce(s.total, 0) AS total, coalesce(s.confirmed_total, 0) AS confirmed_total, coalesce(s.fully_confirmed, FALSE) AS fully_confirmed, coalesce(s.currencies, '') AS currencies,
coalesce(s.confirmed_currencies, '') AS confirmed_currencies, coalesce(i.incomplete, 0) AS incomplete FROM s FULL JOIN i USING (symbol, year))
SELECT b.*, coalesce(p.confirmed_total, 0) AS prior_confirmed_total, CASE WHEN p.confirmed_currencies <> '' AND NOT contains(p.confirmed_currencies, ',') THEN p.confirmed_currencies END AS prior_currency
FROM b LEFT JOIN s p ON p.symbol = b.symbol AND p.year = b.year - 1""",
)
def dividend_summary(spark, sf_dir):
    return dividends.dividend_summary(collapsed(spark, sf_dir))


@query("dividend_by_currency", f"WITH {COLLAPSE} SELECT symbol, year, currency, count(*) AS events, CAST(sum(amount_per_share) AS DECIMAL(28, 6)) AS total FROM collapsed WHERE event_status = 'active' AND year IS NOT NULL GROUP BY ALL")
def dividend_by_currency(spark, sf_dir):
    return dividends.dividend_by_currency(collapsed(spark, sf_dir))


@query("dividend_announcements", f"SELECT {ROW} FROM fx_div WHERE fiscal_year BETWEEN 1997 AND 1998")
def dividend_announcements(spark, sf_dir):
    return dividends.announcements(view(spark, sf_dir, "fx_div"), 1997, 1998).select(*ROW.split(", "))


# Announcements with faults of every kind, in SQL for both engines.
CLAIMED = {
    "dividend_id": "dividend_id",
    "symbol": "CASE WHEN CAST(dividend_id AS BIGINT) % 37 = 0 THEN ' ' ELSE symbol END",
    "fiscal_year": "CASE WHEN CAST(dividend_id AS BIGINT) % 19 = 0 THEN 1905 ELSE fiscal_year END",
    "event_status": "CASE WHEN CAST(dividend_id AS BIGINT) % 23 = 0 THEN 'revised' ELSE event_status END",
    "amount_per_share": "CASE WHEN CAST(dividend_id AS BIGINT) % 11 = 0 THEN 0 * amount_per_share ELSE amount_per_share END",
    "source_kind": "CASE WHEN CAST(dividend_id AS BIGINT) % 17 = 0 THEN 'blog' WHEN source_priority = 1 THEN 'issuer_announcement' WHEN source_priority = 2 THEN 'exchange_announcement' WHEN source_priority = 3 THEN 'regulatory_filing' ELSE 'third_party' END",
    "confirmation_status": "CASE WHEN CAST(dividend_id AS BIGINT) % 41 = 0 THEN 'maybe' WHEN CAST(dividend_id AS BIGINT) % 10 = 3 THEN 'confirmed' ELSE confirmation_status END",
    "source_url": "CASE WHEN CAST(dividend_id AS BIGINT) % 13 = 1 THEN '' ELSE 'https://example.org/' END",
    "source_document_id": "source_document_id",
    "announcement_date": "CASE WHEN CAST(dividend_id AS BIGINT) % 31 = 0 THEN NULL ELSE announcement_date END",
    "payment_date": "payment_date",
    "expected_payment_date": "CASE WHEN CAST(dividend_id AS BIGINT) % 5 = 0 THEN announcement_date WHEN CAST(dividend_id AS BIGINT) % 5 = 1 THEN expected_payment_date END",
    "currency": "CASE WHEN CAST(dividend_id AS BIGINT) % 43 = 0 THEN 'C1Y' ELSE lower(currency) END",
}


@query(
    "normalize_dividends",
    f"""WITH c AS (SELECT {", ".join(f"{v} AS {k}" for k, v in CLAIMED.items())} FROM fx_div)
SELECT dividend_id, upper(currency) AS currency, coalesce(expected_payment_date, payment_date) AS expected_payment_date, CASE source_kind WHEN 'issuer_announcement' THEN 1 WHEN 'exchange_announcement' THEN 2 WHEN 'regulatory_filing' THEN 3 WHEN 'third_party' THEN 9 END AS source_priority,
CASE WHEN symbol = ' ' THEN 'missing_symbol' WHEN fiscal_year < 1990 THEN 'invalid_fiscal_year' WHEN event_status = 'revised' THEN 'invalid_event_status' WHEN amount_per_share = 0 AND event_status <> 'cancelled' THEN 'invalid_amount'
WHEN source_kind = 'blog' THEN 'invalid_source_kind' WHEN confirmation_status = 'maybe' THEN 'invalid_confirmation_status' WHEN source_kind = 'third_party' AND confirmation_status = 'confirmed' THEN 'third_party_confirmed'
WHEN confirmation_status = 'confirmed' AND (source_url = '' OR source_document_id = '') THEN 'missing_evidence' WHEN announcement_date IS NULL THEN 'missing_announcement_date'
WHEN payment_date <> expected_payment_date THEN 'payment_date_conflict' WHEN currency = 'C1Y' THEN 'invalid_currency' END AS error_code FROM c""",
)
def normalize_dividends(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div").selectExpr(*(f"{v} AS {k}" for k, v in CLAIMED.items()))
    return dividends.normalize_dividends(rows).select("dividend_id", "currency", "expected_payment_date", "source_priority", "error_code")


@query("dividend_id", "SELECT dividend_id AS row_id, sha256(concat_ws('|', symbol, CAST(fiscal_year AS VARCHAR), CAST(announcement_date AS VARCHAR), rtrim(rtrim(CAST(amount_per_share AS VARCHAR), '0'), '.'), currency, coalesce(CAST(coalesce(payment_date, expected_payment_date) AS VARCHAR), ''))) AS dividend_id FROM fx_div")
def dividend_id(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div").withColumnRenamed("dividend_id", "row_id")
    return dividends.with_dividend_id(rows).select("row_id", "dividend_id")


@query(
    "date_evidence",
    """SELECT dividend_id, f.name AS field, f.v AS value, nullif(source_document_id, '') AS source_document_id, confirmation_status AS verification_status, source_priority, 'lowest_source_priority_then_latest_observation' AS selection_policy,
CASE WHEN f.v IS NULL THEN concat(f.name, '_not_provided_by_source') END AS missing_reason
FROM (SELECT *, unnest([{'name': 'record_date', 'v': CAST(record_date AS VARCHAR)}, {'name': 'ex_date', 'v': CAST(ex_date AS VARCHAR)}, {'name': 'payment_date', 'v': CAST(payment_date AS VARCHAR)}]) AS f FROM fx_div)""",
)
def date_evidence(spark, sf_dir):
    rows = dividends.date_evidence(view(spark, sf_dir, "fx_div"))
    return rows.select("dividend_id", F.explode("evidence").alias("field", "e")).select("dividend_id", "field", "e.value", "e.source_document_id", "e.verification_status", "e.source_priority", "e.selection_policy", "e.missing_reason")


ARRIVAL = "{'dividend_id': concat_ws('-', symbol, CAST(fiscal_year AS VARCHAR), currency), 'symbol': symbol, 'arrival': CAST(dividend_id AS BIGINT), 'observed_at': CAST(announcement_date AS TIMESTAMP), 'confirmation_status': confirmation_status, 'source_priority': source_priority, 'amount_per_share': CAST(amount_per_share AS DOUBLE)}"


@query(
    "upsert_dividends",
    f"""WITH r AS (SELECT {ARRIVAL} AS x FROM fx_div), f AS (SELECT list_reduce(list(x ORDER BY x.arrival), lambda a, b:
CASE WHEN b.source_priority < a.source_priority OR (b.source_priority = a.source_priority AND (b.observed_at > a.observed_at OR (a.confirmation_status = 'unverified' AND b.confirmation_status = 'confirmed'))) THEN b ELSE a END) AS s FROM r GROUP BY x.dividend_id)
SELECT s.dividend_id, s.symbol, s.arrival, s.observed_at, s.confirmation_status, s.source_priority, s.amount_per_share FROM f""",
)
def upsert_dividends(spark, sf_dir):
    """Arrivals of one dividend: announcements of a symbol and year in the order of their ids."""
    rows = view(spark, sf_dir, "fx_div").withColumn("arrival", F.col("dividend_id").cast("long")).withColumn("observed_at", F.col("announcement_date").cast("timestamp"))
    keyed = rows.withColumn("dividend_id", F.concat_ws("-", "symbol", F.col("fiscal_year").cast("string"), "currency"))
    return dividends.upsert_dividends(keyed.select("dividend_id", "symbol", "arrival", "observed_at", "confirmation_status", "source_priority", F.col("amount_per_share").cast("double").alias("amount_per_share")))


STRUCTURED = """r AS (SELECT symbol, o_orderkey AS position, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 0 * amount_per_share ELSE amount_per_share END AS cash_div_tax, amount_per_share AS cash_div, currency, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE strftime(announcement_date, '%Y%m%d') END AS ann_date,
strftime(record_date, '%Y%m%d') AS record_day, strftime(ex_date, '%Y%m%d') AS ex_day, strftime(payment_date, '%Y%m%d') AS pay_day, record_date, ex_date, payment_date FROM (SELECT *, CAST(dividend_id AS BIGINT) AS o_orderkey FROM fx_div))"""


@query(
    "structured_dividends",
    f"""WITH {STRUCTURED}, e AS (SELECT symbol, currency, coalesce(nullif(cash_div_tax, 0), cash_div) AS amount_per_share, payment_date, position, (record_date IS NOT NULL)::INT + (ex_date IS NOT NULL)::INT + (payment_date IS NOT NULL)::INT AS filled FROM r WHERE ann_date IS NOT NULL)
SELECT symbol, currency, amount_per_share, payment_date, position FROM e WHERE year(payment_date) = 1998 QUALIFY row_number() OVER (PARTITION BY symbol, amount_per_share, currency, payment_date ORDER BY filled DESC, position) = 1""",
)
def structured_dividends(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div").withColumn("position", F.col("dividend_id").cast("long"))
    text = lambda c: F.date_format(c, "yyyyMMdd")
    rows = rows.select("symbol", "currency", "position", F.when(F.col("position") % 5 == 1, F.lit(0)).when(F.col("position") % 5 != 0, F.col("amount_per_share")).cast("decimal(18,6)").alias("cash_div_tax"), F.col("amount_per_share").alias("cash_div"), F.when(F.col("position") % 10 != 9, text("announcement_date")).alias("ann_date"), text("record_date").alias("record_day"), text("ex_date").alias("ex_day"), text("payment_date").alias("pay_day"))
    return dividends.structured_dividends(rows, 1998).select("symbol", "currency", "amount_per_share", "payment_date", "position")


@query("fund_dividends", "SELECT dividend_id, CAST(CAST(amount_per_share AS DECIMAL(28, 10)) / 10 AS DECIMAL(28, 6)) AS amount_per_share FROM fx_div")
def fund_dividends(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div").withColumn("cash", F.col("amount_per_share")).withColumn("base_units", F.lit(10))
    return dividends.fund_dividends(rows).select("dividend_id", F.col("amount_per_share").cast("decimal(28,6)").alias("amount_per_share"))


@query("fund_dividends_all", "SELECT dividend_id, CAST(CAST(amount_per_share AS DECIMAL(28, 10)) / 10 AS DECIMAL(28, 6)) AS amount_per_share FROM fx_div")
def fund_dividends_all(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div").withColumn("cash", F.col("amount_per_share")).withColumn("base_units", F.lit(10))
    return dividends.fund_dividends(rows).select("dividend_id", F.col("amount_per_share").cast("decimal(28,6)").alias("amount_per_share"))


@query("discovered_dividends", "SELECT dividend_id, amount_per_share, announcement_date FROM fx_div WHERE fiscal_year = 1997")
def discovered_dividends(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div").withColumn("end_date", F.concat(F.col("fiscal_year").cast("string"), F.lit("1231"))).withColumn("notice_date", F.date_format("announcement_date", "yyyyMMdd"))
    return dividends.discovered_dividends(rows.drop("announcement_date"), 1997).select("dividend_id", "amount_per_share", "announcement_date")


@query("cash_text_antijoin", "WITH d AS (SELECT * FROM fx_div WHERE source_document_id <> '') SELECT dividend_id, symbol, amount_per_share FROM fx_div x WHERE source_document_id <> '' OR NOT EXISTS (SELECT 1 FROM d WHERE d.symbol = x.symbol AND d.currency = x.currency AND d.payment_date = x.payment_date AND abs(CAST(d.amount_per_share AS DOUBLE) - CAST(x.amount_per_share AS DOUBLE)) <= 0.01 * greatest(abs(CAST(d.amount_per_share AS DOUBLE)), abs(CAST(x.amount_per_share AS DOUBLE))))")
def cash_text_antijoin(spark, sf_dir):
    return dividends.drop_undocumented(view(spark, sf_dir, "fx_div")).select("dividend_id", "symbol", "amount_per_share")


@query("parse_cash_text", "SELECT symbol, amount_per_share, currency, payment_date, min(CAST(dividend_id AS BIGINT)) AS position FROM fx_div GROUP BY ALL")
def parse_cash_text(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div").select("symbol", "payment_date", F.col("dividend_id").cast("long").alias("position"), F.format_string("%s dividend: %s %s", F.when(F.col("fiscal_year") % 2 == 0, "Cash").otherwise("Special"), F.col("amount_per_share").cast("string"), "currency").alias("text"))
    return dividends.parse_cash_text(rows).select("symbol", "amount_per_share", "currency", "payment_date", "position")


@query("fallback_sources", "WITH p AS (SELECT * FROM fx_div WHERE confirmation_status = 'confirmed'), s AS (SELECT * FROM fx_div WHERE confirmation_status = 'unverified') SELECT dividend_id, symbol, confirmation_status FROM p UNION ALL SELECT dividend_id, symbol, confirmation_status FROM s WHERE symbol NOT IN (SELECT symbol FROM p)")
def fallback_sources(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div")
    return dividends.fallback_sources(rows.where("confirmation_status = 'confirmed'"), rows.where("confirmation_status = 'unverified'")).select("dividend_id", "symbol", "confirmation_status")


@query("fallback_sources_all", "WITH p AS (SELECT * FROM fx_div WHERE confirmation_status = 'confirmed'), s AS (SELECT * FROM fx_div WHERE confirmation_status = 'unverified') SELECT dividend_id, symbol, confirmation_status FROM p UNION ALL SELECT dividend_id, symbol, confirmation_status FROM s WHERE symbol NOT IN (SELECT symbol FROM p)")
def fallback_sources_all(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div")
    return dividends.fallback_sources(rows.where("confirmation_status = 'confirmed'"), rows.where("confirmation_status = 'unverified'")).select("dividend_id", "symbol", "confirmation_status")


CACHE = "c AS (SELECT provider, attempt_no, attempted_at AS refreshed_at, CAST(1 + attempt_no % 2 AS INTEGER) AS version, CASE WHEN NOT success THEN 'failed' WHEN attempt_no % 3 = 0 THEN 'success_empty' ELSE 'success_data' END AS outcome FROM fx_attempt)"
AT = "TIMESTAMP '2024-01-08 00:00:00'"
AGE = f"CAST(floor(epoch({AT})) - floor(epoch(refreshed_at)) AS BIGINT)"


def cache_rows(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_attempt")
    outcome = F.when(~F.col("success"), "failed").when(F.col("attempt_no") % 3 == 0, "success_empty").otherwise("success_data")
    return rows.select("provider", "attempt_no", F.col("attempted_at").alias("refreshed_at"), (1 + F.col("attempt_no") % 2).cast("int").alias("version"), outcome.alias("outcome"))


@query("cache_state", f"WITH {CACHE} SELECT attempt_no, {AGE} AS age_seconds, CASE WHEN version <> 1 THEN 'none' WHEN {AGE} <= CASE outcome WHEN 'success_data' THEN 21600 WHEN 'success_empty' THEN 900 ELSE 300 END THEN 'fresh' ELSE 'expired' END AS state FROM c")
def cache_state(spark, sf_dir):
    return dividends.cache_state(cache_rows(spark, sf_dir), F.lit("2024-01-08 00:00:00").cast("timestamp"), 1).select("attempt_no", "age_seconds", "state")


@query(
    "batch_status",
    f"""WITH want AS (SELECT concat('prov', CAST(s_suppkey % 12 AS VARCHAR)) AS symbol, min(s_suppkey) AS first FROM supplier GROUP BY 1), l AS (SELECT provider AS symbol, arg_max(success, attempt_no) AS ok, max(attempt_no) % 4 = 1 AS refreshing FROM fx_attempt GROUP BY 1)
SELECT first AS position, symbol, CASE WHEN l.ok IS NULL THEN 'unavailable' WHEN NOT l.ok THEN 'error' WHEN refreshing THEN 'refreshing' ELSE 'available' END AS status FROM want LEFT JOIN l USING (symbol)""",
)
def batch_status(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), F.concat(F.lit("prov"), (F.col("s_suppkey") % 12).cast("string")).alias("symbol"))
    states = view(spark, sf_dir, "fx_attempt").groupBy(F.col("provider").alias("symbol")).agg(F.when(F.max_by("success", "attempt_no"), "fresh").otherwise("failed").alias("state"), (F.max("attempt_no") % 4 == 1).alias("refreshing"))
    return dividends.batch_status(asked, states)


FAILURES = {0: "Read timed out", 1: "HTTP 429", 2: "Rate limit reached", 3: "invalid date field", 4: "could not decode", 5: "unknown payload", 6: "connection reset", 7: "bad FORMAT after timeout"}


@query("classify_failure", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'failed_timeout' WHEN 7 THEN 'failed_timeout' WHEN 1 THEN 'failed_rate_limited' WHEN 2 THEN 'failed_rate_limited' WHEN 3 THEN 'failed_parse' WHEN 5 THEN CASE WHEN user_id % 2 = 0 THEN 'failed_parse' ELSE 'failed_source' END ELSE 'failed_source' END AS failure FROM events")
def classify_failure(spark, sf_dir):
    text = F.get(F.array(*(F.lit(FAILURES[i]) for i in range(8))), (F.col("event_id") % 8).cast("int"))
    of_values = (F.col("event_id") % 8 != 5) | (F.col("user_id") % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", dividends.classify_failure(text, of_values).alias("failure"))


# The names and numbers that the pages have; tests/test_filings.py holds all others against the standard library.
NAMED = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "''", "&apos;": "''", "&copy;": "©", "&middot;": "·", "&rsquo;": "’"}
PLAIN = "regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'gs')"
for _name, _char in NAMED.items():
    PLAIN = f"replace({PLAIN}, '{_name}', '{_char}')"
PLAIN = f"trim(regexp_replace(regexp_replace({PLAIN}, '&amp;?|&#38;', '&', 'g'), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


@query("filing_text", f"SELECT page_id, sha256({PLAIN}) AS text_sha256 FROM pages")
def filing_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(filings.plain_text(F.col("html")), 256).alias("text_sha256"))


@query(
    "filing_dividends",
    """SELECT concat(CAST(page_id AS VARCHAR), '#0') AS source_document_id, CAST(CAST(page_id % 7 AS DECIMAL(18, 6)) / 10 AS DECIMAL(18, 6)) AS amount_per_share, CAST(DATE '2024-01-05' + CAST(page_id % 20 AS INTEGER) AS DATE) AS payment_date,
CASE WHEN page_id % 2 = 0 THEN DATE '2024-01-02' END AS record_date, 2023 AS fiscal_year FROM pages WHERE page_id % 7 > 0 AND page_id % 5 > 1""",
)
def filing_dividends(spark, sf_dir):
    """Every page with a notice after its own text: dividends, some of 0, some without a payable date, and earnings per share, which are none."""
    day = F.date_format(F.expr("date'2024-01-05' + cast(page_id % 20 as int)"), "MMMM d, yyyy")
    amount = F.format_string("0.%d", F.col("page_id") % 7)
    dividend = F.concat(F.lit("<p>The board declared a cash&nbsp;dividend of $"), amount, F.lit(" per share"), F.when(F.col("page_id") % 2 == 0, F.lit(" to shareholders of record as of January 2, 2024")).otherwise(F.lit("")))
    notice = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<p>Earnings were $"), amount, F.lit(" per share, payable on "), day)).otherwise(F.concat(dividend, F.when(F.col("page_id") % 5 > 1, F.concat(F.lit(", payable on "), day)).otherwise(F.lit(""))))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("accession"), F.lit("2023-12-20T10:00:00Z").alias("filed_at"), F.concat(F.coalesce("html", F.lit("")), F.lit("."), notice, F.lit(".</p>")).alias("body"))
    return filings.filing_dividends(rows).select("source_document_id", "amount_per_share", "payment_date", "record_date", "fiscal_year")


@query(
    "cn_announcement_dividends",
    """SELECT dividend_id AS row_id, CAST(amount_per_share / CASE WHEN CAST(dividend_id AS BIGINT) % 3 = 2 THEN 1 ELSE 10 END AS DECIMAL(28, 10)) AS amount_per_share, payment_date, record_date, fiscal_year, '年度' AS distribution_period, sha256(concat(symbol, '|', fiscal_year, '|年度')) AS dividend_id
FROM fx_div WHERE payment_date IS NOT NULL AND fiscal_year >= 2000 AND CAST(dividend_id AS BIGINT) % 5 > 0""",
)
def cn_announcement_dividends(spark, sf_dir):
    """Notices of ten shares, of ten shares with stock and cash, and of one share; every fifth is only about a meeting."""
    rows = view(spark, sf_dir, "fx_div").withColumn("_id", F.col("dividend_id").cast("long"))
    cash = F.col("amount_per_share").cast("string")
    plan = F.when(F.col("_id") % 3 == 0, F.concat(F.lit("每10股派发现金红利"), cash)).when(F.col("_id") % 3 == 1, F.concat(F.lit("每 10 股送3股派发现金红利 "), cash)).otherwise(F.concat(F.lit("每股派发现金红利"), cash))
    head = F.concat(F.col("fiscal_year").cast("string"), F.lit("年年度权益分派"), F.when(F.col("_id") % 5 > 0, "实施公告").otherwise("预案的股东大会通知"))
    dates = [F.concat(F.lit(f"{w}："), F.date_format(c, p)) for w, c, p in (("股权登记日", "record_date", "yyyy-MM-dd"), ("现金红利发放日", "payment_date", "yyyy年M月d日"))]
    text = F.concat_ws("\n", head, F.concat(F.lit("本次实施的权益分派方案："), plan, F.lit("元（含税）。")), *dates)
    found = filings.cn_announcement_dividends(rows.select(F.col("dividend_id").alias("row_id"), "symbol", text.alias("text")))
    return found.select("row_id", "amount_per_share", "payment_date", "record_date", "fiscal_year", "distribution_period", "dividend_id")


@query(
    "hk_form_dividends",
    """SELECT dividend_id AS row_id, CAST(amount_per_share / CASE WHEN CAST(dividend_id AS BIGINT) % 2 = 0 THEN 2 ELSE 1 END AS DECIMAL(28, 10)) AS amount_per_share, currency, payment_date, record_date, announcement_date, fiscal_year, 'final' AS dividend_type,
CASE WHEN event_status = 'cancelled' THEN 'cancelled' ELSE 'active' END AS event_status, sha256(concat(symbol, '|31 December ', fiscal_year, '|final')) AS dividend_id FROM fx_div WHERE payment_date IS NOT NULL AND payment_date >= DATE '2000-01-01' AND announcement_date >= DATE '2000-01-01'""",
)
def hk_form_dividends(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_div").withColumn("_id", F.col("dividend_id").cast("long"))
    code = F.when(F.col("currency") == "CNY", "RMB").otherwise(F.col("currency"))
    dated = lambda w, c: F.concat(F.lit(f"{w} "), F.date_format(c, "d MMMM yyyy"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Status "), F.when(F.col("event_status") == "cancelled", "Cancelled").otherwise("New announcement")), dated("Announcement date", "announcement_date"), F.lit("Dividend type Final Dividend nature Ordinary"),
        F.concat(F.lit("For the financial year end 31 December "), F.col("fiscal_year").cast("string")), F.concat(F.lit("Dividend declared "), code, F.lit(" "), F.col("amount_per_share").cast("string"), F.when(F.col("_id") % 2 == 0, " per 2 share").otherwise(" per share")),
        dated("Book close date", "record_date"), dated("Payment date", "payment_date"),
    )
    found = filings.hk_form_dividends(rows.select(F.col("dividend_id").alias("row_id"), "symbol", text.alias("text")))
    return found.select("row_id", "amount_per_share", "currency", "payment_date", "record_date", "announcement_date", "fiscal_year", "dividend_type", "event_status", "dividend_id")
