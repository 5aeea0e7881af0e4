"""Calendars, indicators, exposure facts, instruments, provider health and artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.scalars import normalize_a_symbol
from tideframe.operators.filings import plain_text
from tideframe.operators.versions import newest

# Time zones of markets.
ZONES = {"US": "America/New_York", "CN": "Asia/Shanghai", "HK": "Asia/Hong_Kong"}
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def economic_calendar(events: DataFrame, first: str, last: str, country: str | None = None, impact: str | None = None, limit: int | None = None) -> DataFrame:
    """Events of a date range in order of date and time."""
    found = events.where(F.col("event_date").between(first, last))
    if country is not None:
        found = found.where(F.col("country") == country)
    if impact is not None:
        found = found.where(F.col("impact") == impact)
    return found if limit is None else found.orderBy("event_date", "event_time", "event_id").limit(limit)


def earnings_calendar(events: DataFrame, first: str, last: str, market: str | None = None, symbols: DataFrame | None = None) -> DataFrame:
    found = events.where(F.col("event_date").between(first, last))
    if market is not None:
        found = found.where(F.col("market") == market)
    return found if symbols is None else found.join(symbols, "symbol", "left_semi")


def indicators(rows: DataFrame, country: str | None = None, source: str | None = None) -> DataFrame:
    for column, value in (("country", country), ("source", source)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.col("latest_date").desc(), "name")


def plain(value: Column) -> Column:
    """A provider's text: character references resolved, single spaces, none at the ends; empty for null."""
    return plain_text(value.cast("string"))


def hash_id(*parts: Column) -> Column:
    """24 hexadecimal digits of a hash of the lower-cased plain parts."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.lower(plain(p)) for p in parts)), 256), 1, 24)


def time_zone(market: Column) -> Column:
    zone = F.lit("UTC")
    for name, value in ZONES.items():
        zone = F.when(market == name, F.lit(value)).otherwise(zone)
    return zone


def scheduled_at(day: Column, clock: Column, zone: Column) -> Column:
    """UTC time of a day and a full HH:MM:SS clock of a zone; null for anything less."""
    local = F.when(clock.rlike("^[0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.concat_ws(" ", day, clock).try_cast("timestamp"))
    return F.to_utc_timestamp(local, zone).cast("timestamp_ntz")


def normalize_event(rows: DataFrame) -> DataFrame:
    """rows with event_id, time_zone and scheduled_at. The source is part of the id: two sources' accounts of one event are two."""
    out = rows.withColumn("event_id", hash_id(*(F.col(c) for c in ("market", "event_date", "event_time", "event_name", "source")))).withColumn("time_zone", time_zone(F.col("market")))
    return out.withColumn("scheduled_at", scheduled_at(F.col("event_date"), F.col("event_time"), F.col("time_zone")))


def normalize_earnings(rows: DataFrame) -> DataFrame:
    """Earnings dates with plain texts, symbols as their market writes them (six digits in CN, five in HK), event_id, time_zone and scheduled_at.

    rows: market, symbol, name, report_date, report_time, fiscal_period, eps_forecast, previous_eps, source, other columns.
    """
    text = {c: plain(F.col(c)) for c in ("name", "report_time", "fiscal_period", "eps_forecast", "previous_eps")} | {c: F.upper(plain(F.col(c))) for c in ("market", "symbol")}
    out = rows.withColumns(text)
    digits = F.regexp_replace("symbol", "[^0-9]", "")
    padded = lambda x, n: F.when(F.length(x) < n, F.lpad(x, n, "0")).otherwise(x)
    symbol = F.when(F.col("market") == "CN", padded(F.right(digits, F.lit(6)), 6)).when((F.col("market") == "HK") & (digits != ""), padded(digits, 5)).otherwise(F.col("symbol"))
    out = out.withColumn("symbol", symbol).withColumn("name", F.when(F.col("name") == "", F.col("symbol")).otherwise(F.col("name")))
    out = out.withColumn("event_id", hash_id(*(F.col(c) for c in ("market", "symbol", "report_date", "report_time", "fiscal_period", "source")))).withColumn("time_zone", time_zone(F.col("market")))
    return out.withColumn("scheduled_at", scheduled_at(F.col("report_date"), F.col("report_time"), F.col("time_zone")))


def iso_date(text: Column) -> Column:
    """The first 20YY-M-D or 20YY/M/D of a text as an ISO date."""
    part = [F.regexp_extract(text, r"(20[0-9]{2})[-/]([01]?[0-9])[-/]([0-3]?[0-9])", i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.try_to_date(F.concat_ws("-", *part), "yyyy-M-d").cast("string"))


def parse_us_date(text: Column, year: Column) -> Column:
    """"March 5", "Mar 5, 2024" or "March 5 2024" as an ISO date, the year being given where the text has none; else an ISO date of the text. Null for another word before a number."""
    flat = F.replace(text, F.lit(","), F.lit(""))
    pattern = r"\b([A-Za-z]{3,9})\s+([0-9]{1,2})(?:\s+(20[0-9]{2}))?\b"
    word, day, own = (F.regexp_extract(flat, pattern, i) for i in (1, 2, 3))
    month = F.lit(None).cast("string")
    for i, name in enumerate(_MONTHS.split("|")):
        month = F.when(F.lower(word).isin(name.lower(), name[:3].lower()), F.lit(str(i + 1))).otherwise(month)
    named = F.try_to_date(F.concat(F.when(own != "", own).otherwise(year.cast("string")), F.lit("-"), month, F.lit("-"), day), "yyyy-M-d").cast("string")
    return F.when(word != "", named).otherwise(iso_date(flat))


def parse_us_time(text: Column) -> Column:
    """"8:30 AM", "8:30 a.m." or "2 PM" as HH:MM:SS."""
    flat, pattern = F.replace(F.upper(text), F.lit("."), F.lit("")), r"\b([0-9]{1,2})(?::([0-9]{2}))?\s*(AM|PM)\b"
    hour, minute, half = F.regexp_extract(flat, pattern, 1).try_cast("int"), F.regexp_extract(flat, pattern, 2), F.regexp_extract(flat, pattern, 3)
    hour = F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    return F.when(half != "", F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.when(minute != "", minute).otherwise("00"), F.lit(":00")))


def dedupe_calendar(rows: DataFrame, position: str = "position") -> DataFrame:
    """The last record of each identity: event_id, else indicator_id, else its own place."""
    ids = [F.col(c) for c in ("event_id", "indicator_id") if c in rows.columns]
    identity = F.coalesce(*ids, F.concat(F.lit("row:"), F.col(position).cast("string")))
    return newest(rows.withColumn("_identity", identity), ("_identity",), (position,)).drop("_identity")


def indicator_change(observations: DataFrame) -> DataFrame:
    """The latest observation of each series with change and percent against the one before."""
    order = Window.partitionBy("series").orderBy(F.col("observed_on").desc())
    rows = observations.withColumn("_n", F.row_number().over(order)).withColumn("previous", F.lead("value").over(order)).where("_n = 1").drop("_n")
    change = F.col("value") - F.col("previous")
    return rows.withColumn("change", change).withColumn("change_pct", F.when(F.col("previous") != 0, change / F.col("previous") * 100))


def month_of(year: Column, period: Column) -> Column:
    """First day of M01 to M12; null for other periods."""
    month = F.regexp_extract(period, r"^M(0[1-9]|1[0-2])$", 1)
    return F.when(month != "", F.make_date(year, month.try_cast("int"), F.lit(1)))


def snapshot(**sections: DataFrame) -> DataFrame:
    """Several calendars in one, each with its name as section."""
    out = None
    for name, rows in sections.items():
        tagged = rows.withColumn("section", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def evidence(source_id: Column, fetched_at: Column, effective_at: Column, tier: Column, url: Column, record: Column, confidence: str = "reported") -> Column:
    """Where a fact comes from: a source with a url or a record's id, when it was fetched, from when it holds, and how near to the source it is."""
    return F.struct(
        source_id.alias("source_id"), F.nullif(url, F.lit("")).alias("source_url"), F.nullif(record, F.lit("")).alias("source_record_id"), fetched_at.cast("timestamp").alias("fetched_at"),
        effective_at.cast("timestamp").alias("effective_at"), tier.alias("source_tier"), F.lit(confidence).alias("confidence"),
    )


def repository_fragment(quotes: DataFrame, fundamentals: DataFrame, now: Column) -> DataFrame:
    """What the stored tables know of each symbol: asset type, market, currency, classifications and their evidence, as a fragment for merge_exposure().

    quotes: the latest quote of each symbol (symbol, market, source, source_url, currency, quote_at, observed_at, ingested_at). fundamentals: the latest
    row of each code of the CN market (symbol, report_period, industry, ingested_at). A quote of another market has no
    fundamental; a code without a quote stands with its exchange's suffix, and goes if it isn't one of six digits.
    """
    q = quotes.select(F.col("symbol"), F.col("market"), F.substring_index("symbol", ".", 1).alias("_code"), F.struct("source", "source_url", "currency", "quote_at", "observed_at", "ingested_at").alias("q"))
    f = fundamentals.select(F.col("symbol").alias("_own"), F.struct("report_period", F.nullif(F.trim("industry"), F.lit("")).alias("industry"), "ingested_at").alias("f"))
    both = q.join(f, (F.col("_code") == F.col("_own")) & (F.col("market") == "CN"), "full_outer")
    code, there = F.coalesce("_code", "_own"), F.col("q").isNotNull()
    observed = F.coalesce("q.ingested_at", "q.observed_at", "f.ingested_at", now)
    effective = F.coalesce("q.quote_at", observed)
    url = F.coalesce("q.source_url", F.lit(""))
    record = F.when(url == "", F.concat(F.lit("fundamental_snapshot:"), F.coalesce("f.report_period", F.lit("latest")), F.lit(":"), code))
    proof = evidence(F.coalesce("q.source", F.lit("fundamental_snapshot")), observed, effective, F.when(there, "primary_market_data").otherwise("primary_filing_aggregation"), url, record)
    known = both.withColumn("_proof", proof)
    industry = F.struct(F.lit("eastmoney_basic_industry").alias("scheme"), F.col("f.industry").alias("value"), F.lit(None).cast("string").alias("level"), F.col("_proof").alias("evidence"))
    return known.select(
        F.coalesce("symbol", normalize_a_symbol(F.col("_own"))).alias("symbol"),
        F.when(F.col("f").isNotNull(), "equity").otherwise("unknown").alias("asset_type"),
        F.coalesce("market", F.lit("CN")).alias("market"),
        F.col("q.currency").alias("currency"),
        effective.cast("timestamp").alias("as_of"),
        F.array_compact(F.array(F.when(F.col("f.industry").isNotNull(), industry))).alias("classifications"),
        F.array().cast("array<string>").alias("company_materials"),
        F.lit(None).cast("string").alias("holdings"),
        F.array("_proof").alias("evidence"),
    ).where("symbol IS NOT NULL")


def merge_exposure(fragments: DataFrame) -> DataFrame:
    """One row for each symbol from fragments by priority: first known asset type, first market, currency and holdings, all classifications, materials and evidence in order.

    Only funds have holdings; theirs are available or unavailable, other assets' not applicable.
    """
    known = F.when(~F.col("asset_type").isin("unknown", ""), F.col("asset_type"))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("priority")))
    rows = fragments.withColumn("_known", known)
    lists = [c for c in ("classifications", "company_materials", "evidence") if c in fragments.columns]
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("priority", "source", F.col(c).alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast(fragments.schema[c].dataType))))
    out = rows.groupBy("symbol").agg(
        F.coalesce(first(F.col("_known")), F.lit("unknown")).alias("asset_type"), first(F.col("market")).alias("market"), first(F.col("currency")).alias("currency"), first(F.col("holdings")).alias("_holdings"),
        *(ordered(c).alias(c) for c in lists), F.max("as_of").alias("as_of"),
    )
    fund = F.col("asset_type").isin("fund", "etf")
    out = out.withColumn("holdings", F.when(fund, F.col("_holdings"))).drop("_holdings")
    out = out.withColumn("holdings_status", F.when(~fund, "not_applicable").when(F.col("holdings").isNotNull(), "available").otherwise("unavailable"))
    if "company_materials" not in lists:
        return out
    return out.withColumn("company_materials_status", F.when(F.size("company_materials") > 0, "available").otherwise("unavailable"))


def serve_stale(rows: DataFrame, now: Column, fresh: int = 86_400, usable: int = 604_800) -> DataFrame:
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("as_of").cast("timestamp"))).cast("long")
    return rows.withColumn("age_seconds", age).withColumn("state", F.when(F.col("age_seconds") <= fresh, "fresh").when(F.col("age_seconds") <= usable, "stale").otherwise("unavailable"))


def resolve_mapping(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    return requests.join(mapping, ["namespace", "external_symbol"])


def explode_mappings(instruments: DataFrame) -> DataFrame:
    """Mapping rows of instruments' provider and broker maps."""
    parts = [instruments.select(F.explode(f"{kind}_symbols").alias("k", "external_symbol"), "instrument_id").select(F.concat(F.lit(f"{kind}:"), "k").alias("namespace"), "external_symbol", "instrument_id") for kind in ("provider", "broker")]
    return parts[0].unionByName(parts[1])


def mapping_conflicts(mapping: DataFrame) -> DataFrame:
    """External symbols that stand for several instruments."""
    found = mapping.groupBy("namespace", "external_symbol").agg(F.count_distinct("instrument_id").alias("instruments"), F.min("instrument_id").alias("first"), F.max("instrument_id").alias("last"))
    return found.where("instruments > 1")


def instrument_check(rows: DataFrame) -> DataFrame:
    """rows with errors, the list of what is wrong among the columns that they have."""
    positive = lambda c: F.col(c).cast("string").rlike(r"^(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$") & (F.col(c).try_cast("decimal(38,18)") > 0)
    checks = (
        (("instrument_id", "symbol", "mic"), F.col("instrument_id") == F.concat_ws(".", "symbol", "mic"), "id_mismatch"),
        (("instrument_id",), F.col("instrument_id").rlike(r"^[A-Z0-9][A-Z0-9.-]{0,31}\.[A-Z0-9]{4}$"), "invalid_id"),
        (("mic",), F.col("mic").rlike("^[A-Z0-9]{4}$"), "invalid_mic"),
        (("symbol",), F.length("symbol").between(1, 32), "invalid_symbol"),
        (("market",), F.col("market").isin("US", "HK", "CN"), "invalid_market"),
        (("currency",), F.col("currency").rlike("^[A-Z]{3}$"), "invalid_currency"),
        (("price_precision",), F.col("price_precision").between(0, 18), "invalid_precision"),
        (("size_precision",), F.col("size_precision") == 0, "invalid_size_precision"),
        (("tick_size",), positive("tick_size"), "invalid_tick_size"),
        (("lot_size",), positive("lot_size"), "invalid_lot_size"),
        (("size_increment",), F.col("size_increment").cast("string") == "1", "invalid_size_increment"),
        (("ts_event", "ts_init"), F.col("ts_event") <= F.col("ts_init"), "clock_order"),
    )
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for needs, ok, name in checks if set(needs) <= set(rows.columns)]
    return rows.withColumn("errors", F.array_compact(F.array(*found)))


def provider_health(attempts: DataFrame) -> DataFrame:
    """Of each provider, from its log of attempts: healthy or unhealthy by the last one, when that and the last success were, the last one's error and the failures in a row."""
    last = F.max_by(F.struct("success", "attempted_at", "error"), F.col("attempt_no"))
    log = attempts.groupBy("provider").agg(F.count("*").alias("attempts"), last.alias("_last"), F.max(F.when(F.col("success"), F.struct("attempt_no", "attempted_at"))).alias("_ok"))
    after = attempts.join(log.select("provider", F.col("_ok.attempt_no").alias("_no")), "provider").where("NOT success AND attempt_no > coalesce(_no, -1)").groupBy("provider").agg(F.count("*").alias("n"))
    out = log.join(after, "provider", "left")
    return out.select(
        "provider", "attempts", F.when(F.col("_last.success"), "healthy").otherwise("unhealthy").alias("status"), F.col("_last.attempted_at").alias("last_attempt_at"), F.col("_ok.attempted_at").alias("last_success_at"),
        F.when(~F.col("_last.success"), F.col("_last.error")).alias("last_error"), F.coalesce("n", F.lit(0)).cast("long").alias("consecutive_failures"),
    )


def latest_runs(runs: DataFrame, n: int, time: str = "started_at", tie: str = "run_id") -> DataFrame:
    return runs.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def artifacts(rows: DataFrame, dataset: str, n: int) -> DataFrame:
    """The newest manifest rows of a dataset."""
    return rows.where(F.col("dataset") == dataset).orderBy(F.col("ingested_at").desc(), F.col("artifact_id").desc()).limit(n)


def latest_artifact(rows: DataFrame, key: str) -> DataFrame:
    """The newest artifact of each dataset and value of a metadata key."""
    return newest(rows.withColumn("value", F.get_json_object("metadata_json", f"$.{key}")), ("dataset", "value"), ("ingested_at", "artifact_id"))


def first_available(quotes: DataFrame, ranks: DataFrame, cached: DataFrame, requested: str | None = None) -> DataFrame:
    """For each symbol the quote of the best-ranked source with a usable price, else the cached one, marked stale."""
    rank = F.when(F.col("source") == F.lit(requested), F.lit(-1)).otherwise(F.col("rank"))
    ranked = quotes.join(ranks, "source", "left").withColumn("rank", F.coalesce(rank, F.lit(1 << 30)))
    usable = ranked.where("price > 0").groupBy("symbol").agg(F.min_by(F.struct("source", "price"), F.struct("rank", "source")).alias("q"))
    out = usable.join(cached.select("symbol", F.col("price").alias("_price")), "symbol", "full_outer")
    stale = F.col("q").isNull()
    return out.select("symbol", F.coalesce("q.source", F.lit("cache")).alias("source"), F.coalesce("q.price", "_price").alias("price"), stale.alias("stale"))


def priorities(names: Sequence[str]) -> list[tuple[str, int]]:
    return [(n, i) for i, n in enumerate(names)]
