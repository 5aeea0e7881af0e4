"""Dividends: checking announcements, resolving events, totals by payment year, source parsing and cache states."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators.bars import decimal_text
from tideframe.operators.versions import newest
from tideframe.session import ship

# What a field may hold, and how kinds of sources rank (lower is better). All but third parties are official.
STATUSES = ("confirmed", "unverified")
EVENT_STATUSES = ("active", "cancelled")
SOURCE_PRIORITY = {"fund_manager": 1, "issuer_announcement": 1, "exchange_announcement": 2, "ir_filing": 3, "regulatory_filing": 3, "third_party": 9}
DATES = ("record_date", "ex_date", "payment_date")
SELECTION_POLICY = "lowest_source_priority_then_latest_observation"


def source_priority(kind: Column) -> Column:
    """The rank of a kind of source; null for an unknown one."""
    out = F.lit(None).cast("int")
    for k, v in SOURCE_PRIORITY.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def normalize_dividends(rows: DataFrame) -> DataFrame:
    """rows with source_priority, settled payment date and currency, and error_code (null: valid). Rejects stay as rows, apart by that column.

    A third party can't confirm. A confirmed row needs a url and a document. Only a cancelled event may have an amount of 0. The
    expected payment date follows the payment date; where both are there they must agree.
    """
    rank = source_priority(F.col("source_kind"))
    out = rows.withColumn("source_priority", rank).withColumn("currency", F.upper(F.trim("currency")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    one_of = lambda c, known: F.coalesce(F.col(c).isin(*known), F.lit(False))
    amount = F.col("amount_per_share")
    error = (
        F.when(blank("symbol"), "missing_symbol")
        .when(~F.coalesce(F.col("fiscal_year").between(1990, 2100), F.lit(False)), "invalid_fiscal_year")
        .when(~one_of("event_status", EVENT_STATUSES), "invalid_event_status")
        .when(amount.isNull() | (amount < 0) | ((amount == 0) & (F.col("event_status") != "cancelled")), "invalid_amount")
        .when(F.col("source_priority").isNull(), "invalid_source_kind")
        .when(~one_of("confirmation_status", STATUSES), "invalid_confirmation_status")
        .when((F.col("source_kind") == "third_party") & (F.col("confirmation_status") == "confirmed"), "third_party_confirmed")
        .when((F.col("confirmation_status") == "confirmed") & (blank("source_url") | blank("source_document_id")), "missing_evidence")
        .when(F.col("announcement_date").isNull(), "missing_announcement_date")
        .when(F.col("payment_date").isNotNull() & (F.col("payment_date") != F.col("expected_payment_date")), "payment_date_conflict")
        .when(~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)), "invalid_currency")
    )
    return out.withColumn("error_code", error).withColumn("expected_payment_date", F.coalesce("expected_payment_date", "payment_date"))


def with_dividend_id(rows: DataFrame) -> DataFrame:
    """A hash of symbol, year, announcement, amount, currency and payment date."""
    parts = [F.col("symbol"), F.col("fiscal_year").cast("string"), F.coalesce(F.col("announcement_date").cast("string"), F.lit("")), decimal_text(F.col("amount_per_share")), F.col("currency"), F.coalesce(F.col("payment_date"), F.col("expected_payment_date")).cast("string")]
    return rows.withColumn("dividend_id", F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256))


def date_evidence(rows: DataFrame) -> DataFrame:
    """rows with evidence: for each date field its value, where it comes from, how sure and how chosen it is and, if missing, why."""
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    common = [text("source_name").alias("source_name"), text("source_url").alias("source_url"), text("source_document_id").alias("source_document_id"), F.col("confirmation_status").alias("verification_status"), F.col("source_priority").cast("int").alias("source_priority"), F.lit(SELECTION_POLICY).alias("selection_policy")]
    entry = lambda c: F.struct(F.col(c).cast("string").alias("value"), *common, F.when(F.col(c).isNull(), f"{c}_not_provided_by_source").alias("missing_reason"))
    return rows.withColumn("evidence", F.map_from_arrays(F.array(*(F.lit(c) for c in DATES)), F.array(*(entry(c) for c in DATES))))


def upsert_dividends(arrivals: DataFrame, order: str = "arrival") -> DataFrame:
    """The row of each dividend_id that stands after all arrivals in their order.

    A later row replaces the standing one with a better priority, or with the same one if it was observed later or confirms what
    wasn't. So only arrivals of an id's best priority can stand at the end, and Spark keeps these alone. Which of them does depends on
    their order, so it is a fold over rows that Spark has sorted; a task holds one row and a batch, however many arrivals an id has.
    """
    schema = arrivals.schema
    best = arrivals.groupBy("dividend_id").agg(F.min("source_priority").alias("_best"))
    kept = arrivals.join(best, "dividend_id").where(F.col("source_priority") == F.col("_best")).select(*schema.names)
    ship(arrivals.sparkSession)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        standing = None
        for rows in frames:
            done = []
            for row in rows.itertuples(index=False):
                if standing is None or row.dividend_id != standing.dividend_id:
                    if standing is not None:
                        done.append(standing)
                    standing = row
                elif row.observed_at > standing.observed_at or (standing.confirmation_status == "unverified" and row.confirmation_status == "confirmed"):
                    standing = row
            if done:
                yield pd.DataFrame(done, columns=schema.names)
        if standing is not None:
            yield pd.DataFrame([standing], columns=schema.names)

    return kept.repartition("dividend_id").sortWithinPartitions("dividend_id", order).mapInPandas(fold, schema)


def resolve_events(rows: DataFrame) -> DataFrame:
    """One announcement for each symbol, amount, currency and date: best source, confirmed, most dates, with a document, then the first."""
    day = F.coalesce("expected_payment_date", "payment_date", "announcement_date") if "expected_payment_date" in rows.columns else F.coalesce("payment_date", "announcement_date")
    missing = sum((F.col(c).isNull().cast("int") for c in DATES), F.lit(0))
    order = F.struct(
        F.col("source_priority"), (F.col("confirmation_status") != "confirmed"), missing, (F.coalesce("source_document_id", F.lit("")) == ""), "fiscal_year", "announcement_date", "dividend_id",
    )
    rest = [c for c in rows.columns if c not in ("symbol", "amount_per_share", "currency")]
    best = rows.withColumn("event_date", day).groupBy("symbol", "amount_per_share", "currency", "event_date").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select("symbol", "amount_per_share", "currency", "event_date", "_row.*")


def _payment(event) -> object:
    """When an event is, or is expected to be, paid; None if neither is known."""
    for value in (event.payment_date, getattr(event, "expected_payment_date", None)):
        if not pd.isna(value):
            return value
    return None


def _alike(a, b) -> tuple[bool, bool]:
    """Whether two resolved events of a symbol, year and currency are one, told with different precision or completeness, and whether only one of them has a date.

    They must have the same payment date, or the same amount where one has a date and the other none. Two documents of different
    sources are two events. But for that second case one of the two has a document and the other none. Amounts may differ by one percent, or 0.01 below 1.
    """
    one_dated = a.amount_per_share == b.amount_per_share and (_payment(a) is None) != (_payment(b) is None)
    if _payment(a) != _payment(b) and not one_dated:
        return False, False
    named = bool(a.source_document_id), bool(b.source_document_id)
    if all(named) and a.source != b.source:
        return False, False
    if not one_dated and named[0] == named[1]:
        return False, False
    x, y = Decimal(str(a.amount_per_share)), Decimal(str(b.amount_per_share))
    return abs(x - y) <= Decimal("0.01") * max(abs(x), abs(y), Decimal(1)), one_dated


def _near(event) -> tuple[list[tuple], list[tuple]]:
    """Keys under which an event is kept, and those under which the ones that it may be alike to are: its amount, and its payment date with about its amount."""
    x = float(event.amount_per_share)
    step = int(np.floor(x / 0.01)) if x < 1 else 99 + int(np.floor(np.log(x) / 0.01))
    amount, paid = ("amount", event.amount_per_share), _payment(event)
    return [amount, (paid, step)], [amount, *((paid, step + i) for i in range(-2, 3))]


def collapse_precision_duplicates(events: DataFrame) -> DataFrame:
    """Merge near-equal events of a symbol, year and currency one by one. The dated row takes the place of an undated one, else the row with a document that of one without.

    What stays depends on the order, so it is a fold over rows that Spark has sorted. A row is compared only with those
    kept of its amount, or of its payment date and about its amount, as others can't be like it.
    """
    schema = events.schema
    group = ["symbol", "fiscal_year", "currency"]
    plain = lambda x: None if pd.isna(x) else x
    ship(events.sparkSession)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept, places = None, [], defaultdict(list)
        for rows in frames:
            done = []
            for row in rows.itertuples(index=False):
                own = tuple(plain(getattr(row, c)) for c in group)
                if own != current:
                    done += kept
                    current, kept, places = own, [], defaultdict(list)
                under, near = _near(row)
                at, one_dated = len(kept), False
                for i in sorted({i for m in near for i in places[m]}):
                    alike, one_dated = _alike(row, kept[i])
                    if alike:
                        at = i
                        break
                if at == len(kept):
                    kept.append(row)
                elif (_payment(row) is not None and _payment(kept[at]) is None) or (not one_dated and row.source_document_id):
                    kept[at] = row
                else:
                    continue
                for m in under:
                    places[m].append(at)
            if done:
                yield pd.DataFrame(done, columns=schema.names)
        if kept:
            yield pd.DataFrame(kept, columns=schema.names)

    return events.repartition(*group).sortWithinPartitions(*group, "announcement_date", "dividend_id").mapInPandas(merge, schema)


def payment_year(rows: DataFrame) -> Column:
    dates = [c for c in ("payment_date", "expected_payment_date") if c in rows.columns]
    return F.year(F.coalesce(*dates)).cast("int")


def dividend_summary(events: DataFrame) -> DataFrame:
    """For each symbol and year of payment: totals of active events, and the confirmed ones of the year before.

    events are resolved and collapsed ones. The total adds all currencies, as they come; dividend_by_currency() keeps them apart. Events
    without a payment date, whatever their status, are counted with their fiscal year as incomplete and aren't in any total; a year may have nothing else.
    """
    confirmed = F.col("confirmation_status") == "confirmed"
    dated = events.withColumn("year", payment_year(events))
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    totals = dated.where("year IS NOT NULL AND event_status = 'active'").groupBy("symbol", "year").agg(
        F.count("*").alias("events"),
        F.sum("amount_per_share").cast("decimal(28,6)").alias("total"),
        F.sum(F.when(confirmed, F.col("amount_per_share"))).cast("decimal(28,6)").alias("confirmed_total"),
        F.bool_and(confirmed).alias("fully_confirmed"),
        names("currency").alias("currencies"),
        names(F.when(confirmed, F.col("currency"))).alias("confirmed_currencies"),
    )
    open_ = dated.where("year IS NULL").groupBy("symbol", F.col("fiscal_year").cast("int").alias("year")).agg(F.count("*").alias("incomplete"))
    only = F.when((F.col("confirmed_currencies") != "") & ~F.col("confirmed_currencies").contains(","), F.col("confirmed_currencies"))
    before = totals.select("symbol", (F.col("year") + 1).alias("year"), F.col("confirmed_total").alias("prior_confirmed_total"), only.alias("prior_currency"))
    out = totals.join(open_, ["symbol", "year"], "full_outer").join(before, ["symbol", "year"], "left")
    none = F.lit(0).cast("decimal(28,6)")
    filled = {c: F.coalesce(c, none) for c in ("total", "confirmed_total", "prior_confirmed_total")} | {c: F.coalesce(c, F.lit("")) for c in ("currencies", "confirmed_currencies")}
    filled |= {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("events", "incomplete")} | {"fully_confirmed": F.coalesce("fully_confirmed", F.lit(False))}
    return out.withColumns(filled)


def dividend_by_currency(events: DataFrame) -> DataFrame:
    """Active events of each symbol, payment year and currency: their number and total. events are resolved and collapsed ones."""
    active = events.where("event_status = 'active'")
    dated = active.withColumn("year", payment_year(active)).where("year IS NOT NULL")
    return dated.groupBy("symbol", "year", "currency").agg(F.count("*").alias("events"), F.sum("amount_per_share").cast("decimal(28,6)").alias("total"))


def announcements(rows: DataFrame, first: int, last: int) -> DataFrame:
    return rows.where(F.col("fiscal_year").between(first, last)).orderBy("fiscal_year", "announcement_date", "dividend_id")


def compact_date(text: Column) -> Column:
    """YYYYMMDD as a date; anything else is null."""
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def structured_dividends(rows: DataFrame, year: int | None = None) -> DataFrame:
    """Provider rows (text dates, cash_div_tax, cash_div) as events: positive amounts with an announcement date, the fullest row of each amount, currency and payment date.

    Cash before tax counts, and that after tax where it is missing or 0.
    """
    out = rows.withColumn("amount_per_share", F.coalesce(F.nullif("cash_div_tax", F.lit(0)), "cash_div"))
    for target, source in (("announcement_date", "ann_date"), ("record_date", "record_day"), ("ex_date", "ex_day"), ("payment_date", "pay_day")):
        out = out.withColumn(target, compact_date(F.col(source)))
    out = out.where("amount_per_share > 0 AND announcement_date IS NOT NULL AND payment_date IS NOT NULL")
    if year is not None:
        out = out.where(F.year("payment_date") == year)
    filled = sum((F.col(c).isNotNull().cast("int") for c in DATES), F.lit(0))
    keyed = out.withColumn("_filled", filled).withColumn("_order", -F.col("position"))
    return newest(keyed, ("symbol", "amount_per_share", "currency", "payment_date"), ("_filled", "_order")).drop("_filled", "_order")


def fund_dividends(rows: DataFrame) -> DataFrame:
    """Cash of a base number of units, by unit."""
    return rows.withColumn("amount_per_share", F.try_divide(F.col("cash").cast("decimal(28,10)"), F.col("base_units").cast("decimal(18,0)")).cast("decimal(28,10)")).where("amount_per_share > 0")


def discovered_dividends(rows: DataFrame, year: int) -> DataFrame:
    """Rows of a report year with an amount and a notice date of eight digits."""
    return rows.where(F.col("end_date").startswith(str(year)) & F.col("amount_per_share").isNotNull() & F.col("notice_date").rlike("^[0-9]{8}$")).withColumn("announcement_date", compact_date(F.col("notice_date")))


def parse_cash_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with amount and currency from "Cash dividend: 0.5 USD" or "Special Dividend: ..." texts."""
    pattern = r"(?i)(?:cash|special)\s+dividend\s*:?\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Z]{3})"
    out = rows.withColumn("amount_per_share", F.regexp_extract(text, pattern, 1).try_cast("decimal(18,6)")).withColumn("currency", F.upper(F.regexp_extract(text, pattern, 2)))
    first = Window.partitionBy("symbol", "amount_per_share", "currency", "payment_date").orderBy("position")
    return out.where("amount_per_share > 0").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def drop_undocumented(rows: DataFrame, share: float = 0.01) -> DataFrame:
    """rows without those that have no document and lie within a share of one that has, of the same symbol, currency and payment date."""
    has = F.coalesce("source_document_id", F.lit("")) != ""
    documented = rows.where(has).select(F.col("symbol").alias("s"), F.col("currency").alias("c"), F.col("payment_date").alias("d"), F.col("amount_per_share").cast("double").alias("v"))
    loose = rows.where(~has)
    own = F.col("amount_per_share").cast("double")
    near = (F.col("symbol") == F.col("s")) & (F.col("currency") == F.col("c")) & (F.col("payment_date") == F.col("d")) & (F.abs(own - F.col("v")) <= share * F.greatest(F.abs(own), F.abs(F.col("v"))))
    return rows.where(has).unionByName(loose.join(documented, near, "left_anti"))


def fallback_sources(primary: DataFrame, secondary: DataFrame, key: str = "symbol") -> DataFrame:
    """primary, and secondary for symbols that primary knows nothing of."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"))


def batch_status(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requested symbols (rows of position and symbol), each once, at its first mention, with available, refreshing, stale, error or unavailable."""
    each = requests.groupBy("symbol").agg(F.min("position").alias("position"))
    state = F.when(F.col("state").isNull(), "unavailable").when(F.col("state") == "failed", "error").when(F.col("refreshing"), "refreshing").when(F.col("state") == "expired", "stale").otherwise("available")
    return each.join(states, "symbol", "left").select("position", "symbol", state.alias("status"))


def cache_state(rows: DataFrame, now: Column, version: int, data_ttl: int = 21_600, empty_ttl: int = 900, retry: int = 300) -> DataFrame:
    """none for another version; fresh within the life of data, of an empty result, or of a failure; else expired."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("refreshed_at").cast("timestamp"))
    life = F.when(F.col("outcome") == "success_data", F.lit(data_ttl)).when(F.col("outcome") == "success_empty", F.lit(empty_ttl)).when(F.col("outcome") == "failed", F.lit(retry))
    return rows.withColumn("age_seconds", age.cast("long")).withColumn("state", F.when(F.col("version") != version, "none").when(life.isNull(), "none").when(age <= life, "fresh").otherwise("expired"))


def classify_failure(text: Column, data_error: Column | None = None) -> Column:
    """The kind of a failure by its message. Only errors of values, keys and types (data_error, by default all) can be of parsing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parse = low.rlike("parse|format|date|field|payload") & (F.lit(True) if data_error is None else data_error)
    return F.when(low.rlike("timeout|timed out"), "failed_timeout").when(low.rlike("429|rate limit|too many requests"), "failed_rate_limited").when(parse, "failed_parse").otherwise("failed_source")
