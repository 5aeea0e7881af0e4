"""Dividend facts from filing texts, as column expressions over a table of documents."""

from __future__ import annotations

import json
from html import unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a character reference looks like, and the longest name that may lack its semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
LEGACY = max(len(name) for name in html5 if not name.endswith(";"))
FREQUENT = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "#39;", "#160;", "#34;")


def _named(entity: Column) -> Column:
    """The characters of a reference by name; of one without a semicolon the longest name that it begins with; else the reference itself."""
    name = F.substring(entity, 2, 64)
    table = lambda pairs: F.from_json(F.lit(pairs), "map<string,string>")
    shorter = [F.concat(F.try_element_at(table(_LEGACY), F.substring(entity, 2, n)), F.substring(entity, n + 2, 64)) for n in range(LEGACY, 1, -1)]
    return F.coalesce(F.try_element_at(table(_NAMES), name), *(F.when(F.length(name) > n, x) for n, x in zip(range(LEGACY, 1, -1), shorter, strict=True)), entity)


def _numbered(entity: Column) -> Column:
    """The character of a reference by number, as browsers read it: windows-1252 for 128 to 159, nothing for what is no character."""
    digits = F.regexp_replace(entity, "[&#;]", "")
    low = F.lower(F.substring(digits, 1, 1)) == "x"
    code = F.when(low, F.conv(F.substring(digits, 2, 12), 16, 10)).otherwise(F.substring(digits, 1, 12)).cast("long")
    code = F.when(F.length(digits) > 12, F.lit(0x110000)).otherwise(code)
    special = F.try_element_at(F.from_json(F.lit(_NUMBERS), "map<string,string>"), code.cast("string"))
    none = code.between(1, 8) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code == 0xB) | (code % 0x10000 >= 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(special.isNotNull(), special).when(code.between(0xD800, 0xDFFF) | (code >= 0x110000), F.lit("�")).when(none, F.lit("")).otherwise(plain)


_NAMES = json.dumps(html5)
_LEGACY = json.dumps({k: v for k, v in html5.items() if not k.endswith(";")})
_NUMBERS = json.dumps({str(n): unescape(f"&#{n};") for n in (0, 0xD, *range(0x80, 0xA0))})


def unescaped(text: Column) -> Column:
    """text with its character references resolved, each once: all names and numbers, also those without a semicolon."""

    def one(entity: Column) -> Column:
        out = F.when(F.substring(entity, 2, 1) == "#", _numbered(entity)).otherwise(_named(entity))
        for name in reversed(FREQUENT):
            out = F.when(entity == f"&{name}", F.lit(unescape(f"&{name}"))).otherwise(out)
        return out

    pieces, found = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), 0)
    joined = F.array_join(F.zip_with(pieces, F.transform(found, one), lambda piece, char: F.concat(piece, F.coalesce(char, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def plain_text(html: Column) -> Column:
    """Tags out, character references resolved, white space as single spaces."""
    out = unescaped(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))
    return F.trim(F.regexp_replace(out, "(?U)[\\s\\x1c-\\x1f]+", " "))


def english_date(text: Column) -> Column:
    """"March 5, 2024" as a date; anything else is null."""
    return F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit("MMMM d, yyyy")).cast("date")


def _day(pattern: str, text: Column, read: str) -> Column:
    return F.try_to_timestamp(F.regexp_extract(text, pattern, 1), F.lit(read)).cast("date")


def filing_dividends(filings: DataFrame, body: str = "body") -> DataFrame:
    """One row for each positive "dividend ... $x per share" of a filing that says when it is payable; id is accession#i, i counting the amounts of the text.

    The word dividend stands within 100 characters before the amount, in its sentence. filings: accession, filed_at (ISO text), symbol, source_url or other columns, and body.
    """
    date = r"([A-Za-z]+\s+[0-9]{1,2},\s+[0-9]{4})"
    flat = filings.withColumn("_text", plain_text(F.col(body)))
    day = lambda p: english_date(F.regexp_extract("_text", p, 1))
    dated = flat.withColumns(
        {
            "payment_date": day(rf"(?i)payable\s+(?:on\s+)?{date}"),
            "record_date": day(rf"(?i)(?:holders?|shareholders?)\s+of\s+record\s+(?:as\s+of\s+)?(?:on\s+)?{date}"),
            "ex_date": day(rf"(?i)(?:ex-dividend|ex dividend)\s+date\s+(?:is\s+|of\s+)?{date}"),
        }
    ).where("payment_date IS NOT NULL")
    amounts = F.regexp_extract_all("_text", F.lit(r"(?i)(?:cash\s+dividend|dividend)[^.$]{0,100}\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share"), 1)
    rest = [c for c in filings.columns if c != body]
    each = dated.select(*rest, "payment_date", "record_date", "ex_date", F.posexplode(amounts).alias("i", "_amount"))
    each = each.withColumn("amount_per_share", F.col("_amount").try_cast("decimal(18,6)")).where("amount_per_share > 0")
    fixed = {"currency": "USD", "confirmation_status": "confirmed", "source_type": "regulatory_filing", "source_name": "SEC EDGAR"}
    out = each.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("expected_payment_date", F.col("payment_date"))
    if "filed_at" in rest:
        out = out.withColumns({"fiscal_year": F.substring("filed_at", 1, 4).cast("int"), "announcement_date": F.to_date(F.substring("filed_at", 1, 10))})
    return out.withColumn("source_document_id", F.concat_ws("#", "accession", F.col("i").cast("string"))).drop("_amount", "i")


def cn_announcement_dividends(rows: DataFrame, text: str = "text") -> DataFrame:
    """Cash by share of Chinese implementation notices, with dates, fiscal year, period and event id; a notice that isn't one, or lacks amount, payment date or year, gives no row.

    A notice says that it implements a distribution (or is a fund's notice of one). Where it has a section of the plan that is
    implemented, the amount comes from there: of ten shares, of one share, or of ten fund units. rows: symbol, text, other columns.
    """
    day = r"([0-9]{4}\s*[年/-]\s*[0-9]{1,2}\s*[月/-]\s*[0-9]{1,2})\s*日?"
    flat = rows.withColumn("_t", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "(?U)\\s+", " "))
    t, has = F.col("_t"), lambda w: F.contains("_t", F.lit(w))
    flat = flat.where((has("实施公告") | (has("基金") & has("利润分配公告"))) & (has("权益分派") | has("利润分配")))
    marker = F.locate("本次实施的权益分派方案", t)
    flat = flat.withColumn("_plan", F.when(marker > 0, F.substring(t, marker, F.lit(1200))).otherwise(t))
    pick = lambda p: F.nullif(F.regexp_extract("_plan", p, 1), F.lit("")).try_cast("decimal(28,10)")
    cash = r"派(?:发)?(?:现金)?(?:红利|股利)?\s*([0-9.]+)\s*元"
    ways = [
        (rf"每\s*10\s*股[^。；]{{0,50}}?{cash}", 10),
        (rf"每\s*股[^。；]{{0,40}}?{cash}", 1),
        (r"每\s*股\s*现金(?:红利|股利)\s*([0-9.]+)\s*元", 1),
        (r"每\s*10\s*份(?:基金)?份额[^。；]{0,60}?(?:分配|派发)[^。0-9]{0,20}([0-9.]+)\s*元", 10),
    ]
    amount = F.coalesce(*(pick(p) / n for p, n in ways)).cast("decimal(28,10)")
    read = lambda x: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "[年月/]", "-"), F.lit("yyyy-M-d")).cast("date")
    named = lambda w: read(F.regexp_extract("_t", rf"(?:{w})[：:\s]*{day}", 1))
    table = F.regexp_extract("_t", r"现金红利发放日(.{0,120})", 1)
    listed = F.regexp_extract_all(table, F.lit(r"(20[0-9]{2}\s*[年/-]\s*[0-9]{1,2}\s*[月/-]\s*[0-9]{1,2})"), 1)
    direct = F.regexp_extract("_t", rf"(?:现金红利发放日|红利发放日|派发日|现金红利将于)[：:\s]*{day}", 1)
    paid = F.when(direct != "", read(direct)).otherwise(read(F.try_element_at(listed, F.lit(-1))))
    year = F.nullif(F.regexp_extract("_t", r"(20[0-9]{2})\s*年?(?:年度|中期|半年度|前三季度)(?:权益分派|利润分配)", 1), F.lit("")).cast("int")
    period = F.coalesce(F.nullif(F.regexp_extract("_t", r"20[0-9]{2}\s*年?(年度|中期|半年度|前三季度)", 1), F.lit("")), F.lit("unspecified"))
    out = flat.withColumns({"amount_per_share": amount, "payment_date": paid, "record_date": named("股权登记日|权益登记日"), "ex_date": named("除权除息日|除息日"), "fiscal_year": year, "distribution_period": period})
    out = out.where("amount_per_share IS NOT NULL AND payment_date IS NOT NULL AND fiscal_year IS NOT NULL")
    event = F.sha2(F.concat_ws("|", "symbol", F.col("fiscal_year").cast("string"), "distribution_period"), 256)
    fixed = {"currency": "CNY", "confirmation_status": "confirmed", "source_type": "exchange_announcement"}
    out = out.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"expected_payment_date": F.col("payment_date"), "dividend_id": event})
    return out.drop("_t", "_plan", text)


def hk_form_dividends(rows: DataFrame, text: str = "text") -> DataFrame:
    """Fields of Hong Kong dividend forms; a form without amount, payment date, financial year or announcement date gives no row.

    The amount is by share (of so many shares if the form says so), RMB is CNY, a cancelled form is an event of that status. rows: symbol, text, other columns.
    """
    day = r"([0-9]{1,2}\s+[A-Z][a-z]+\s+20[0-9]{2})"
    flat = rows.withColumn("_t", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "(?U)\\s+", " "))
    declared = r"(?i)Dividend declared\s+(HKD|RMB|CNY|USD)\s*([0-9.]+)\s+per\s+(?:([0-9]+)\s+)?share"
    part = lambda i: F.nullif(F.regexp_extract("_t", declared, i), F.lit(""))
    code, shares = F.upper(part(1)), F.coalesce(part(3).try_cast("int"), F.lit(1))
    amount = F.try_divide(part(2).try_cast("decimal(28,10)"), shares.cast("decimal(18,0)")).cast("decimal(28,10)")
    dated = lambda w: _day(rf"(?:{w})\s+{day}", F.col("_t"), "d MMMM yyyy")
    ends = F.nullif(F.regexp_extract("_t", rf"(?:For the financial year end|Reporting period end for the dividend declared)\s+{day}", 1), F.lit(""))
    kind = F.lower(F.trim(F.regexp_extract("_t", r"Dividend type\s+([A-Za-z ]+?)(?:\s+Dividend nature)", 1)))
    out = flat.withColumns(
        {
            "amount_per_share": amount,
            "currency": F.when(code == "RMB", "CNY").otherwise(code),
            "payment_date": dated("Payment date"),
            "record_date": dated("Record date|Book close date"),
            "ex_date": dated("Ex-dividend date"),
            "announcement_date": dated("Announcement date"),
            "_ends": ends,
            "fiscal_year": F.right(ends, F.lit(4)).try_cast("int"),
            "dividend_type": F.when(kind == "", "unspecified").otherwise(kind),
            "event_status": F.when(F.regexp_extract("_t", r"Status\s+(New announcement|Revised|Cancelled)", 1) == "Cancelled", "cancelled").otherwise("active"),
        }
    ).where("amount_per_share IS NOT NULL AND payment_date IS NOT NULL AND fiscal_year IS NOT NULL AND announcement_date IS NOT NULL")
    event = F.sha2(F.concat_ws("|", "symbol", "_ends", "dividend_type"), 256)
    fixed = {"confirmation_status": "confirmed", "source_type": "exchange_announcement", "source_name": "HKEXnews"}
    out = out.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"expected_payment_date": F.col("payment_date"), "dividend_id": event})
    return out.drop("_t", "_ends", text)
