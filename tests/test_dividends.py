"""Rules of dividends and filings on hand-made rows."""

import datetime as dt
import html
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideframe.operators import dividends, filings

D = dt.date
EVENT = "symbol string, fiscal_year int, currency string, amount_per_share decimal(18,6), payment_date date, expected_payment_date date, source string, source_document_id string, event_status string, confirmation_status string, announcement_date date, dividend_id string"


def events(spark, *rows):
    """Each row: amount, payment date, expected date, source, document, and changes of other columns."""
    out = []
    for i, (amount, paid, expected, source, document, *more) in enumerate(rows):
        row = dict(symbol="TIDE.X", fiscal_year=2031, currency="EUR", amount_per_share=Decimal(amount), payment_date=paid, expected_payment_date=expected, source=source, source_document_id=document, event_status="active", confirmation_status="confirmed", announcement_date=D(2031, 1, 1 + i % 28), dividend_id=f"e{i}")
        out.append(tuple((row | (more[0] if more else {})).values()))
    return spark.createDataFrame(out, EVENT)


def kept(frame):
    return sorted(r.dividend_id for r in dividends.collapse_precision_duplicates(frame).collect())


PAID = D(2031, 6, 3)


@pytest.mark.parametrize(
    ("rows", "left"),
    [
        ([("0.731", PAID, None, "wire", "n1"), ("0.7312", PAID, None, "list", "")], ["e0"]),  # precision, one document
        ([("0.7312", PAID, None, "list", ""), ("0.731", PAID, None, "wire", "n1")], ["e1"]),  # the documented one stays
        ([("4.4", None, None, "wire", "n1"), ("4.4", PAID, None, "wire", "n2")], ["e1"]),  # two documents of a source, one undated
        ([("4.4", None, None, "wire", "n1"), ("4.4", None, PAID, "wire", "n2")], ["e1"]),  # expected dates are dates
        ([("4.4", None, None, "wire", "n1"), ("4.4", PAID, None, "list", "n2")], ["e0", "e1"]),  # documents of two sources
        ([("4.4", None, None, "wire", "n1"), ("4.41", PAID, None, "wire", "")], ["e0", "e1"]),  # undated and not equal
        ([("2.0", None, None, "wire", "n1"), ("2.01", None, None, "wire", "")], ["e0"]),  # both undated, one documented
        ([("2.0", PAID, None, "wire", "n1"), ("2.005", PAID, None, "wire", "n2")], ["e0", "e1"]),  # both documented
        ([("2.0", PAID, None, "wire", ""), ("2.0", PAID, None, "list", "")], ["e0", "e1"]),  # neither documented
        ([("3.0", PAID, None, "wire", "n1"), ("3.04", PAID, None, "list", "")], ["e0", "e1"]),  # beyond one percent
        ([("0.03", PAID, None, "wire", "n1"), ("0.04", PAID, None, "list", "")], ["e0"]),  # below 1 the bound is 0.01
        ([("3.0", PAID, None, "wire", "n1"), ("3.0", D(2031, 6, 4), None, "list", "")], ["e0", "e1"]),  # other days
        ([("3.0", PAID, None, "wire", "n1"), ("3.0", PAID, None, "list", "", {"currency": "USD"})], ["e0", "e1"]),
        ([("3.0", PAID, None, "wire", "n1"), ("3.0", PAID, None, "list", "", {"fiscal_year": 2030})], ["e0", "e1"]),
    ],
)
def test_collapse_rules(spark, rows, left):
    assert kept(events(spark, *rows)) == left


def test_collapse_matches_a_plain_fold(spark):
    r = random.Random(3)
    rows = [(str(Decimal(r.choice([40, 41, 150, 151, 152, 300])) / 100 + Decimal(r.randrange(5)) / 1000), r.choice([None, PAID, D(2031, 7, 1)]), r.choice([None, PAID]), r.choice(["wire", "list"]), r.choice(["", "n1", "n2"])) for _ in range(120)]
    rows = [(a, p, p or e, s, d, {"announcement_date": D(2031, 1, 1), "dividend_id": f"x{i:03d}"}) for i, (a, p, e, s, d) in enumerate(rows)]
    stay = []
    for amount, paid, expected, source, document, more in rows:
        amount, when = Decimal(amount), paid or expected
        for i, (a, w, s, d, _) in enumerate(stay):
            one = a == amount and (w is None) != (when is None)
            if (w == when or one) and not (d and document and s != source) and (one or bool(d) != bool(document)) and abs(a - amount) <= Decimal("0.01") * max(abs(a), abs(amount), 1):
                if (when and not w) or (not one and document):
                    stay[i] = (amount, when, source, document, more["dividend_id"])
                break
        else:
            stay.append((amount, when, source, document, more["dividend_id"]))
    assert kept(events(spark, *rows)) == sorted(x[4] for x in stay)


def test_summary_by_year_of_payment(spark):
    a = lambda amount, paid, **more: (amount, paid, None, "wire", "n", more)
    rows = events(
        spark,
        a("0.31", D(2029, 5, 2)), a("0.07", D(2029, 8, 2), currency="USD", confirmation_status="unverified"),
        a("0.40", D(2030, 5, 2)), a("0.11", D(2030, 6, 2), confirmation_status="unverified"), a("9.00", D(2030, 6, 5), event_status="cancelled"),
        a("0.50", None, fiscal_year=2030), a("0.60", None, fiscal_year=2030, event_status="cancelled"), a("0.70", None, fiscal_year=2033),
    )
    year = {r.year: r for r in dividends.dividend_summary(rows).collect()}
    assert sorted(year) == [2029, 2030, 2033]
    assert (float(year[2030].total), float(year[2030].confirmed_total), year[2030].events, year[2030].fully_confirmed) == (0.51, 0.40, 2, False)
    assert (year[2030].incomplete, float(year[2030].prior_confirmed_total), year[2030].prior_currency) == (2, 0.31, "EUR")  # the unconfirmed dollars don't count
    assert (year[2029].currencies, year[2029].confirmed_currencies, float(year[2029].prior_confirmed_total), year[2029].prior_currency) == ("EUR,USD", "EUR", 0.0, None)
    assert (year[2033].events, year[2033].incomplete, float(year[2033].total), year[2033].fully_confirmed, year[2033].currencies) == (0, 1, 0.0, False, "")


def test_what_an_announcement_may_claim(spark):
    good = dict(symbol="TIDE.X", fiscal_year=2031, event_status="active", amount_per_share=Decimal("0.2"), source_kind="ir_filing", confirmation_status="confirmed", source_url="https://example.org", source_document_id="n1", announcement_date=D(2031, 1, 1), payment_date=PAID, expected_payment_date=None, currency=" eur ")
    cases = [
        ({}, None), ({"amount_per_share": Decimal(0), "event_status": "cancelled"}, None), ({"amount_per_share": Decimal(0)}, "invalid_amount"), ({"amount_per_share": Decimal("-0.1"), "event_status": "cancelled"}, "invalid_amount"),
        ({"source_kind": "third_party"}, "third_party_confirmed"), ({"source_kind": "third_party", "confirmation_status": "unverified"}, None), ({"source_kind": "blog"}, "invalid_source_kind"), ({"event_status": "revised"}, "invalid_event_status"),
        ({"fiscal_year": 1905}, "invalid_fiscal_year"), ({"fiscal_year": 2101}, "invalid_fiscal_year"), ({"announcement_date": None}, "missing_announcement_date"), ({"source_url": " "}, "missing_evidence"), ({"expected_payment_date": D(2031, 6, 4)}, "payment_date_conflict"),
        ({"currency": "euro"}, "invalid_currency"), ({"symbol": ""}, "missing_symbol"), ({"confirmation_status": "sure"}, "invalid_confirmation_status"),
    ]
    schema = "n int, symbol string, fiscal_year int, event_status string, amount_per_share decimal(18,6), source_kind string, confirmation_status string, source_url string, source_document_id string, announcement_date date, payment_date date, expected_payment_date date, currency string"
    got = dividends.normalize_dividends(spark.createDataFrame([(i, *(good | c).values()) for i, (c, _) in enumerate(cases)], schema)).orderBy("n").collect()
    assert [r.error_code for r in got] == [e for _, e in cases]
    assert (got[0].currency, got[0].expected_payment_date, got[0].source_priority) == ("EUR", PAID, 3)


def test_structured_rows(spark):
    rows = [(1, "0", "0.4", "20310101", None, None, "20310603"), (2, None, "0.4", "20310101", "20310601", None, "20310603"), (3, "0.9", "0.4", None, None, None, "20310603"), (4, "0.8", "0.4", "20310101", None, None, None), (5, "0", "0", "20310101", None, None, "20310603"), (6, "0.7", "0.4", "2031-01-01", None, None, "20310603")]
    frame = spark.createDataFrame([("T", "CNY", *r) for r in rows], "symbol string, currency string, position int, cash_div_tax string, cash_div string, ann_date string, record_day string, ex_day string, pay_day string").withColumns({c: F.col(c).cast("decimal(18,6)") for c in ("cash_div_tax", "cash_div")})
    assert [(r.position, float(r.amount_per_share)) for r in dividends.structured_dividends(frame).collect()] == [(2, 0.4)]


def test_failures(spark):
    texts = ["Timeout after 5 s", "the request TIMED OUT", "code 429", "too many requests", "rate-limit", "invalid date field", "could not decode", "bad payload", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string").select("n", dividends.classify_failure(F.col("t")).alias("f"), dividends.classify_failure(F.col("t"), F.lit(False)).alias("g")).orderBy("n").collect()
    assert [r.f.removeprefix("failed_") for r in got] == ["timeout", "timeout", "rate_limited", "rate_limited", "source", "parse", "source", "parse", "source"]
    assert {r.g for r in got[5:]} == {"failed_source"}


def test_entities_as_the_standard_library_reads_them(spark):
    r = random.Random(1)
    names = ["&" + n for n in r.sample(sorted(html.entities.html5), 300)]
    texts = [
        "a &amp;lt; b &oslash;&times;&dollar;&ensp;&lt x &#150;&#x96;&#0;&#1;&#xD800;&#1114112;&#99999999999999;&#65;&#66 &unknown; & &; &;amp;",
        "&notit; &notin; &amp &copy2020 &ThickSpace;x &#x1F600; &Aacutex &#x; &#; &ampamp;", " ".join(names), "".join(names), "<p\nclass='x'>A<br/>B</p> <>  c  d\x1f", "", None,
    ]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", filings.plain_text(F.col("t")).alias("p")).collect()
    for row in got:
        assert row.p == re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", row.t or ""))).strip()


FILINGS = {
    "good": "<p>The directors declared a quarterly cash&nbsp;dividend of $0.355 per share, payable on March 9, 2031, to holders of record as of February 20, 2031. The ex-dividend date is February 19, 2031.</p>",
    "two": "A regular dividend of $ 1.10 per share and a special dividend of $0.40 per share are payable April 1, 2031.",
    "zero": "A dividend of $0.00 per share and a dividend of $2 per share, payable on April 1, 2031",
    "income": "Net income was $3.10 per share. Earnings of $9.99 per share. Interest is payable on April 1, 2031.",
    "undated": "We pay a dividend of $0.25 per share.",
    "far": "A dividend, " + "as was said before and is said again " * 4 + "of $0.25 per share, payable on April 1, 2031.",
    "other": "The dividend is unchanged. Revenue of $5 per share, payable on April 1, 2031.",
    "month": "A dividend of $0.25 per share, payable on Smarch 1, 2031, and payable on April 1, 2031.",
    "empty": None,
}


def test_filings(spark):
    frame = spark.createDataFrame([(k, "2031-02-01T08:00:00Z", v, "mine") for k, v in FILINGS.items()], "accession string, filed_at string, body string, i string")
    got = {r.source_document_id: r for r in filings.filing_dividends(frame.drop("i")).collect()}
    assert {k: float(r.amount_per_share) for k, r in got.items()} == {"good#0": 0.355, "two#0": 1.1, "two#1": 0.4, "zero#1": 2.0}
    good = got["good#0"]
    assert (good.payment_date, good.expected_payment_date, good.record_date, good.ex_date, good.announcement_date, good.fiscal_year, good.currency) == (D(2031, 3, 9), D(2031, 3, 9), D(2031, 2, 20), D(2031, 2, 19), D(2031, 2, 1), 2031, "USD")


NOTICES = {
    "plain": "浪潮公司2030年年度权益分派实施公告 每10股派发现金红利2.5元（含税） 股权登记日：2031-05-20 除权除息日：2031年5月21日 现金红利发放日：2031/5/21",
    "stock": "2030年度利润分配实施公告。每 10 股送3股派发现金红利 2 元。现金红利发放日 2031年6月3日",
    "share": "2030年中期权益分派实施公告：每股派现金股利0.12元，派发日：2031年9月30日",
    "section": "2030年年度权益分派实施公告。原预案每10股派发现金红利9元。本次实施的权益分派方案：每股现金红利0.3元。现金红利发放日：2031-07-01",
    "fund": "浪潮基金2030年度利润分配公告 每10份基金份额分配红利0.55元 现金红利发放日：2031-01-15",
    "table": "2030年年度权益分派实施公告 每股派发现金红利1元 股权登记日 除权除息日 现金红利发放日 A股 2031/5/20 2031/5/21 2031/5/22",
    "meeting": "2030年年度权益分派预案，提交股东大会：每10股派发现金红利2元，现金红利发放日：2031-05-21",
    "undated": "2030年年度权益分派实施公告 每10股派发现金红利2元",
    "yearless": "年度权益分派实施公告 每10股派发现金红利2元 现金红利发放日：2031-05-21",
    "false": "2030年年度权益分派实施公告 每10股派发现金红利2元 现金红利发放日：2031-13-21",
    "empty": None,
}


def test_chinese_notices(spark):
    frame = spark.createDataFrame([("TIDE.X", k, v) for k, v in NOTICES.items()], "symbol string, name string, text string")
    got = {r["name"]: r for r in filings.cn_announcement_dividends(frame).collect()}
    assert {k: (float(r.amount_per_share), r.payment_date, r.fiscal_year, r.distribution_period) for k, r in got.items()} == {
        "plain": (0.25, D(2031, 5, 21), 2030, "年度"), "stock": (0.2, D(2031, 6, 3), 2030, "年度"), "share": (0.12, D(2031, 9, 30), 2030, "中期"),
        "section": (0.3, D(2031, 7, 1), 2030, "年度"), "fund": (0.055, D(2031, 1, 15), 2030, "年度"), "table": (1.0, D(2031, 5, 22), 2030, "年度"),
    }
    assert (got["plain"].record_date, got["plain"].ex_date, got["stock"].record_date) == (D(2031, 5, 20), D(2031, 5, 21), None)
    assert got["plain"].dividend_id == got["stock"].dividend_id != got["share"].dividend_id


def test_hong_kong_forms(spark):
    form = "Status New announcement Announcement date 3 March 2031 Dividend type Final Dividend nature Ordinary For the financial year end 31 December 2030 Dividend declared RMB 0.6 per 2 share Ex-dividend date 2 June 2031 Book close date 5 June 2031 Payment date 30 June 2031"
    forms = {
        "good": form, "cancelled": form.replace("New announcement", "Cancelled"), "one": form.replace("RMB 0.6 per 2 share", "HKD 0.6 per share"), "half": form.replace("For the financial year end 31 December 2030", "Reporting period end for the dividend declared 30 June 2031"),
        "unpaid": form.replace("Payment date", "Paid"), "unannounced": form.replace("Announcement date", "On"), "yearless": form.replace("For the financial year end", "Until"), "bare": form.replace("Dividend type Final Dividend nature Ordinary", ""), "lines": form.replace(" ", "\n"), "empty": None,
    }
    frame = spark.createDataFrame([("TIDE.X", k, v) for k, v in forms.items()], "symbol string, name string, text string")
    got = {r["name"]: r for r in filings.hk_form_dividends(frame).collect()}
    assert sorted(got) == ["bare", "cancelled", "good", "half", "lines", "one"]
    good = got["good"]
    assert (float(good.amount_per_share), good.currency, good.fiscal_year, good.dividend_type, good.event_status) == (0.3, "CNY", 2030, "final", "active")
    assert (good.announcement_date, good.record_date, good.ex_date, good.payment_date) == (D(2031, 3, 3), D(2031, 6, 5), D(2031, 6, 2), D(2031, 6, 30))
    assert got["cancelled"].event_status == "cancelled" and got["one"].currency == "HKD" and float(got["one"].amount_per_share) == 0.6
    assert got["half"].fiscal_year == 2031 and got["bare"].dividend_type == "unspecified" and got["lines"].dividend_id == good.dividend_id != got["half"].dividend_id


def test_upsert_confirms_and_improves(spark):
    at = lambda d: dt.datetime(2031, 1, d)
    rows = [("a", 1, at(5), "unverified", 2, 1.0), ("a", 2, at(4), "confirmed", 2, 2.0), ("a", 3, at(3), "unverified", 2, 3.0), ("a", 4, at(9), "confirmed", 3, 4.0), ("b", 1, at(1), "confirmed", 9, 1.0), ("b", 2, at(1), "unverified", 1, 2.0)]
    frame = spark.createDataFrame(rows, "dividend_id string, arrival int, observed_at timestamp, confirmation_status string, source_priority int, x double").repartition(3)
    assert {r.dividend_id: r.x for r in dividends.upsert_dividends(frame).collect()} == {"a": 2.0, "b": 2.0}
