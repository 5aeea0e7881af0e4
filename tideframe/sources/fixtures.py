"""Domain tables as views over the benchmark tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "fx_raw_bar": """
SELECT concat('S', lpad(cast(l_suppkey AS string), 4, '0')) AS symbol,
       CASE l_suppkey % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'HK' ELSE 'US' END AS market,
       '1d' AS bar_interval, 'raw' AS adjustment, l_shipdate AS bar_time,
       round(9.5 + l_tax * 1e2, 2) AS open, round(11 + l_tax * 1e2, 2) AS high,
       round(9 + l_tax * 1e2, 2) AS low, round(10 + l_tax * 1e2, 2) AS close,
       round(10 + l_tax * 1e2, 2) AS raw_close, cast(1 AS double) AS adjustment_factor,
       cast(CASE l_linestatus WHEN 'O' THEN 100 ELSE 200 END AS double) AS volume,
       CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE cast(1000 AS double) END AS amount,
       CASE l_returnflag WHEN 'A' THEN 'tushare' WHEN 'R' THEN 'sina' ELSE 'zz_unknown' END AS source,
       cast(l_linenumber AS string) AS source_sequence,
       l_shipdate + l_linenumber * INTERVAL '1' MINUTE AS observed_at,
       l_shipdate + cast(l_orderkey % 3 AS int) * INTERVAL '1' HOUR AS ingested_at,
       concat('A', cast(l_orderkey % 50 AS string)) AS raw_artifact_id,
       md5(concat_ws('|', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string),
           cast(cast(round(l_extendedprice * 1e2) AS bigint) AS string))) AS content_rank
FROM lineitem
""",
    "fx_trade": """
SELECT event_id AS sequence,
       event_id + CASE WHEN event_id % 10 = 0 THEN 500 ELSE 0 END AS arrival_seq,
       concat('I', cast(user_id % 5 AS string), '.XSIM') AS instrument_id, 'sim' AS source,
       CASE event_type WHEN 'click' THEN 'pre_market' WHEN 'error' THEN 'post_market' ELSE 'regular' END AS session,
       ts AS ts_event, round(value, 2) AS price, cast(1 + event_id % 7 AS double) AS size,
       CASE event_id % 3 WHEN 0 THEN 'BUYER' WHEN 1 THEN 'SELLER' ELSE 'NO_AGGRESSOR' END AS aggressor_side
FROM events
""",
    "fx_quote": """
SELECT concat('Q', lpad(cast(user_id AS string), 4, '0')) AS symbol,
       CASE user_id % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'HK' ELSE 'US' END AS market, event_type AS source,
       round(value, 2) AS price, props AS payload_json, ts AS observed_at, ts AS ingested_at,
       lpad(cast(event_id AS string), 12, '0') AS content_rank
FROM events
""",
    "fx_fund_hist": """
SELECT lpad(cast(o_custkey AS string), 6, '0') AS symbol, c_name AS name, c_acctbal > 0 AS is_active,
       concat(cast(year(o_orderdate) AS string),
              CASE quarter(o_orderdate) WHEN 1 THEN '0331' WHEN 2 THEN '0630' WHEN 3 THEN '0930' ELSE '1231' END) AS report_period,
       cast(cast(o_orderdate + INTERVAL '30' DAY AS date) AS string) AS published_at,
       o_orderdate + cast(30 + o_orderkey % 60 AS int) * INTERVAL '1' DAY AS observed_at,
       o_orderdate + cast(31 + o_orderkey % 60 AS int) * INTERVAL '1' DAY AS ingested_at,
       c_mktsegment AS industry,
       cast(round(o_totalprice * 1e2) AS bigint) % 3000 / 1e2 AS roe_weighted,
       cast(round(o_totalprice * 1e2) AS bigint) % 6000 / 1e2 - 5 AS pe_dynamic,
       cast(o_orderkey % 90 AS double) / 1e1 AS pb,
       o_totalprice AS revenue, floor(cast(round(o_totalprice * 1e2) AS bigint) / 1e1) / 1e2 AS net_profit, cast(round(o_totalprice * 1e2) AS bigint) * 3 / 1e2 AS total_assets,
       cast(round(o_totalprice * 1e2) AS bigint) * 2 / 1e2 AS total_liabilities, floor(cast(round(o_totalprice * 1e2) AS bigint) / 8e0) / 1e2 AS operating_cashflow,
       lpad(cast(o_orderkey AS string), 12, '0') AS version_id
FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "fx_tdx_hist": """
SELECT lpad(cast(o_custkey AS string), 6, '0') AS symbol,
       concat(cast(year(o_orderdate) AS string), CASE WHEN o_orderkey % 4 = 0 THEN '0630' ELSE '1231' END) AS report_period,
       cast(cast(o_orderdate + INTERVAL '45' DAY AS date) AS string) AS published_at,
       o_orderdate + cast(45 + o_orderkey % 40 AS int) * INTERVAL '1' DAY AS observed_at,
       o_orderdate + cast(46 + o_orderkey % 40 AS int) * INTERVAL '1' DAY AS ingested_at,
       cast(round(o_totalprice * 1e2) AS bigint) % 3000 / 1e2 AS roe_weighted,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS revenue_ttm, o_totalprice AS revenue,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE floor(cast(round(o_totalprice * 1e2) AS bigint) / 1e1) / 1e2 END AS net_profit_parent,
       floor(cast(round(o_totalprice * 1e2) AS bigint) / 9e0) / 1e2 AS net_profit_parent_ttm, cast(round(o_totalprice * 1e2) AS bigint) * 3 / 1e2 AS total_assets,
       cast(round(o_totalprice * 1e2) AS bigint) * 2 / 1e2 AS total_liabilities, floor(cast(round(o_totalprice * 1e2) AS bigint) / 4e0) / 1e2 AS cash,
       floor(cast(round(o_totalprice * 1e2) AS bigint) / 8e0) / 1e2 AS operating_cashflow, floor(cast(round(o_totalprice * 1e2) AS bigint) / 2e1) / 1e2 AS capex,
       lpad(cast(o_orderkey AS string), 12, '0') AS version_id
FROM orders
""",
    "fx_bao": """
SELECT lpad(cast(o_custkey AS string), 6, '0') AS symbol, concat(cast(year(o_orderdate) AS string), '1231') AS report_period,
       cast(cast(o_orderdate AS date) AS string) AS trade_date,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(round(o_totalprice * 1e2) AS bigint) % 4000 / 1e2 END AS pe_ttm,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE cast(o_orderkey % 70 AS double) / 1e1 END AS pb_mrq,
       cast(round(o_totalprice * 1e2) AS bigint) % 3000 / 1e2 AS roe_avg,
       o_orderdate + INTERVAL '1' DAY AS ingested_at, lpad(cast(o_orderkey AS string), 12, '0') AS version_id
FROM orders WHERE o_orderstatus = 'P'
""",
    "fx_div": """
SELECT lpad(cast(o_orderkey AS string), 12, '0') AS dividend_id, concat('D', lpad(cast(o_custkey % 200 AS string), 4, '0')) AS symbol,
       cast(year(o_orderdate) AS int) AS fiscal_year,
       cast(1 + cast(round(o_totalprice * 1e2) AS bigint) % 5 + (o_orderkey % 3) * 0.004 AS decimal(18, 6)) AS amount_per_share,
       CASE o_custkey % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN 'HKD' ELSE 'USD' END AS currency,
       cast(o_orderdate AS date) AS announcement_date,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(date_trunc('quarter', o_orderdate) + INTERVAL '100' DAY AS date) END AS payment_date,
       CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE cast(date_trunc('quarter', o_orderdate) + INTERVAL '100' DAY AS date) END AS expected_payment_date,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS record_date,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS ex_date,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'confirmed' ELSE 'unverified' END AS confirmation_status,
       CASE WHEN o_orderkey % 13 = 0 THEN 'cancelled' ELSE 'active' END AS event_status,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 ELSE 9 END AS source_priority,
       CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE concat('doc', cast(o_orderkey AS string)) END AS source_document_id
FROM orders
""",
    "fx_instrument": """
SELECT concat('P', cast(p_partkey AS string), CASE p_size % 2 WHEN 0 THEN '.XNAS' ELSE '.XHKG' END) AS instrument_id,
       concat('P', cast(p_partkey AS string)) AS symbol, CASE p_size % 2 WHEN 0 THEN 'XNAS' ELSE 'XHKG' END AS mic,
       CASE p_size % 2 WHEN 0 THEN 'US' ELSE 'HK' END AS market, p_size AS price_precision, p_name AS name
FROM part
""",
    "fx_symbol_map": """
SELECT CASE p_size % 2 WHEN 0 THEN 'provider:longport' ELSE 'broker:longport' END AS namespace,
       concat('L', cast(p_partkey % 150 AS string)) AS external_symbol,
       concat('P', cast(p_partkey AS string), CASE p_size % 2 WHEN 0 THEN '.XNAS' ELSE '.XHKG' END) AS instrument_id
FROM part
""",
    "fx_calendar": """
SELECT lpad(cast(event_id AS string), 12, '0') AS event_id, CASE user_id % 2 WHEN 0 THEN 'US' ELSE 'CN' END AS country,
       cast(cast(ts AS date) AS string) AS event_date, substr(cast(ts AS string), 12, 8) AS event_time,
       event_type AS event_name, CASE event_id % 3 WHEN 0 THEN 'High' ELSE 'Medium' END AS impact, round(value, 2) AS actual,
       CASE event_id % 2 WHEN 0 THEN 'bureau' ELSE 'census' END AS source
FROM events
""",
    "fx_attempt": """
SELECT concat('prov', cast(user_id % 8 AS string)) AS provider, event_id AS attempt_no, ts AS attempted_at,
       event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN props END AS error
FROM events
""",
    "fx_artifact": """
SELECT cast(doc_id AS string) AS artifact_id, lang AS dataset, source, md5(text) AS digest, n_chars AS byte_size,
       concat('{"report_period":"', cast(2000 + doc_id % 20 AS string), '1231"}') AS metadata_json,
       TIMESTAMP '2024-01-01 00:00:00' + cast(doc_id AS int) * INTERVAL '1' MINUTE AS ingested_at
FROM documents
""",
    "fx_filing": """
SELECT cast(page_id AS string) AS accession, url AS source_url, html AS body FROM pages
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of a folder."""
    used = [t for t in TABLES if re.search(rf"(?i)\b(from|join) {t}\b", VIEWS[name])]
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"(?i)\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """sql with the views that it names as common table expressions."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ("," if parts else "") + "\n" + sql[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
