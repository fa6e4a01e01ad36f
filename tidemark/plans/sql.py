"""Shared pieces of the queries' SQL: the source views as common table expressions."""

from __future__ import annotations

from tidemark.sources.market import UNITS

TICKS = """ticks AS (
SELECT p_brand AS symbol, l_shipdate AS ts, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_returnflag AS flag,
  CAST(l_quantity AS BIGINT) AS volume,
  CAST(10000 + SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 401 - 200) OVER (o ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(100 AS DOUBLE) AS price,
  row_number() OVER o AS rn
FROM lineitem JOIN part ON l_partkey = p_partkey
WINDOW o AS (PARTITION BY p_brand ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey))"""


def bars(interval: str = "1wk", name: str = "bars") -> str:
    return f"""{name} AS (
SELECT symbol, '{interval}' AS "interval", CAST(date_trunc('{UNITS[interval]}', ts) AS TIMESTAMP) AS ts, arg_min(price, rn) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, rn) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY symbol, date_trunc('{UNITS[interval]}', ts))"""


def brand(k: str) -> str:
    return f"CAST({k} % 25 + 1 AS VARCHAR)"


RULES = f"""rules AS (SELECT c_custkey AS rule_id, c_custkey AS user_id, 'Brand#' || {brand('c_custkey')} AS symbol,
  CASE c_custkey % 3 WHEN 0 THEN '1d' WHEN 1 THEN '1wk' ELSE '1mo' END AS "interval", CASE WHEN c_custkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
  CASE WHEN c_custkey % 5 = 0 THEN 'ELLIOTT' ELSE 'CANDLESTICK' END AS family, c_acctbal > 0 AS active FROM customer)"""
ASSETS = """assets AS (SELECT p_brand AS symbol, company, kind,
  CASE WHEN starts_with(kind, 'ECONOMY') THEN 'ETF' WHEN starts_with(kind, 'PROMO') THEN 'INDEX' ELSE 'EQUITY' END AS instrument_type
  FROM (SELECT p_brand, arg_min(p_name, p_partkey) AS company, arg_min(p_type, p_partkey) AS kind FROM part GROUP BY p_brand))"""
CONGRESS = f"""congress AS (SELECT o_orderkey AS trade_id, c_name AS member, 'Brand#' || {brand('o_orderkey')} AS symbol,
  CASE WHEN o_orderstatus = 'F' THEN 'PURCHASE' ELSE 'SALE' END AS trade_type,
  CASE WHEN o_totalprice <= 15000 THEN '$1,001 - $15,000' WHEN o_totalprice <= 50000 THEN '$15,001 - $50,000' WHEN o_totalprice <= 100000 THEN '$50,001 - $100,000'
    WHEN o_totalprice <= 250000 THEN '$100,001 - $250,000' ELSE '$250,001 - $500,000' END AS amount,
  CAST(o_orderdate AS DATE) AS transaction_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 46 AS INTEGER) AS disclosed
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O'))"""
SUBSCRIPTIONS = f"""subscriptions AS (SELECT c_custkey AS user_id, 'Brand#' || {brand('c_custkey')} AS symbol, c_acctbal > 0 AS active,
  DATE '1996-01-01' + CAST(c_custkey % 900 AS INTEGER) AS activated,
  CASE WHEN c_custkey % 7 <> 0 THEN DATE '1996-01-01' + CAST(c_custkey % 900 AS INTEGER) + 1 END AS baseline FROM customer)"""
FLAGS = """flags AS (SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_shipdate AS ts, min(l_returnflag) AS mark FROM lineitem GROUP BY ALL)"""
INSIDERS = """insiders AS (SELECT t.symbol, s_name AS insider, CASE WHEN mark = 'A' THEN 'P' ELSE 'S' END AS code, CAST(t.ts AS DATE) AS filed,
  CAST(volume AS DECIMAL(24,6)) AS shares, CAST(price AS DECIMAL(24,6)) AS price, concat_ws('-', t.k1, t.k2, t.k3, t.k4, rn) AS trade_id
  FROM ticks t JOIN supplier ON t.k4 = s_suppkey JOIN flags f ON t.k1 = f.k1 AND t.k2 = f.k2 AND t.k3 = f.k3 AND t.k4 = f.k4 AND t.ts = f.ts WHERE mark IN ('A', 'R'))"""


def over(*views: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n" + body
