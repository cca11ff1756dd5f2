"""Market tables derived from the TPC-H-like test tables; the SQL runs unchanged in Spark and DuckDB.

``{name}`` stands for another view or a base table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _flow(what: str, value: str) -> str:
    size = {"sm": "qty <= 12", "md": "qty > 12 AND qty <= 25", "lg": "qty > 25 AND qty <= 40", "elg": "qty > 40"}
    sides = [("buy", "=", s) for s in size] + [("sell", "<>", s) for s in ("sm", "lg", "elg")]
    parts = [f"sum(CASE WHEN rf {op} 'N' AND {size[s]} THEN {value} END) AS {side}_{s}_{what}" for side, op, s in sides]
    return ",\n  ".join([*parts, f"sum(CASE WHEN rf = 'N' THEN {value} ELSE -({value}) END) AS net_mf_{what}"])


VIEWS = {
    "px": """SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
  CAST(l_shipdate AS DATE) AS ship_date, 100 + l_extendedprice / 2000 AS price, l_quantity AS qty, l_returnflag AS rf
FROM {lineitem}""",
    "bars": """SELECT trade_date, code, median(price) AS open, max(price) AS high, min(price) AS low, avg(price) AS close,
  sum(qty) AS volume, sum(price * qty) / 1000 AS amount FROM {px} GROUP BY trade_date, code""",
    "moneyflow": f"SELECT trade_date, code,\n  {_flow('amount', 'price * qty')},\n  {_flow('vol', 'qty')}\nFROM {{px}} GROUP BY trade_date, code",
    "stock_basic": """SELECT lpad(CAST(s_suppkey AS STRING), 6, '0') AS code, s_name AS name, 'SZ' AS market, r_name AS board,
  n_name AS industry, 'L' AS list_status
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "industry_map": "SELECT code, industry AS industry_code, industry AS industry_name FROM {stock_basic}",
    "sw_daily": """SELECT trade_date, industry_code, industry_code AS industry_name, close, amount,
  (close / lag(close) OVER (PARTITION BY industry_code ORDER BY trade_date) - 1) * 100 AS pct_change
FROM (SELECT b.trade_date, s.industry AS industry_code, avg(b.close) AS close, sum(b.amount) AS amount
  FROM {bars} b JOIN {stock_basic} s ON b.code = s.code GROUP BY b.trade_date, s.industry) d""",
    "index_daily": """SELECT trade_date, '000001.SH' AS index_code, close, (close / lag(close) OVER (PARTITION BY 1 ORDER BY trade_date) - 1) * 100 AS pct_chg
FROM (SELECT trade_date, avg(close) AS close FROM {bars} GROUP BY trade_date) d""",
    "stock_limits": """SELECT trade_date, code, lag(close) OVER (PARTITION BY code ORDER BY trade_date) * 1.1 AS up_limit,
  lag(close) OVER (PARTITION BY code ORDER BY trade_date) * 0.9 AS down_limit FROM {bars}""",
    "limit_list_daily": """SELECT b.trade_date, b.code, CASE WHEN b.close >= l.up_limit THEN 'U' ELSE 'D' END AS limit_type,
  CASE WHEN b.high > l.up_limit AND b.close < b.high THEN 1 ELSE 0 END AS open_times
FROM {bars} b JOIN {stock_limits} l ON b.trade_date = l.trade_date AND b.code = l.code
WHERE b.close >= l.up_limit OR b.close <= l.down_limit""",
    "suspend_daily": "SELECT trade_date, code, 'S' AS suspend_type FROM {bars} WHERE volume < 20",
    "daily_basic": """SELECT trade_date, code, volume / 100 AS turnover_rate, volume / 120 AS turnover_rate_f,
  CASE WHEN volume < 60 THEN NULL ELSE volume / avg(volume) OVER (PARTITION BY code ORDER BY trade_date ROWS 5 PRECEDING) END AS volume_ratio,
  close / 10 AS pe_ttm, close / 100 AS pb, amount * 10 AS total_mv, amount * 8 AS circ_mv FROM {bars}""",
    "actual_trades": """SELECT ship_date AS trade_date, '10:00:00' AS trade_time, code, '' AS name,
  CASE WHEN rf = 'N' THEN 'sell' ELSE 'buy' END AS side, avg(price) AS price, sum(qty) AS volume, sum(price * qty) AS amount
FROM {px} GROUP BY ship_date, code, CASE WHEN rf = 'N' THEN 'sell' ELSE 'buy' END""",
    "bars_b": """SELECT trade_date, code, open, high, low, CASE WHEN month(trade_date) = 6 THEN close * 1.02 ELSE close END AS close, volume, amount
FROM {bars} WHERE code NOT LIKE '%7'""",
    "calendar": "SELECT DISTINCT trade_date AS cal_date, 'SSE' AS exchange, 1 AS is_open FROM {bars}",
}


def view(spark: SparkSession, sf_dir: str, name: str, get: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A base table or one of the derived market tables; *get* gives the tables that it is derived from."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    get = get or (lambda u: view(spark, sf_dir, u))
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{u: get(u) for u in used})


def ctes(sql: str) -> str:
    """The tables that a query names, directly or through others, as common table expressions for DuckDB."""
    names = {**{b: b for b in BASE}, **{v: v for v in VIEWS}}
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        new = {v for v in VIEWS if v not in need and re.search(rf"\b{v}\b", text)}
        need |= new
        todo += [VIEWS[v] for v in new]
    return ",\n".join(f"{k} AS MATERIALIZED ({v.format(**names)})" for k, v in VIEWS.items() if k in need)
