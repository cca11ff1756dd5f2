"""DuckDB SQL for the registered queries, over the adapter tables as common table expressions."""

from __future__ import annotations

from tapeloom.operators.backtest import DEFAULT_DAYS, HOLDING_DAYS
from tapeloom.operators.candidates import ACTIONS, INVALID, PLAN_PRICES, RECOMMENDATION_WEIGHT, RISK_MULTIPLIER, RISK_TEXT, SETTLEMENT
from tapeloom.operators.factors import FLOW_INPUTS
from tapeloom.operators.research import ADVICE_POINTS, STATUS_POINTS
from tapeloom.operators.signals import FIRST_BRANCH, RULES
from tapeloom.operators.versions import DEFAULTS, PARAMS


def flag_list(*pairs: tuple[str, str], base: str = "[]") -> str:
    """Comma list of the names whose condition holds, behind *base*, each once."""
    items = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in pairs)
    items = f"list_filter(list_concat({base}, [{items}]), lambda x: x IS NOT NULL)"
    return f"list_reduce(list_prepend('', {items}), lambda a, b: CASE WHEN contains(',' || a || ',', ',' || b || ',') THEN a WHEN a = '' THEN b ELSE a || ',' || b END)"


def case(key: str, table: dict, default: str) -> str:
    text = " ".join(f"WHEN {key} = '{k}' THEN {v!r}" for k, v in table.items())
    return f"CASE {text} ELSE {default} END"


def clip(x: str, low: float | None = None, high: float | None = None) -> str:
    """Bounded value; null stays null."""
    x = f"({x})" if low is None else f"(CASE WHEN ({x}) < {low} THEN {low} ELSE ({x}) END)"
    return x if high is None else f"(CASE WHEN {x} > {high} THEN {high} ELSE {x} END)"


def z(x: str) -> str:
    return f"coalesce({x}, 0.0)"


def points(*pairs: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {cond} THEN {p:.1f} ELSE 0.0 END" for cond, p in pairs)


FACTORS = """SELECT trade_date, code, close, close / nullif(lag(close, 1) OVER w, 0) - 1 AS pct_chg_1d, close / nullif(lag(close, 3) OVER w, 0) - 1 AS pct_chg_3d,
  close / nullif(lag(close, 5) OVER w, 0) - 1 AS pct_chg_5d, close / nullif(lag(close, 10) OVER w, 0) - 1 AS pct_chg_10d,
  avg(close) OVER w5 AS ma5, avg(close) OVER w10 AS ma10, avg(close) OVER w20 AS ma20, avg(volume) OVER w5 AS volume_ma5,
  CASE WHEN avg(volume) OVER w5 = 0 THEN 0 ELSE volume / avg(volume) OVER w5 END AS volume_ratio_5, avg(amount) OVER w5 AS amount_ma5,
  max(high) OVER w20 AS high_20, min(low) OVER w20 AS low_20,
  CASE WHEN max(high) OVER w20 = min(low) OVER w20 THEN 0 ELSE (close - min(low) OVER w20) / (max(high) OVER w20 - min(low) OVER w20) END AS close_position_20,
  coalesce(close > avg(close) OVER w5, false) AS above_ma5, coalesce(close > avg(close) OVER w10, false) AS above_ma10, coalesce(close > avg(close) OVER w20, false) AS above_ma20
FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date), w5 AS (PARTITION BY code ORDER BY trade_date ROWS 4 PRECEDING),
  w10 AS (PARTITION BY code ORDER BY trade_date ROWS 9 PRECEDING), w20 AS (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING)"""

_BIG = f"({z('buy_lg_amount')} - {z('sell_lg_amount')})"
_MAIN = f"({_BIG} + {z('buy_elg_amount')} - {z('sell_elg_amount')})"
_BOUGHT = f"greatest({z('buy_sm_amount')} + {z('buy_md_amount')} + {z('buy_lg_amount')} + {z('buy_elg_amount')}, 1.0)"
FLOW = f"""SELECT *, {flag_list(("main_net_amount < 0", "main_outflow"), ("main_net_amount_ratio < -0.10", "strong_main_outflow"), ("moneyflow_score < 0", "weak_moneyflow"), ("main_net_amount_ratio > 0.10", "strong_main_inflow"), ("_missing", "missing_moneyflow"))} AS moneyflow_risk_flags
FROM (SELECT *, {points(("main_net_amount > 0", 10), ("main_net_amount_ratio > 0.05", 10), ("main_net_amount_ratio > 0.10", 10), ("big_net_amount > 0", 5), ("net_mf_amount > 0", 5), ("main_net_amount < 0", -10), ("main_net_amount_ratio < -0.05", -10), ("main_net_amount_ratio < -0.10", -10), ("small_net_amount > 0 AND main_net_amount < 0", -5))} AS moneyflow_score
  FROM (SELECT trade_date, code, {z('net_mf_amount')} AS net_mf_amount, {_MAIN} AS main_net_amount, {_MAIN} / {_BOUGHT} AS main_net_amount_ratio, {_BIG} AS big_net_amount,
    {z('buy_sm_amount')} - {z('sell_sm_amount')} AS small_net_amount, {' OR '.join(f'{x} IS NULL' for x in FLOW_INPUTS)} AS _missing FROM moneyflow))"""


def _rank(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY {v} DESC NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {v}) - 1) / 2) / count({v}) OVER (PARTITION BY trade_date) END"


INDUSTRY = f"""SELECT trade_date, industry_code, industry_name, pct_change, industry_return_3d, industry_return_5d, industry_amount_ratio_5, rank_pct_change, rank_return_3d, rank_return_5d,
  industry_strength_score, industry_strength_level, {flag_list(("industry_strength_level = 'weak'", "weak_industry"), ("industry_strength_level = 'strong'", "strong_industry"), ("industry_amount_ratio_5 < 0.8", "shrinking_amount"), ("industry_amount_ratio_5 > 1.2", "high_activity"))} AS industry_risk_flags
FROM (SELECT *, CASE WHEN industry_strength_score >= 60 THEN 'strong' WHEN industry_strength_score >= 30 THEN 'neutral' ELSE 'weak' END AS industry_strength_level
  FROM (SELECT *, {points(("pct_change > 0", 10), ("industry_return_3d > 0", 10), ("industry_return_5d > 0", 15), ("a5", 10), ("a10", 10), ("industry_amount_ratio_5 > 1.2", 10), ("rank_pct_change <= 0.2", 15), ("rank_return_5d <= 0.2", 15), ("industry_return_5d < -0.03", -15), ("NOT a5 AND NOT a10", -10))} AS industry_strength_score
    FROM (SELECT *, {_rank('pct_change')} AS rank_pct_change, {_rank('industry_return_3d')} AS rank_return_3d, {_rank('industry_return_5d')} AS rank_return_5d
      FROM (SELECT *, close / nullif(lag(close, 3) OVER w, 0) - 1 AS industry_return_3d, close / nullif(lag(close, 5) OVER w, 0) - 1 AS industry_return_5d,
          amount / nullif(avg(amount) OVER w5, 0) AS industry_amount_ratio_5, coalesce(close > avg(close) OVER w5, false) AS a5, coalesce(close > avg(close) OVER w10, false) AS a10
        FROM sw_daily WINDOW w AS (PARTITION BY industry_code ORDER BY trade_date), w5 AS (PARTITION BY industry_code ORDER BY trade_date ROWS 4 PRECEDING), w10 AS (PARTITION BY industry_code ORDER BY trade_date ROWS 9 PRECEDING)))))"""

SENTIMENT = """SELECT trade_date, count_if(limit_type = 'U') AS limit_up_count, count_if(limit_type = 'D') AS limit_down_count, count_if(open_times > 0) AS break_board_count,
  avg(CASE WHEN limit_type = 'U' THEN CAST(open_times AS DOUBLE) END) AS limit_up_open_times_avg, CAST(NULL AS DOUBLE) AS highest_streak FROM limit_list_daily GROUP BY trade_date"""

REGIME = f"""SELECT trade_date, close, pct_chg, index_trend_score, limit_up_count, limit_down_count, break_board_count, limit_up_open_times_avg, highest_streak, sentiment_score,
  total_score, CASE WHEN total_score >= 50 THEN 'strong' WHEN total_score >= 20 THEN 'neutral' ELSE 'weak' END AS market_regime,
  CASE WHEN total_score >= 50 THEN 'low' WHEN total_score >= 20 THEN 'medium' ELSE 'high' END AS risk_level,
  printf('trend=%.2f sentiment=%.2f total=%.2f', index_trend_score, sentiment_score, total_score) AS reason
FROM (SELECT *, index_trend_score + sentiment_score AS total_score FROM (SELECT *, {points(("limit_up_count >= 50", 20), ("limit_up_count >= 80", 20), ("limit_down_count >= 20", -20), ("break_board_count / greatest(limit_up_count, 1) > 0.3", -20), ("break_board_count / greatest(limit_up_count, 1) > 0.5", -20))} AS sentiment_score
  FROM (SELECT i.trade_date, i.close, i.pct_chg, i.index_trend_score, coalesce(s.limit_up_count, 0) AS limit_up_count, coalesce(s.limit_down_count, 0) AS limit_down_count, coalesce(s.break_board_count, 0) AS break_board_count, s.limit_up_open_times_avg, s.highest_streak
    FROM (SELECT trade_date, close, pct_chg, {points(("close > m5", 10), ("close > m10", 10), ("close > m20", 20), ("pct_chg > 0", 10), ("pct_chg < -1.5", -20))} AS index_trend_score
      FROM (SELECT *, avg(close) OVER (ORDER BY trade_date ROWS 4 PRECEDING) AS m5, avg(close) OVER (ORDER BY trade_date ROWS 9 PRECEDING) AS m10, avg(close) OVER (ORDER BY trade_date ROWS 19 PRECEDING) AS m20 FROM index_daily)) i
    LEFT JOIN d_sentiment s ON i.trade_date = s.trade_date)))"""

ENRICHED = """SELECT f.*, b.turnover_rate, b.turnover_rate_f, b.volume_ratio AS volume_ratio_daily_basic, b.pe_ttm, b.pb, b.total_mv, b.circ_mv, l.up_limit, l.down_limit,
  m.net_mf_amount, m.main_net_amount, m.main_net_amount_ratio, m.big_net_amount, m.small_net_amount, m.moneyflow_score, coalesce(s.hit, false) AS is_suspended, m.moneyflow_risk_flags,
  i.industry_code, i.industry_name, d.industry_strength_score, d.industry_return_3d, d.industry_return_5d, d.industry_amount_ratio_5, d.industry_strength_level, d.industry_risk_flags,
  coalesce(f.close >= l.up_limit * 0.999, false) AS is_limit_up_close, coalesce(f.close <= l.down_limit * 1.001, false) AS is_limit_down_close,
  CASE WHEN f.close > 0 THEN l.up_limit / f.close - 1 END AS limit_up_distance, CASE WHEN f.close > 0 AND l.down_limit > 0 THEN f.close / l.down_limit - 1 END AS limit_down_distance
FROM d_factors f LEFT JOIN daily_basic b ON f.trade_date = b.trade_date AND f.code = b.code LEFT JOIN stock_limits l ON f.trade_date = l.trade_date AND f.code = l.code
  LEFT JOIN (SELECT trade_date, code, max(suspend_type = 'S') AS hit FROM suspend_daily GROUP BY ALL) s ON f.trade_date = s.trade_date AND f.code = s.code
  LEFT JOIN d_flow m ON f.trade_date = m.trade_date AND f.code = m.code LEFT JOIN industry_map i ON f.code = i.code
  LEFT JOIN d_industry d ON f.trade_date = d.trade_date AND i.industry_code = d.industry_code"""

_RS = "(pct_chg_5d - industry_return_5d)"
_TRADABLE = "amount_ma5 >= {min_amount_ma5} AND close > 0 AND NOT is_suspended AND NOT is_limit_up_close AND NOT is_limit_down_close AND coalesce(pct_chg_1d, 0) < 0.095 AND coalesce(pct_chg_1d, 0) > -0.095 AND coalesce(turnover_rate >= {min_turnover_rate}, true)"
_BOARD = "substr(code, 1, 3) IN ('000', '001', '002', '003', '600', '601', '603', '605')"


def _above(*ns: int) -> str:
    return " AND ".join(f"(above_ma{n} OR {{require_above_ma{n}}} = 0)" for n in ns)


def _on(branch: str, cond: str) -> str:
    return f" AND ({{branch}} <> '{branch}' OR coalesce({cond}, false))"


def _between(x: str, name: str) -> str:
    return f"{x} BETWEEN {{min_{name}}} AND {{max_{name}}}"


#: Rule: predicate, strength, flags.
RULE_SQL = {
    "trend_pullback": (_above(5, 10) + " AND pct_chg_5d > {min_pct_chg_5d} AND pct_chg_1d < {max_pct_chg_1d} AND close_position_20 >= {min_close_position_20} AND volume_ratio_5 >= {min_volume_ratio_5}", f"pct_chg_5d * 100 + close_position_20 * 20 + {clip('volume_ratio_5', high=3)} * 5", [("close_position_20 > 0.9", "near_20d_high"), ("pct_chg_1d > 0.05", "short_term_chase_risk")]),
    "breakout_volume": (_above(5) + " AND pct_chg_5d > {min_pct_chg_5d} AND volume_ratio_5 >= {min_volume_ratio_5} AND close_position_20 >= {min_close_position_20} AND pct_chg_1d < {max_pct_chg_1d}", f"pct_chg_5d * 120 + {clip('volume_ratio_5', high=3)} * 8 + close_position_20 * 20", [("pct_chg_1d > 0.07", "near_limit_chase_risk"), ("close_position_20 > 0.95", "extended_position")]),
    "support_rebound": (_above(20) + f" AND pct_chg_1d > {{min_pct_chg_1d}} AND pct_chg_1d < {{max_pct_chg_1d}} AND {_between('close_position_20', 'close_position_20')} AND amount_ma5 > {{min_amount_ma5}}", f"abs(pct_chg_1d) * 80 + close_position_20 * 10 + {clip('volume_ratio_5', high=2)} * 5", [("pct_chg_3d < -0.06", "short_term_weakness"), ("volume_ratio_5 > 2.5", "panic_volume_possible")]),
    "industry_rotation": (_TRADABLE + " AND (coalesce(industry_strength_score >= {min_industry_strength_score}, false) OR coalesce(industry_strength_level = 'strong', false)) AND industry_return_3d >= {min_industry_return_3d} AND industry_return_5d >= {min_industry_return_5d} AND industry_amount_ratio_5 >= {min_industry_amount_ratio_5} AND pct_chg_5d >= {min_pct_chg_5d} AND close_position_20 >= {min_close_position_20} AND coalesce(moneyflow_score, 0) >= {min_moneyflow_score}" + _on("v2_no_overheat", "pct_chg_3d <= {max_pct_chg_3d} AND pct_chg_5d <= {max_pct_chg_5d} AND close_position_20 <= {max_close_position_20}") + _on("v3_industry_leader", _RS + " >= {min_relative_strength_5d}"), f"{clip(z('industry_strength_score'), high=100)} * 0.45 + {z('industry_return_5d')} * 300 + {z('pct_chg_5d')} * 120 + {clip(z('moneyflow_score'), -10, 30)} * 0.5 + {clip(z(_RS), 0)} * 120", [("close_position_20 > 0.9", "near_20d_high"), ("pct_chg_3d > 0.10", "short_term_overheat"), (z("moneyflow_score") + " < 0", "moneyflow_not_confirmed")]),
    "moneyflow_accumulation": (_TRADABLE + f" AND moneyflow_score >= {{min_moneyflow_score}} AND pct_chg_1d <= {{max_pct_chg_1d}} AND pct_chg_3d <= {{max_pct_chg_3d}} AND {_between('pct_chg_5d', 'pct_chg_5d')}" + _on("v1_main_inflow", "main_net_amount > 0 AND main_net_amount_ratio >= {min_main_net_amount_ratio}") + _on("v2_big_order_confirm", "big_net_amount > 0 AND net_mf_amount > 0 AND main_net_amount >= 0") + _on("v3_price_not_chased", "main_net_amount_ratio >= {min_main_net_amount_ratio} AND coalesce(turnover_rate <= {max_turnover_rate}, true) AND pct_chg_1d >= {min_pct_chg_1d}"), f"{clip(z('moneyflow_score'), high=40)} * 1.2 + {clip(z('main_net_amount_ratio'), 0, 12)} * 2 + CASE WHEN {z('big_net_amount')} > 0 THEN 6 ELSE 0 END - {clip(z('pct_chg_5d'), 0)} * 80", [("pct_chg_5d > 0.08", "price_chase_risk"), (z("turnover_rate") + " > {max_turnover_rate}", "high_turnover"), (z("main_net_amount_ratio") + " < 0", "main_outflow")]),
    "low_vol_trend": (_TRADABLE + f" AND {_above(5, 10, 20)} AND {_between('pct_chg_5d', 'pct_chg_5d')} AND abs(pct_chg_3d) <= {{max_abs_pct_chg_3d}} AND abs(pct_chg_1d) <= {{max_abs_pct_chg_1d}} AND {_between('close_position_20', 'close_position_20')} AND {_between('volume_ratio_5', 'volume_ratio_5')}" + _on("v2_low_chase", "pct_chg_1d <= {max_pct_chg_1d}") + _on("v3_steady_volume", "(turnover_rate IS NULL OR turnover_rate BETWEEN {min_turnover_rate} AND {max_turnover_rate})"), f"{z('pct_chg_5d')} * 100 + {z('close_position_20')} * 18 + {clip('2 - abs(coalesce(volume_ratio_5, 1.0) - 1)', 0)} * 6 + (CAST(above_ma5 AS INT) + CAST(above_ma10 AS INT) + CAST(above_ma20 AS INT)) * 3", [("close_position_20 > 0.85", "near_20d_high"), ("volume_ratio_5 > 1.8", "volume_expansion")]),
    "oversold_rebound": (_TRADABLE + " AND NOT ((coalesce(pct_chg_3d, 0) <= {max_down_pct_chg_3d} AND coalesce(pct_chg_5d, 0) <= {max_down_pct_chg_5d}) OR coalesce(pct_chg_10d, 0) <= {max_down_pct_chg_10d})" + f" AND {_between('pct_chg_3d', 'pct_chg_3d')} AND pct_chg_5d >= {{min_pct_chg_5d}} AND pct_chg_10d >= {{min_pct_chg_10d}} AND {_between('close_position_20', 'close_position_20')}" + _on("v2_moneyflow_repair", "moneyflow_score >= {min_moneyflow_score}") + _on("v3_industry_repair", "industry_strength_score >= {min_industry_strength_score}"), f"abs(pct_chg_3d) * 120 + {clip('1 - ' + z('close_position_20'), 0)} * 12 + {clip(z('moneyflow_score'), -10, 25)} * 0.7 + {clip(z('industry_strength_score'), high=100)} * 0.2", [("pct_chg_5d < -0.12", "short_term_weakness"), ("pct_chg_10d < -0.20", "medium_term_weakness"), (z("moneyflow_score") + " < 0", "moneyflow_not_confirmed")]),
    "volume_dryup_breakout": (_TRADABLE + f" AND {_above(5, 10)} AND {_between('volume_ratio_5', 'volume_ratio_5')} AND {_between('coalesce(volume_ratio_daily_basic, volume_ratio_5)', 'volume_ratio_daily_basic')} AND {_between('pct_chg_1d', 'pct_chg_1d')} AND pct_chg_3d <= {{max_pct_chg_3d}} AND close_position_20 >= {{min_close_position_20}}" + _on("v2_breakout_confirm", "close_position_20 >= {confirm_min_close_position_20}"), f"{z('pct_chg_1d')} * 150 + {z('close_position_20')} * 20 + {clip(z('volume_ratio_5'), high=2.5)} * 8 + (CAST(above_ma5 AS INT) + CAST(above_ma10 AS INT)) * 4", [("pct_chg_1d > 0.06", "short_term_chase_risk"), ("volume_ratio_5 > 2.0", "volume_spike"), ("close_position_20 > 0.92", "near_20d_high")]),
    "relative_strength_pullback": (_TRADABLE + f" AND {_above(10, 20)} AND {_RS} >= {{min_relative_strength_5d}} AND pct_chg_10d >= {{min_pct_chg_10d}} AND {_between('pct_chg_5d', 'pct_chg_5d')} AND {_between('close_position_20', 'close_position_20')}" + _on("v2_industry_strong_pullback", "industry_strength_score >= {min_industry_strength_score}") + _on("v3_moneyflow_confirm", "moneyflow_score >= {min_moneyflow_score}"), f"{clip(z(_RS), 0)} * 180 + {clip(z('pct_chg_10d'), 0)} * 90 + {clip(z('industry_strength_score'), high=100)} * 0.25 + {clip(z('moneyflow_score'), -10, 30)} * 0.4", [("close_position_20 > 0.85", "near_20d_high"), (z("moneyflow_score") + " < 0", "moneyflow_not_confirmed")]),
}


def rule_sql(name: str, values: dict, source: str = "d_enriched", version: str = "'v1'") -> str:
    """Signals of one rule; *values* fills parameters with numbers or with columns of a version table."""
    keep, strength, marks = RULE_SQL[name]
    fill = lambda t: t.format(**values)
    board = f" AND {_BOARD}" if RULES[name][2] else ""
    marks = flag_list(*[(fill(cond), flag) for cond, flag in marks])
    return f"SELECT trade_date, code, '{name}' AS strategy_name, {version} AS strategy_version, {strength} AS signal_strength, '{RULES[name][3]}' AS entry_reason, {marks} AS risk_flags FROM {source} WHERE {fill(keep)}{board}"


#: The adapter's amounts are small, and a flow ratio is at most 1.
OVERRIDES = {"min_amount_ma5": 0.0, "min_main_net_amount_ratio": 0.05}


def default_rule_sql(name: str) -> str:
    values = {k: float(v) for k, v in (DEFAULTS[name] | OVERRIDES).items()} | {"branch": f"'{FIRST_BRANCH.get(name, '')}'"}
    return rule_sql(name, values)


def versions_cte(rows: list[dict]) -> str:
    columns = ["strategy_name", "strategy_version", "branch", *[f"p_{p}" for p in PARAMS]]
    one = lambda r: "(" + ", ".join([*(f"'{r[k]}'" for k in ("strategy_name", "strategy_version", "branch")), *("NULL" if r[p] is None else f"CAST({r[p]} AS DOUBLE)" for p in PARAMS)]) + ")"
    return f"SELECT * FROM (VALUES {', '.join(map(one, rows))}) AS v({', '.join(columns)})"


def all_versions_sql(table: str) -> str:
    values = {p: f"p_{p}" for p in PARAMS} | {"branch": "branch"}
    return " UNION ALL ".join(rule_sql(n, values, f"d_enriched JOIN {table} ON strategy_name = '{n}'", "strategy_version") for n in RULES)


def backtest_sql(signals: str, bars: str = "bars") -> str:
    cols = ", ".join(f"CASE WHEN b.open <> 0 THEN b.c{k} / b.open - 1 END AS return_{k}d, CASE WHEN b.open <> 0 AND b.c{k} IS NOT NULL THEN b.l{k} / b.open - 1 END AS max_drawdown_{k}d" for k in (1, 3, 5))
    ahead = ", ".join(f"lead(close, {k}) OVER w AS c{k}, min(low) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) AS l{k}" for k in (1, 3, 5))
    return f"""SELECT *, invalid_reason = '' AS is_valid FROM (SELECT s.trade_date AS signal_date, s.code, s.strategy_name, s.strategy_version, s.signal_strength, b.trade_date AS entry_date, b.open AS entry_open, {cols},
  CASE WHEN k.code IS NULL THEN 'no_daily_bars_for_code' WHEN b.code IS NULL THEN 'no_next_trading_day' WHEN coalesce(b.open, 0) = 0 THEN 'invalid_entry_open' WHEN b.c5 IS NULL THEN 'insufficient_future_bars' ELSE '' END AS invalid_reason
FROM ({signals}) s LEFT JOIN (SELECT DISTINCT code FROM {bars}) k ON s.code = k.code
  ASOF LEFT JOIN (SELECT *, {ahead} FROM {bars} WINDOW w AS (PARTITION BY code ORDER BY trade_date)) b ON s.code = b.code AND s.trade_date < b.trade_date)"""


def performance_sql(results: str, keys: str = "strategy_name, strategy_version") -> str:
    cols = ", ".join(f"avg(CASE WHEN is_valid AND return_{k}d IS NOT NULL THEN CAST(return_{k}d > 0 AS DOUBLE) END) AS win_rate_{k}d, avg(CASE WHEN is_valid THEN return_{k}d END) AS avg_return_{k}d, median(CASE WHEN is_valid THEN return_{k}d END) AS median_return_{k}d, avg(CASE WHEN is_valid THEN max_drawdown_{k}d END) AS avg_max_drawdown_{k}d" for k in (1, 3, 5))
    return f"SELECT {keys}, count(*) AS sample_count, count_if(is_valid) AS valid_count, {cols} FROM ({results}) GROUP BY {keys}"


def evaluation_sql(perf: str) -> str:
    n, w, r, d = z("valid_count"), z("win_rate_3d"), z("avg_return_3d"), z("avg_max_drawdown_3d")
    steps = [(f"{n} < 30", "insufficient_samples", "unknown", "continue_backtest"), (f"{r} < 0 AND {w} < 0.5", "weak", "medium", "pause"), (f"{d} < -0.08", "high_drawdown", "high", "reduce_or_pause"), (f"{w} >= 0.5 AND {r} >= 0", "qualified", "low", "enable_observation")]
    pick = lambda i, last: "CASE " + " ".join(f"WHEN {s[0]} THEN '{s[i]}'" for s in steps) + f" ELSE '{last}' END"
    return f"SELECT strategy_name, strategy_version, sample_count, valid_count, win_rate_3d, avg_return_3d, median_return_3d, avg_max_drawdown_3d, round({w} * 40 + {r} * 100 + {z('median_return_3d')} * 50 + {d} * 50 + least({n}, 200) / 200 * 10, 4) AS evaluation_score, {pick(1, 'neutral')} AS evaluation_status, {pick(2, 'medium')} AS risk_level, {pick(3, 'observe')} AS recommendation FROM ({perf})"


def walk_forward_sql(signals: str, split: str, versions: str) -> str:
    def side(p: str, op: str) -> str:
        perf = performance_sql(backtest_sql(f"SELECT * FROM ({signals}) WHERE trade_date {op} DATE '{split}'", f"(SELECT * FROM bars WHERE trade_date {op} DATE '{split}')"))
        return f"(SELECT strategy_name, strategy_version, valid_count AS {p}_valid_count, win_rate_3d AS {p}_win_rate_3d, avg_return_3d AS {p}_avg_return_3d, avg_max_drawdown_3d AS {p}_avg_drawdown_3d FROM ({perf}))"

    names = [f"{p}_{m}" for p in ("train", "validation") for m in ("win_rate_3d", "avg_return_3d", "avg_drawdown_3d")]
    base = f"SELECT v.strategy_name, v.strategy_version, coalesce(train_valid_count, 0) AS train_valid_count, coalesce(validation_valid_count, 0) AS validation_valid_count, {', '.join(f'{z(n)} AS {n}' for n in names)} FROM {versions} v LEFT JOIN {side('train', '<')} USING (strategy_name, strategy_version) LEFT JOIN {side('validation', '>=')} USING (strategy_name, strategy_version)"
    steps = [("train_valid_count < 30", "unknown", "insufficient_train_samples"), ("validation_valid_count < 10", "unknown", "insufficient_validation_samples"), ("train_avg_return_3d > 0 AND validation_avg_return_3d < 0", "high", "failed_oos"), ("return_decay < -0.03 OR win_rate_decay < -0.15", "medium", "unstable"), ("validation_avg_return_3d >= 0 AND validation_win_rate_3d >= 0.5", "low", "passed_oos")]
    pick = lambda i, last: "CASE " + " ".join(f"WHEN {s[0]} THEN '{s[i]}'" for s in steps) + f" ELSE '{last}' END"
    return f"SELECT *, round(validation_win_rate_3d * 40 + validation_avg_return_3d * 100 + validation_avg_drawdown_3d * 50 + least(validation_valid_count, 100) / 100 * 10 - abs(return_decay) * 30 - abs(win_rate_decay) * 10, 4) AS stability_score, {pick(1, 'medium')} AS overfit_risk, {pick(2, 'needs_more_observation')} AS validation_status FROM (SELECT *, validation_avg_return_3d - train_avg_return_3d AS return_decay, validation_win_rate_3d - train_win_rate_3d AS win_rate_decay, validation_avg_drawdown_3d - train_avg_drawdown_3d AS drawdown_worsening FROM ({base}))"


def _missing(*xs: str) -> str:
    return "(" + " OR ".join(f"{x} IS NULL" for x in xs) + ")"


_EXT = [(_missing("volume_ratio_daily_basic", "total_mv", "circ_mv"), "missing_daily_basic"), (_missing("total_mv", "circ_mv"), "missing_market_value"), ("volume_ratio_daily_basic IS NULL", "missing_volume_ratio_daily_basic"), ("turnover_rate IS NULL", "missing_turnover_rate"), (_missing("up_limit", "down_limit"), "missing_limit_data"), ("is_suspended", "suspended"), ("is_limit_up_close", "limit_up_close"), ("is_limit_down_close", "limit_down_close")]
_LEVEL = "lower(coalesce(industry_strength_level, ''))"


def _has(column: str, flag: str) -> str:
    return f"contains(',' || coalesce({column}, '') || ',', ',{flag},')"


_ADJUST = [("coalesce(risk_level_m = 'high', false)", "market_high_risk"), ("moneyflow_score IS NULL", "missing_moneyflow"), ("moneyflow_score > 20", "strong_main_inflow"), *[(_has("moneyflow_risk_flags", f), f) for f in ("main_outflow", "strong_main_outflow", "strong_main_inflow", "missing_moneyflow")], (f"industry_strength_score IS NULL AND {_LEVEL} = ''", "missing_industry_strength"), (f"{_LEVEL} = 'strong'", "strong_industry"), (f"{_LEVEL} = 'weak'", "weak_industry"), *[(_has("industry_risk_flags", f), f) for f in ("strong_industry", "weak_industry", "shrinking_amount", "high_activity")]]
_ADD = f"CASE WHEN risk_level_m = 'high' THEN -5.0 WHEN market_regime = 'strong' THEN 3.0 ELSE 0.0 END + {clip(z('moneyflow_score'), -20, 30)} + CASE WHEN {_LEVEL} = 'strong' THEN 5.0 WHEN {_LEVEL} = 'weak' THEN -5.0 ELSE 0.0 END"


def pool_sql(source: str, score: str, base_flags: str = "[]") -> str:
    """Rows with regime, flags, adjusted score and rank, the first 20 per date."""
    inner = f"SELECT p.*, r.market_regime, r.risk_level AS risk_level_m FROM ({source}) p LEFT JOIN d_regime r ON p.trade_date = r.trade_date"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY round(score, 9) DESC, code) AS rank FROM (SELECT *, {score} + {_ADD} AS score, {flag_list(*_EXT, *_ADJUST, base=base_flags)} AS all_flags FROM ({inner}) WHERE NOT is_suspended AND NOT is_limit_down_close)) WHERE rank <= 20"


CANDIDATES = pool_sql("SELECT e.*, s.name, s.market, s.board FROM d_enriched e LEFT JOIN stock_basic s ON e.code = s.code WHERE e.close > 0 AND amount_ma5 >= 0 AND pct_chg_1d < 0.095 AND pct_chg_1d > -0.095 AND close_position_20 IS NOT NULL AND (above_ma5 OR above_ma10)", f"{z('pct_chg_5d')} * 100 + {z('pct_chg_10d')} * 50 + {z('close_position_20')} * 20 + {clip(z('volume_ratio_5'), high=3)} * 5 + (CAST(above_ma5 AS INT) + CAST(above_ma10 AS INT) + CAST(above_ma20 AS INT)) * 5.0")

_W = f"{case('trim(recommendation)', RECOMMENDATION_WEIGHT, '0.8')} * {case('trim(risk_level)', RISK_MULTIPLIER, '0.8')}"


def _joined(value: str) -> str:
    """Distinct members of the list l_<value> in order, comma-joined."""
    return f"list_reduce(list_prepend('', l_{value}), lambda a, b: CASE WHEN contains(',' || a || ',', ',' || b || ',') THEN a WHEN a = '' THEN b ELSE a || ',' || b END)"


WEIGHTED = f"SELECT s.*, e.recommendation, e.risk_level, {_W} AS strategy_weight FROM d_signals s LEFT JOIN d_evaluation e USING (strategy_name, strategy_version)"
_LISTS = {"strategy_name": "strategy_name", "strategy_version": "strategy_version", "recommendation": "recommendation", "entry_reason": "entry_reason"}
AGGREGATED = f"""SELECT trade_date, code, signal_count, active_signal_count, max_signal_strength, total_signal_strength, total_weighted_signal_strength, avg_strategy_weight,
  {_joined('strategy_name')} AS strategy_names, {_joined('strategy_version')} AS strategy_versions, {_joined('recommendation')} AS recommendations, {_joined('entry_reason')} AS reason, {_joined('flags')} AS risk_flags
FROM (SELECT trade_date, code, count(strategy_name) AS signal_count, count_if(strategy_weight > 0) AS active_signal_count, max(signal_strength) AS max_signal_strength, sum(signal_strength) AS total_signal_strength, sum(coalesce(signal_strength, 0) * strategy_weight) AS total_weighted_signal_strength, avg(strategy_weight) AS avg_strategy_weight,
  {', '.join(f"coalesce(list({v} ORDER BY strategy_name, strategy_version, {v}) FILTER (WHERE strategy_weight > 0 AND coalesce({v}, '') <> ''), []) AS l_{k}" for k, v in _LISTS.items())},
  list_filter(flatten(list(string_split(risk_flags, ',') ORDER BY strategy_name, strategy_version, risk_flags)), lambda x: x <> '') AS l_flags
  FROM ({WEIGHTED}) GROUP BY trade_date, code)"""
SIGNAL_POOL = pool_sql("SELECT a.* EXCLUDE (reason), concat_ws('; ', CASE WHEN strategy_names <> '' OR strategy_versions <> '' THEN 'versions: ' || strategy_names || ' / ' || strategy_versions END, CASE WHEN recommendations <> '' THEN 'evaluation: ' || recommendations END, nullif(a.reason, '')) AS reason, e.* EXCLUDE (trade_date, code), s.name, s.market, s.board FROM d_aggregated a LEFT JOIN d_enriched e ON a.trade_date = e.trade_date AND a.code = e.code LEFT JOIN stock_basic s ON a.code = s.code WHERE active_signal_count > 0 AND amount_ma5 >= 0", "coalesce(total_weighted_signal_strength, 0) + active_signal_count * 10", "list_filter(string_split(risk_flags, ','), lambda x: x <> '')")

_KIND = f"CASE WHEN {_has('all_flags', 'suspended')} OR {_has('all_flags', 'limit_down_close')} THEN 'watch_only' WHEN above_ma5 AND above_ma10 AND close_position_20 >= 0.6 THEN 'trend_pullback' WHEN pct_chg_5d > 0.05 AND volume_ratio_5 >= 1.2 AND close_position_20 >= 0.7 THEN 'breakout_watch' WHEN pct_chg_1d < -0.03 AND above_ma20 THEN 'support_watch' ELSE 'watch_only' END"


def _price(name: str, scaled: bool) -> str:
    parts = " ".join(f"WHEN strategy_type = '{k}' THEN {'round(close * ' + repr(v[name]) + ', 2)' if scaled else v[name]}" for k, v in PLAN_PRICES.items())
    return f"CASE {parts}{'' if scaled else ' ELSE 0.0'} END AS {name}"


_RISKS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has('all_flags', f)} THEN '{t}' END" for f, t in RISK_TEXT) + "], lambda x: x IS NOT NULL), '; ')"


def _fixed(x: str, suffix: str = "") -> str:
    return f"CASE WHEN {x} IS NULL THEN 'NA' ELSE printf('%.2f{suffix}', {x}) END"


def plan_sql(pool: str, max_items: int = 5) -> str:
    text = f"coalesce(reason, 'in the candidate pool') || '; score=' || {_fixed('score')} || ', 5d=' || {_fixed('pct_chg_5d * 100', '%%')} || ', volume ratio=' || {_fixed('volume_ratio_5')} || ', position=' || {_fixed('close_position_20')}"
    return f"""SELECT trade_date, code, name, rank, strategy_names, strategy_versions, active_signal_count, round(avg_strategy_weight, 4) AS avg_strategy_weight, recommendations, all_flags AS risk_flags, round(close, 2) AS close, strategy_type,
  {case('strategy_type', ACTIONS, 'NULL')} AS action, {', '.join(_price(n, True) for n in ('entry_low', 'entry_high', 'stop_loss', 'take_profit_1', 'take_profit_2'))}, {_price('position_low', False)}, {_price('position_high', False)},
  {case('strategy_type', INVALID, 'NULL')} AS invalid_condition, '{SETTLEMENT}' AS t_plus_1_risk, concat_ws('. ', {text}, nullif({_RISKS}, '')) AS plan_reason
FROM (SELECT *, {_KIND} AS strategy_type FROM ({pool}) WHERE rank <= {max_items})"""


_GRID = f"list_sort(list_distinct(flatten(list_transform(names, lambda n: {case('n', {k: v for k, v in HOLDING_DAYS.items()}, f'[{DEFAULT_DAYS}]')}))))"
EXPANDED = f"SELECT *, unnest(days) AS max_holding_days FROM (SELECT *, CASE WHEN len({_GRID}) > 0 THEN {_GRID} ELSE [{DEFAULT_DAYS}] END AS days FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(strategy_names, strategy_type), '\\s*[,|;+]\\s*'), lambda x: trim(x)), lambda x: x <> '') AS names FROM d_plans))"

_ENTRY = "CASE WHEN b.open BETWEEN entry_low AND entry_high THEN b.open WHEN b.open < entry_low THEN entry_low ELSE entry_high END"
PLAN_BACKTEST = f"""SELECT t.* EXCLUDE (rn, bopen), CAST(x.n AS INT) AS holding_days, x.exit_date, x.exit_reason, CASE WHEN NOT is_triggered THEN NULL WHEN x.exit_reason = 'stop_loss' THEN stop_loss WHEN x.exit_reason = 'take_profit_2' THEN take_profit_2 WHEN x.exit_reason = 'take_profit_1' THEN take_profit_1 ELSE x.last_close END AS exit_price,
  is_triggered AND x.n IS NOT NULL AS is_valid, (CASE WHEN x.exit_reason = 'stop_loss' THEN stop_loss WHEN x.exit_reason = 'take_profit_2' THEN take_profit_2 WHEN x.exit_reason = 'take_profit_1' THEN take_profit_1 ELSE x.last_close END) / entry_price - 1 AS return_pct, x.low / entry_price - 1 AS max_drawdown, x.high / entry_price - 1 AS max_favorable
FROM d_entries t LEFT JOIN (
  SELECT plan_id, count(*) AS n, max(trade_date) AS exit_date, coalesce(arg_max(hit, rn), 'time_exit') AS exit_reason, arg_max(close, rn) AS last_close, min(low) AS low, max(high) AS high
  FROM (SELECT *, min(CASE WHEN hit IS NOT NULL THEN rn END) OVER (PARTITION BY plan_id) AS first_hit FROM (
    SELECT e.plan_id, w.rn, w.trade_date, w.low, w.high, w.close, CASE WHEN w.low <= e.stop_loss THEN 'stop_loss' WHEN w.high >= e.take_profit_2 THEN 'take_profit_2' WHEN w.high >= e.take_profit_1 THEN 'take_profit_1' END AS hit
    FROM d_entries e JOIN d_numbered w ON e.code = w.code AND w.rn BETWEEN e.rn AND e.rn + e.max_holding_days - 1 WHERE e.is_triggered))
  WHERE first_hit IS NULL OR rn <= first_hit GROUP BY plan_id) x ON t.plan_id = x.plan_id"""
ENTRIES = f"""SELECT p.*, b.trade_date IS NOT NULL AND invalid_reason = '' AS is_triggered, CASE WHEN NOT watch THEN b.trade_date END AS entry_date, CASE WHEN invalid_reason = '' THEN {_ENTRY} END AS entry_price, b.rn, b.open AS bopen, invalid_reason
FROM (SELECT p.plan_id, p.trade_date, p.code, p.action, p.strategy_names, p.strategy_versions, p.strategy_type, p.max_holding_days, p.entry_low, p.entry_high, p.stop_loss, p.take_profit_1, p.take_profit_2, p.action = 'watch' OR p.entry_low IS NULL OR p.entry_high IS NULL AS watch FROM d_expanded p) p
  ASOF LEFT JOIN d_numbered b ON p.code = b.code AND p.trade_date < b.trade_date,
  LATERAL (SELECT CASE WHEN watch THEN 'watch_only_or_no_entry_range' WHEN b.code IS NULL THEN 'no_next_trading_day' WHEN b.low > entry_high THEN 'gap_above_entry_range' WHEN b.high < entry_low THEN 'not_reach_entry_range' ELSE '' END AS invalid_reason)"""


def plan_performance_sql(results: str, keys: str = "strategy_names, strategy_versions, action, max_holding_days") -> str:
    ok = lambda x: f"avg(CASE WHEN is_valid THEN {x} END)"
    rate = lambda *n: ok(f"CAST(exit_reason IN ({', '.join(repr(x) for x in n)}) AS DOUBLE)")
    return f"SELECT {keys}, count(*) AS plan_count, count_if(is_triggered) AS triggered_count, count_if(is_valid) AS valid_count, avg(CAST(is_triggered AS DOUBLE)) AS trigger_rate, {ok('CAST(return_pct > 0 AS DOUBLE)')} AS win_rate, {ok('return_pct')} AS avg_return, median(CASE WHEN is_valid THEN return_pct END) AS median_return, {ok('max_drawdown')} AS avg_max_drawdown, {ok('max_favorable')} AS avg_max_favorable, {rate('stop_loss')} AS stop_loss_rate, {rate('take_profit_1', 'take_profit_2')} AS take_profit_rate, {rate('time_exit')} AS time_exit_rate FROM ({results}) GROUP BY {keys}"


ADVICE, STATUS = {k: float(v) for k, v in ADVICE_POINTS.items()}, {k: float(v) for k, v in STATUS_POINTS.items()}
