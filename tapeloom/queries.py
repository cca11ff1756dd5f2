"""Registered queries: a function of the market tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tapeloom import oracles as o
from tapeloom.functions import columns as fc
from tapeloom.market import AS_OF, SPLIT, Market, shared
from tapeloom.operators import backtest, candidates, factors, increment, ledger, quality, research, signals, versions
from tapeloom.sources import normalize, store
from tapeloom.sources.adapters import ctes
from tapeloom.sources.keyed import KeyedTable, by_month

c = F.col
FACTOR_D = "close pct_chg_1d pct_chg_3d pct_chg_5d pct_chg_10d ma5 ma10 ma20 volume_ma5 volume_ratio_5 amount_ma5 high_20 low_20 close_position_20"
SIGNAL_D = "signal_strength"
BACKTEST_D = "signal_strength entry_open return_1d return_3d return_5d max_drawdown_1d max_drawdown_3d max_drawdown_5d"
PERF_D = " ".join(f"{m}_{k}d" for k in (1, 3, 5) for m in ("win_rate", "avg_return", "median_return", "avg_max_drawdown"))
EVAL_D = "win_rate_3d avg_return_3d median_return_3d avg_max_drawdown_3d evaluation_score"
PLAN_D = "avg_strategy_weight close entry_low entry_high stop_loss take_profit_1 take_profit_2 position_low position_high"
PLAN_RESULT_D = "entry_low entry_high stop_loss take_profit_1 take_profit_2 entry_price exit_price return_pct max_drawdown max_favorable"
PLAN_PERF_D = "trigger_rate win_rate avg_return median_return avg_max_drawdown avg_max_favorable stop_loss_rate take_profit_rate time_exit_rate"
VALID_D = (
    "train_win_rate_3d train_avg_return_3d train_avg_drawdown_3d validation_win_rate_3d validation_avg_return_3d validation_avg_drawdown_3d "
    "return_decay win_rate_decay drawdown_worsening stability_score"
)
POOL = "trade_date code name rank score risk_flags close pct_chg_5d amount_ma5 moneyflow_score industry_strength_score"
POOL_D = "score close pct_chg_5d amount_ma5 moneyflow_score industry_strength_score"

#: Operator results as common table expressions, in order of use.
DERIVED = {
    "d_factors": o.FACTORS, "d_flow": o.FLOW, "d_industry": o.INDUSTRY, "d_sentiment": o.SENTIMENT, "d_regime": o.REGIME, "d_enriched": o.ENRICHED,
    "d_signals": " UNION ALL ".join(o.default_rule_sql(n) for n in signals.RULES), "d_results": o.backtest_sql("SELECT * FROM d_signals"),
    "d_evaluation": o.evaluation_sql(o.performance_sql("SELECT * FROM d_results")), "v_named": o.versions_cte(versions.named_versions(o.OVERRIDES)), "v_grid": o.versions_cte(versions.grid(overrides=o.OVERRIDES)),
    "d_named_signals": o.all_versions_sql("v_named"), "d_named_evaluation": o.evaluation_sql(o.performance_sql(o.backtest_sql("SELECT * FROM d_named_signals"))),
    "d_searched": o.evaluation_sql(o.performance_sql(o.backtest_sql(o.all_versions_sql("v_grid")))), "d_validation": o.walk_forward_sql("SELECT * FROM d_named_signals", SPLIT, "v_named"),
    "d_pool": o.CANDIDATES, "d_aggregated": o.AGGREGATED, "d_signal_pool": o.SIGNAL_POOL, "d_plans": o.plan_sql("SELECT * FROM d_signal_pool"),
    "d_expanded": f"SELECT *, concat_ws('-', trade_date, code, max_holding_days) AS plan_id FROM ({o.EXPANDED})",
    "d_numbered": "SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS rn FROM bars WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL",
    "d_entries": o.ENTRIES, "d_plan_results": o.PLAN_BACKTEST, "d_plan_performance": o.plan_performance_sql("SELECT * FROM d_plan_results"),
}


@dataclass(frozen=True)
class Query:
    run: Callable[[Market], DataFrame]
    sql: str | None
    doubles: str = ""


QUERIES: dict[str, Query] = {}


def add(name: str, run: Callable[[Market], DataFrame], sql: str | None = None, doubles: str = "") -> None:
    QUERIES[name] = Query(run, sql, doubles)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to *digits* decimals, so that sums taken in another order compare equal; the offset keeps exact halves, which
    prices in cents have many of, away from the edge."""
    return df.select(*[F.round(c(f.name) + 1.2345e-7, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else c(f.name) for f in df.schema])


def _real(df: DataFrame, *names: str) -> DataFrame:
    """Counts that can be null as doubles, the form both engines hand over alike."""
    return df.withColumns({n: c(n).cast("double") for n in names})


def _whole_counts(sql: str) -> str:
    """count_if as BIGINT."""
    out, at = [], 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 1, i + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out.append(f"{sql[at:i]}CAST({sql[i:j]} AS BIGINT)")
        at = j
    return "".join(out) + sql[at:]


def _used(sql: str) -> list[str]:
    """Derived tables a query needs, in order of definition."""
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        new = {k for k in DERIVED if k not in need and re.search(rf"\b{k}\b", text)}
        need |= new
        todo += [DERIVED[k] for k in new]
    return [k for k in DERIVED if k in need]


def oracle(q: Query) -> str:
    derived = [f"{k} AS MATERIALIZED ({_whole_counts(DERIVED[k])})" for k in _used(q.sql)]
    with_ = ",\n".join(filter(None, [ctes(" ".join([q.sql, *derived])), *derived]))
    last = ", ".join(f"round(CAST({d} AS DOUBLE) + 1.2345e-7, 6) + 0.0 AS {d}" for d in q.doubles.split())
    head = f"WITH {with_}\n" if with_ else ""
    return f"{head}SELECT *{f' REPLACE ({last})' if last else ''} FROM ({_whole_counts(q.sql)})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, q=q: rounded(q.run(shared(spark, sf_dir)))) for n, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: oracle(q) for n, q in QUERIES.items() if q.sql}


# Factors and windows
add("w05_daily_factors", lambda m: m.factors, "SELECT * FROM d_factors", FACTOR_D)
_pct = "pct_chg_1d pct_chg_3d pct_chg_5d pct_chg_10d"
add(
    "w01_lag_returns",
    lambda m: factors.lag_returns(m.bars).select("trade_date", "code", *_pct.split()),
    f"SELECT trade_date, code, {_pct.replace(' ', ', ')} FROM d_factors",
    _pct,
)
_ma = "ma5 ma10 ma20 volume_ma5 amount_ma5"
add(
    "w02_rolling_means",
    lambda m: factors.rolling_means(m.bars).select("trade_date", "code", *_ma.split()),
    f"SELECT trade_date, code, {_ma.replace(' ', ', ')} FROM d_factors",
    _ma,
)
add(
    "w03_rolling_extremes",
    lambda m: factors.rolling_extremes(m.bars).select("trade_date", "code", "high_20", "low_20"),
    "SELECT trade_date, code, high_20, low_20 FROM d_factors",
    "high_20 low_20",
)
_rel = "volume_ratio_5 close_position_20"
add(
    "w04_relative_levels",
    lambda m: m.factors.select("trade_date", "code", *_rel.split(), "above_ma5", "above_ma10", "above_ma20"),
    "SELECT trade_date, code, volume_ratio_5, close_position_20, above_ma5, above_ma10, above_ma20 FROM d_factors",
    _rel,
)
add(
    "w06_industry_strength",
    lambda m: m.industry,
    "SELECT * FROM d_industry",
    "pct_change industry_return_3d industry_return_5d industry_amount_ratio_5 rank_pct_change rank_return_3d rank_return_5d industry_strength_score",
)
add(
    "w07_market_regime",
    lambda m: m.regime,
    "SELECT * FROM d_regime",
    "close pct_chg index_trend_score limit_up_open_times_avg highest_streak sentiment_score total_score",
)
add(
    "w08_dedup_keep_last",
    lambda m: factors.dedup_last(m.table("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id"),
    "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL",
)
add(
    "w08_dedup_keep_first",
    lambda m: factors.dedup_last(m.table("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", first=True),
    "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
)
add(
    "w09_rank_candidates",
    lambda m: candidates.rank_candidates(m.signals.groupBy("trade_date", "code").agg(F.max("signal_strength").alias("score")), 20).select("trade_date", "code", "score", "rank"),
    "SELECT * FROM (SELECT trade_date, code, score, row_number() OVER (PARTITION BY trade_date ORDER BY round(score, 9) DESC, code) AS rank FROM "
    "(SELECT trade_date, code, max(signal_strength) AS score FROM d_signals GROUP BY ALL)) WHERE rank <= 20",
    "score",
)
add(
    "w10_top_n_per_strategy",
    lambda m: research.top_n_per_strategy(m.named_evaluation).select("strategy_name", "strategy_version", "evaluation_score", "place"),
    "SELECT * FROM (SELECT strategy_name, strategy_version, evaluation_score, row_number() OVER (PARTITION BY strategy_name ORDER BY evaluation_score "
    "DESC NULLS LAST, strategy_version) AS place FROM d_named_evaluation) WHERE place <= 3",
    "evaluation_score",
)
add(
    "w11_forward_returns",
    lambda m: backtest.forward_returns(m.bars).select("trade_date", "code", *[f"{x}_{k}d" for k in (1, 3, 5) for x in ("exit_close", "low")]),
    "SELECT trade_date, code, " + ", ".join(f"lead(close, {k}) OVER w AS exit_close_{k}d, CASE WHEN lead(1, {k}) OVER w = 1 THEN min(low) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) END AS low_{k}d" for k in (1, 3, 5)) + " FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)",
    " ".join(f"{x}_{k}d" for k in (1, 3, 5) for x in ("exit_close", "low")),
)
add(
    "w12_latest_per_group",
    lambda m: quality.latest_per_group(m.industry, "industry_code").select("industry_code", "trade_date", "industry_strength_score"),
    "SELECT industry_code, max(trade_date) AS trade_date, arg_max(industry_strength_score, trade_date) AS industry_strength_score FROM d_industry "
    "GROUP BY industry_code",
    "industry_strength_score",
)

# Scalars
add(
    "p01_safe_divide",
    lambda m: m.table("orders").select("o_orderkey", fc.safe_divide(c("o_totalprice"), c("o_orderkey") % 3).alias("r")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice / (o_orderkey % 3) END AS r FROM orders",
    "r",
)
add(
    "p02_append_flag",
    lambda m: m.signals.select("trade_date", "code", "strategy_name", fc.append_flags("risk_flags", (c("signal_strength") > 25, "near_20d_high"), (c("signal_strength") > 20, "strong")).alias("f")),
    "SELECT trade_date, code, strategy_name, " + o.flag_list(("signal_strength > 25", "near_20d_high"), ("signal_strength > 20", "strong"), base="list_filter(string_split(risk_flags, ','), lambda x: x <> '')") + " AS f FROM d_signals",
)
add(
    "p03_contains_csv_flag",
    lambda m: m.flow.select("trade_date", "code", fc.contains_flag("moneyflow_risk_flags", "main_outflow").alias("hit")),
    "SELECT trade_date, code, list_contains(string_split(moneyflow_risk_flags, ','), 'main_outflow') AS hit FROM d_flow",
)
add(
    "p04_split_flags",
    lambda m: m.flow.select("trade_date", "code", F.explode(fc.split_flags("moneyflow_risk_flags")).alias("flag")),
    "SELECT trade_date, code, unnest(list_filter(string_split(moneyflow_risk_flags, ','), lambda x: x <> '')) AS flag FROM d_flow",
)
add(
    "p05_to_bool",
    lambda m: m.table("orders").select("o_orderkey", fc.to_bool(F.element_at(F.array(*map(F.lit, ("", "0", "No", "TRUE", "y", "nan", "2.5"))), (c("o_orderkey") % 7 + 1).cast("int"))).alias("b")),
    "SELECT o_orderkey, o_orderkey % 7 IN (3, 4, 6) AS b FROM orders",
)
add(
    "p06_moneyflow_factors",
    lambda m: m.flow,
    "SELECT * EXCLUDE (_missing) FROM d_flow",
    "net_mf_amount main_net_amount main_net_amount_ratio big_net_amount small_net_amount moneyflow_score",
)
_lim = "up_limit down_limit limit_up_distance limit_down_distance"
add(
    "p07_limit_status",
    lambda m: factors.limit_status(m.bars.join(m.table("stock_limits"), ["trade_date", "code"], "left")).select("trade_date", "code", *_lim.split(), "is_limit_up_close", "is_limit_down_close"),
    f"SELECT trade_date, code, {_lim.replace(' ', ', ')}, is_limit_up_close, is_limit_down_close FROM d_enriched",
    _lim,
)
add(
    "p08_score_candidates",
    lambda m: candidates.score_candidates(m.factors).select("trade_date", "code", "score"),
    "SELECT trade_date, code, coalesce(pct_chg_5d, 0) * 100 + coalesce(pct_chg_10d, 0) * 50 + coalesce(close_position_20, 0) * 20 + "
    "least(coalesce(volume_ratio_5, 0), 3) * 5 + (CAST(above_ma5 AS INT) + CAST(above_ma10 AS INT) + CAST(above_ma20 AS INT)) * 5.0 AS score FROM "
    "d_factors",
    "score",
)
_scored = lambda m: candidates.score_candidates(m.enriched).withColumn("risk_flags", F.lit(""))
_score_sql = (
    "coalesce(pct_chg_5d, 0) * 100 + coalesce(pct_chg_10d, 0) * 50 + coalesce(close_position_20, 0) * 20 + least(coalesce(volume_ratio_5, 0), 3) * 5 + "
    "(CAST(above_ma5 AS INT) + CAST(above_ma10 AS INT) + CAST(above_ma20 AS INT)) * 5.0"
)
add(
    "p09_adjust_market_regime",
    lambda m: candidates.adjust_market_regime(_scored(m), m.regime).select("trade_date", "code", "score", "risk_flags"),
    f"SELECT e.trade_date, e.code, {_score_sql} + CASE WHEN r.risk_level = 'high' THEN -5 WHEN r.market_regime = 'strong' THEN 3 ELSE 0 END AS score, CASE WHEN r.risk_level = 'high' THEN 'market_high_risk' ELSE '' END AS risk_flags FROM d_enriched e LEFT JOIN d_regime r ON e.trade_date = r.trade_date".replace("(close", "(e.close"),
    "score",
)
add(
    "p10_adjust_moneyflow",
    lambda m: candidates.adjust_moneyflow(_scored(m)).select("trade_date", "code", "score", "risk_flags"),
    f"SELECT trade_date, code, {_score_sql} + {o.clip(o.z('moneyflow_score'), -20, 30)} AS score, {o.flag_list(*o._ADJUST[1:7])} AS risk_flags FROM "
    f"d_enriched",
    "score",
)
add(
    "p11_adjust_industry",
    lambda m: candidates.adjust_industry(_scored(m)).select("trade_date", "code", "score", "risk_flags"),
    f"SELECT trade_date, code, {_score_sql} + CASE WHEN industry_strength_level = 'strong' THEN 5 WHEN industry_strength_level = 'weak' THEN -5 ELSE 0 "
    f"END AS score, {o.flag_list(*o._ADJUST[7:])} AS risk_flags FROM d_enriched",
    "score",
)
add(
    "p12_strategy_weight",
    lambda m: m.named_evaluation.select("strategy_name", "strategy_version", candidates.strategy_weight(c("recommendation"), c("risk_level")).alias("strategy_weight")),
    f"SELECT strategy_name, strategy_version, {o._W} AS strategy_weight FROM d_named_evaluation",
    "strategy_weight",
)
add("p13_candidate_reason", lambda m: m.signal_pool.select("trade_date", "code", "reason"), "SELECT trade_date, code, reason FROM d_signal_pool")
add(
    "p14_classify_plan",
    lambda m: candidates.classify_plan(m.pool).select("trade_date", "code", "strategy_type", "action"),
    f"SELECT trade_date, code, strategy_type, {o.case('strategy_type', candidates.ACTIONS, 'NULL')} AS action FROM (SELECT *, {o._KIND} AS "
    f"strategy_type FROM d_pool)",
)
add(
    "p15_plan_prices",
    lambda m: m.plans.select("trade_date", "code", "entry_low", "entry_high", "stop_loss", "take_profit_1", "take_profit_2", "position_low", "position_high"),
    "SELECT trade_date, code, entry_low, entry_high, stop_loss, take_profit_1, take_profit_2, position_low, position_high FROM d_plans",
    "entry_low entry_high stop_loss take_profit_1 take_profit_2 position_low position_high",
)
add(
    "p16_plan_text",
    lambda m: m.plans.select("trade_date", "code", "invalid_condition", "t_plus_1_risk", "plan_reason"),
    "SELECT trade_date, code, invalid_condition, t_plus_1_risk, plan_reason FROM d_plans",
)
add("p17_trade_plan", lambda m: m.plans, "SELECT * FROM d_plans", PLAN_D)
_gate = lambda m: m.signals.where("strategy_name = 'trend_pullback'").join(m.regime.select("trade_date", "market_regime", "risk_level"), "trade_date", "left").transform(signals.regime_gating, "breakout")
add(
    "p18_regime_gating",
    lambda m: _gate(m).select("trade_date", "code", "signal_strength", F.coalesce("_gate", F.lit("")).alias("gate")),
    "SELECT s.trade_date, s.code, s.signal_strength * CASE WHEN r.market_regime = 'weak' OR r.risk_level = 'high' THEN 0.75 ELSE 1 END * CASE WHEN "
    "r.market_regime = 'strong' OR r.risk_level = 'low' THEN 1.05 ELSE 1 END AS signal_strength, CASE WHEN r.market_regime = 'weak' OR r.risk_level = "
    "'high' THEN 'weak_market_regime' ELSE '' END AS gate FROM d_signals s LEFT JOIN d_regime r ON s.trade_date = r.trade_date WHERE strategy_name = "
    "'trend_pullback'",
    SIGNAL_D,
)
add(
    "p19_relative_strength",
    lambda m: m.enriched.select("trade_date", "code", (c("pct_chg_5d") - c("industry_return_5d")).alias("rs")),
    "SELECT trade_date, code, pct_chg_5d - industry_return_5d AS rs FROM d_enriched",
    "rs",
)
add(
    "p20_index_trend_score",
    lambda m: m.regime.select("trade_date", "index_trend_score"),
    "SELECT trade_date, index_trend_score FROM d_regime",
    "index_trend_score",
)
add(
    "p21_sentiment_score",
    lambda m: factors.sentiment_score(factors.sentiment_by_date(m.table("limit_list_daily"))).select("trade_date", "sentiment_score"),
    "SELECT r.trade_date, sentiment_score FROM d_regime r JOIN d_sentiment s ON r.trade_date = s.trade_date",
    "sentiment_score",
)
add(
    "p22_regime_label",
    lambda m: m.regime.select("trade_date", "total_score", "market_regime", "risk_level", "reason"),
    "SELECT trade_date, total_score, market_regime, risk_level, reason FROM d_regime",
    "total_score",
)
add(
    "p23_limit_type_masks",
    lambda m: factors.limit_masks(m.table("limit_list_daily")).select("trade_date", "code", "is_up", "is_down", "is_broken"),
    "SELECT trade_date, code, limit_type = 'U' AS is_up, limit_type = 'D' AS is_down, open_times > 0 AS is_broken FROM limit_list_daily",
)
add("p24_evaluate_versions", lambda m: m.evaluation, "SELECT * FROM d_evaluation", EVAL_D)
add(
    "p25_classify_oos",
    lambda m: m.validation.select("strategy_name", "strategy_version", "overfit_risk", "validation_status"),
    "SELECT strategy_name, strategy_version, overfit_risk, validation_status FROM d_validation",
)
add("p27_position_status", lambda m: m.positions.select("code", ledger.position_status(c("floating_pnl_pct")).alias("position_status")))
add("p28_performance_comment", lambda m: m.performance.select("trade_date", "code", "side", "performance_comment"))
add(
    "p29_strategy_dimension",
    lambda m: m.signal_pool.select("trade_date", "code", F.explode(fc.dimension_list("strategy_names")).alias("strategy_name")),
    "SELECT trade_date, code, unnest(string_split(strategy_names, ',')) AS strategy_name FROM d_signal_pool",
)
add(
    "p30_signals_from_backtest",
    lambda m: backtest.signals_from_backtest(m.results),
    "SELECT signal_date AS trade_date, code, strategy_name, strategy_version, signal_strength, '' AS entry_reason, '' AS risk_flags FROM d_results",
    SIGNAL_D,
)

# Signals
for _i, _n in enumerate(signals.RULES, 1):
    add(f"g{_i:02d}_{_n}", lambda m, n=_n: signals.rule(m.enriched, n, o.OVERRIDES), f"SELECT * FROM d_signals WHERE strategy_name = '{_n}'", SIGNAL_D)
add("g10_run_strategies", lambda m: m.signals, "SELECT * FROM d_signals", SIGNAL_D)
add("g11_historical_signals", lambda m: m.named_signals, "SELECT * FROM d_named_signals", SIGNAL_D)
add(
    "j18_versions_x_factors",
    lambda m: signals.all_versions(m.enriched, m.grid).select("trade_date", "code", "strategy_name", "strategy_version", "signal_strength"),
    "SELECT trade_date, code, strategy_name, strategy_version, signal_strength FROM (" + " UNION ALL ".join(o.rule_sql(n, {p: f"p_{p}" for p in versions.PARAMS} | {"branch": "branch"}, f"d_enriched JOIN v_grid ON strategy_name = '{n}'", "strategy_version") for n in signals.RULES) + ")",
    SIGNAL_D,
)
_active = "SELECT strategy_name, strategy_version FROM d_named_evaluation WHERE recommendation <> 'pause'"
_act = lambda m: m.named_evaluation.where(c("recommendation") != "pause")
add(
    "g12_active_signals",
    lambda m: signals.latest_slice(signals.all_versions(m.enriched, research.filter_active_versions(m.named, _act(m)))),
    f"SELECT * FROM d_named_signals s WHERE (strategy_name, strategy_version) IN ({_active}) AND trade_date = (SELECT max(trade_date) FROM "
    f"d_named_signals WHERE (strategy_name, strategy_version) IN ({_active}))",
    SIGNAL_D,
)
add("f01_filter_main_board", lambda m: signals.filter_main_board(m.basic), f"SELECT * FROM stock_basic WHERE {o._BOARD} AND NOT contains(upper(name), 'ST')")
add(
    "f02_tradable_universe",
    lambda m: signals.tradable_universe(m.enriched, versions.DEFAULTS["oversold_rebound"] | o.OVERRIDES, True).select("trade_date", "code", "close"),
    "SELECT trade_date, code, close FROM d_enriched WHERE " + (o._TRADABLE + " AND NOT ((coalesce(pct_chg_3d, 0) <= -0.1 AND coalesce(pct_chg_5d, 0) <= -0.16) OR coalesce(pct_chg_10d, 0) <= -0.25) AND " + o._BOARD).format(min_amount_ma5=0, min_turnover_rate=0.3),
    "close",
)
add(
    "f03_candidate_filter",
    lambda m: candidates.candidate_filter(m.factors).select("trade_date", "code"),
    "SELECT trade_date, code FROM d_factors WHERE close > 0 AND amount_ma5 >= 0 AND pct_chg_1d < 0.095 AND pct_chg_1d > -0.095 AND close_position_20 "
    "IS NOT NULL AND (above_ma5 OR above_ma10)",
)
add(
    "f04_extension_filters",
    lambda m: candidates.extension_filters(m.enriched, turnover=(0.5, 5.0), circ_mv=(10.0, None)).select("trade_date", "code", "risk_flags"),
    f"SELECT trade_date, code, {o.flag_list(*o._EXT)} AS risk_flags FROM d_enriched WHERE NOT is_suspended AND NOT is_limit_down_close AND "
    f"coalesce(turnover_rate >= 0.5, true) AND coalesce(turnover_rate <= 5.0, true) AND coalesce(circ_mv >= 10.0, true)",
)
add(
    "f05_date_slice",
    lambda m: signals.latest_slice(m.factors).select("trade_date", "code", "close"),
    "SELECT trade_date, code, close FROM d_factors WHERE trade_date = (SELECT max(trade_date) FROM d_factors)",
    "close",
)
add(
    "f06_date_range",
    lambda m: m.factors.where(c("trade_date").between("1995-01-01", "1995-12-31")).select("trade_date", "code", "close"),
    "SELECT trade_date, code, close FROM d_factors WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'",
    "close",
)
add(
    "f07_filter_active_versions",
    lambda m: research.filter_active_versions(m.named, _act(m)).select("strategy_name", "strategy_version"),
    f"SELECT strategy_name, strategy_version FROM v_named WHERE (strategy_name, strategy_version) IN ({_active})",
)
_elig = (
    "SELECT e.strategy_name, e.strategy_version FROM d_named_evaluation e LEFT JOIN d_validation v USING (strategy_name, strategy_version) WHERE "
    "recommendation NOT IN ('pause', 'reduce_or_pause') AND coalesce(validation_status, '') NOT IN ('failed_oos', 'unstable') AND "
    "coalesce(overfit_risk, '') <> 'high'"
)
_elig_df = lambda m: research.eligible_candidate_keys(m.named_evaluation, m.validation)
add("f08_eligible_candidate_keys", _elig_df, _elig)
#: Eligible keys of the rules with their defaults: the plans name those versions.
DERIVED["d_default_validation"] = o.walk_forward_sql("SELECT * FROM d_signals", SPLIT, "(SELECT DISTINCT strategy_name, strategy_version FROM d_signals)")
DERIVED["d_eligible"] = (
    "SELECT e.strategy_name, e.strategy_version FROM d_evaluation e LEFT JOIN d_default_validation v USING (strategy_name, strategy_version) WHERE "
    "recommendation NOT IN ('pause', 'reduce_or_pause') AND coalesce(validation_status, '') NOT IN ('failed_oos', 'unstable') AND "
    "coalesce(overfit_risk, '') <> 'high'"
)
_default_keys = lambda m: research.eligible_candidate_keys(m.evaluation, m.default_validation)


def _of_eligible(table: str) -> str:
    """Rows of *table* with an eligible key; all of them if no row has one."""
    hit = f"list_has_any(string_split(strategy_names, ','), (SELECT coalesce(list(strategy_name), []) FROM d_eligible))"
    return f"SELECT * FROM {table} WHERE {hit} OR NOT (SELECT coalesce(bool_or({hit}), false) FROM {table})"


add(
    "f09_filter_plans_by_candidates",
    lambda m: research.filter_plans_by_candidates(m.plans.withColumn("plan_id", F.concat_ws("-", "trade_date", "code")), _default_keys(m)).select("plan_id", "strategy_names"),
    f"SELECT concat_ws('-', trade_date, code) AS plan_id, strategy_names FROM ({_of_eligible('d_plans')})",
)
_STATUS = (
    "CASE WHEN train_valid_count < 1 THEN 'insufficient_train_samples' WHEN validation_valid_count < 1 THEN 'insufficient_validation_samples' WHEN "
    "train_avg_return_3d > 0 AND validation_avg_return_3d < 0 THEN 'failed_oos' WHEN return_decay < -0.03 OR win_rate_decay < -0.15 THEN 'unstable' "
    "WHEN validation_avg_return_3d >= 0 AND validation_win_rate_3d >= 0.5 THEN 'passed_oos' ELSE 'needs_more_observation' END"
)
add(
    "f10_filter_validation",
    lambda m: research.filter_validation(research.validate(m.validation, 1, 1)).select("strategy_name", "strategy_version", "validation_status"),
    f"SELECT * FROM (SELECT strategy_name, strategy_version, {_STATUS} AS validation_status FROM d_validation) WHERE validation_status IN "
    f"('failed_oos', 'unstable', 'needs_more_observation')",
)

# Joins
ENRICHED_D = FACTOR_D + " turnover_rate turnover_rate_f volume_ratio_daily_basic pe_ttm pb total_mv circ_mv up_limit down_limit net_mf_amount main_net_amount main_net_amount_ratio big_net_amount small_net_amount moneyflow_score industry_strength_score industry_return_3d industry_return_5d industry_amount_ratio_5 limit_up_distance limit_down_distance"
add("j01_enrich_factors", lambda m: m.enriched, "SELECT * FROM d_enriched", ENRICHED_D)
add(
    "j02_attach_industry",
    lambda m: factors.attach_industry(m.factors, m.table("industry_map"), m.industry).select("trade_date", "code", "industry_code", "industry_strength_score", "industry_strength_level"),
    "SELECT trade_date, code, industry_code, industry_strength_score, industry_strength_level FROM d_enriched",
    "industry_strength_score",
)
_members = lambda m: m.table("industry_map").where("code <= '000050'")
_classes = lambda m: m.table("industry_map").select("industry_code", "industry_name").distinct().where("industry_name < 'M'")
add(
    "j03_stock_industry_map",
    lambda m: normalize.build_stock_industry_map(m.basic, _members(m), _classes(m)),
    "SELECT s.code, CASE WHEN s.code <= '000050' OR s.industry < 'M' THEN s.industry END AS industry_code, CASE WHEN s.code <= '000050' OR s.industry "
    "< 'M' THEN s.industry END AS industry_name, CASE WHEN s.code <= '000050' THEN 'member' WHEN s.industry < 'M' THEN 'name_match' ELSE 'unmapped' "
    "END AS mapping_source FROM stock_basic s",
)
add(
    "j04_attach_stock_basic",
    lambda m: candidates.attach_stock_basic(m.factors.select("trade_date", "code"), m.basic),
    "SELECT f.trade_date, f.code, s.name, s.market, s.board FROM d_factors f LEFT JOIN stock_basic s ON f.code = s.code",
)
add(
    "j05_attach_evaluation",
    lambda m: candidates.attach_evaluation(m.signals, m.evaluation).select("trade_date", "code", "strategy_name", "strategy_version", "recommendation", "risk_level"),
    "SELECT trade_date, code, strategy_name, strategy_version, recommendation, risk_level FROM d_signals LEFT JOIN d_evaluation USING (strategy_name, "
    "strategy_version)",
)
add(
    "j06_next_bar_entry",
    lambda m: backtest.next_bar(m.signals.select("trade_date", "code", "strategy_name"), m.bars, ["open"]).select("trade_date", "code", "strategy_name", c("bar.trade_date").alias("entry_date"), c("bar.open").alias("entry_open")),
    "SELECT signal_date AS trade_date, code, strategy_name, entry_date, entry_open FROM d_results",
    "entry_open",
)
_days = lambda m: m.trades.select("trade_date").distinct()
add(
    "j07_asof_regime",
    lambda m: factors.asof_regime(_days(m), m.regime),
    "SELECT t.trade_date, r.market_regime, r.risk_level, r.trade_date AS regime_date FROM (SELECT DISTINCT trade_date FROM actual_trades) t ASOF LEFT "
    "JOIN d_regime r ON t.trade_date >= r.trade_date",
)
add(
    "j08_latest_price_asof",
    lambda m: ledger.latest_price_asof(m.bars, AS_OF),
    f"SELECT code, arg_max(close, trade_date) AS latest_price FROM bars WHERE trade_date <= DATE '{AS_OF}' GROUP BY code",
    "latest_price",
)
add(
    "j09_latest_plan_asof",
    lambda m: ledger.latest_plan_asof(m.plans, AS_OF),
    f"SELECT code, arg_max_null(stop_loss, trade_date) AS planned_stop_loss, arg_max_null(take_profit_1, trade_date) AS planned_take_profit_1, "
    f"arg_max_null(take_profit_2, trade_date) AS planned_take_profit_2 FROM d_plans WHERE trade_date <= DATE '{AS_OF}' GROUP BY code",
    "planned_stop_loss planned_take_profit_1 planned_take_profit_2",
)
add(
    "j10_holding_window_join",
    lambda m: m.plan_results.where("is_valid").select("plan_id", "entry_date", "exit_date", "holding_days", "max_drawdown"),
    "SELECT plan_id, entry_date, exit_date, holding_days, max_drawdown FROM d_plan_results WHERE is_valid",
    "max_drawdown",
)
add(
    "j17_bars_for_plans",
    lambda m: backtest.bars_for_plans(m.bars, m.plans).select("trade_date", "code", "close"),
    "SELECT trade_date, code, close FROM bars WHERE code IN (SELECT code FROM d_plans)",
    "close",
)
add(
    "j19_evaluation_with_performance",
    lambda m: research.evaluation_with_performance(m.evaluation, backtest.signal_performance(m.results)).select("strategy_name", "strategy_version", "evaluation_score", "win_rate_1d", "avg_return_5d"),
    f"SELECT e.strategy_name, e.strategy_version, evaluation_score, win_rate_1d, avg_return_5d FROM d_evaluation e LEFT JOIN "
    f"({o.performance_sql('SELECT * FROM d_results')}) p USING (strategy_name, strategy_version)",
    "evaluation_score win_rate_1d avg_return_5d",
)
_issue = lambda m: quality.compare_providers(m.bars, m.table("bars_b"))
_ISSUES = (
    "SELECT a.trade_date, a.code, 'row' AS field, CAST(NULL AS DOUBLE) AS left_value, CAST(NULL AS DOUBLE) AS right_value, CAST(NULL AS DOUBLE) AS "
    "relative_diff, 'missing_right' AS status FROM bars a LEFT JOIN bars_b b USING (trade_date, code) WHERE b.close IS NULL UNION ALL SELECT "
    "a.trade_date, a.code, 'close', a.close, b.close, abs(a.close - b.close) / greatest(abs(a.close), abs(b.close), 1e-12), 'warning' FROM bars a JOIN "
    "bars_b b USING (trade_date, code) WHERE abs(a.close - b.close) / greatest(abs(a.close), abs(b.close), 1e-12) > 0.01"
)
add("j13_compare_providers", _issue, _ISSUES, "left_value right_value relative_diff")
add(
    "a12_provider_diff_summary",
    lambda m: quality.provider_diff_summary(_issue(m)),
    f"SELECT field, count(*) AS issue_count, max(relative_diff) AS max_relative_diff, avg(relative_diff) AS avg_relative_diff FROM ({_ISSUES}) GROUP BY "
    f"field",
    "max_relative_diff avg_relative_diff",
)
add(
    "c20_provider_compare_job",
    lambda m: quality.provider_diff_summary(_issue(m)).withColumn("status", F.lit("warning")),
    f"SELECT field, count(*) AS issue_count, max(relative_diff) AS max_relative_diff, avg(relative_diff) AS avg_relative_diff, 'warning' AS status FROM "
    f"({_ISSUES}) GROUP BY field",
    "max_relative_diff avg_relative_diff",
)
add(
    "j16_train_validation_join",
    lambda m: m.validation.select("strategy_name", "strategy_version", "train_valid_count", "validation_valid_count", "train_avg_return_3d", "validation_avg_return_3d"),
    "SELECT strategy_name, strategy_version, train_valid_count, validation_valid_count, train_avg_return_3d, validation_avg_return_3d FROM d_validation",
    "train_avg_return_3d validation_avg_return_3d",
)

# Aggregates
add(
    "a01_sentiment_by_date",
    lambda m: factors.sentiment_by_date(m.table("limit_list_daily")),
    "SELECT * FROM d_sentiment",
    "limit_up_open_times_avg highest_streak",
)
add(
    "a02_suspend_any",
    lambda m: factors.suspend_any(m.table("suspend_daily")),
    "SELECT trade_date, code, max(suspend_type = 'S') AS is_suspended FROM suspend_daily GROUP BY ALL",
)


def _weighted(m: Market) -> DataFrame:
    return candidates.attach_evaluation(m.signals, m.evaluation).withColumn("strategy_weight", candidates.strategy_weight(c("recommendation"), c("risk_level")))


AGG_D = "max_signal_strength total_signal_strength total_weighted_signal_strength avg_strategy_weight"
add("a03_aggregate_signals", lambda m: candidates.aggregate_signals(_weighted(m)), "SELECT * FROM d_aggregated", AGG_D)
add(
    "x03_joined_names",
    lambda m: candidates.aggregate_signals(_weighted(m)).select("trade_date", "code", "strategy_names", "risk_flags"),
    "SELECT trade_date, code, strategy_names, risk_flags FROM d_aggregated",
)
add("a04_signal_performance", lambda m: backtest.signal_performance(m.results), o.performance_sql("SELECT * FROM d_results"), PERF_D)
add("a05_plan_performance", lambda m: m.plan_performance, "SELECT * FROM d_plan_performance", PLAN_PERF_D)
add(
    "a06_plan_performance_by_days",
    lambda m: backtest.plan_performance(m.plan_results, ("max_holding_days",)),
    o.plan_performance_sql("SELECT * FROM d_plan_results", "max_holding_days"),
    PLAN_PERF_D,
)
_diag = ["pct_chg_1d", "pct_chg_5d", "pct_chg_10d", "volume_ratio_5", "close_position_20", "turnover_rate", "volume_ratio_daily_basic", "moneyflow_score", "industry_strength_score", "industry_return_5d"]
_DIAG = " UNION ALL ".join(f"SELECT '{n}' AS factor_name, count(*) AS total_count, count(e.{n}) AS non_null_count, avg(e.{n}) AS mean, CASE WHEN count(e.{n}) = 1 THEN 0.0 ELSE stddev_samp(e.{n}) END AS std, min(e.{n}) AS min, max(e.{n}) AS max, quantile_cont(e.{n}, 0.25) AS p25, quantile_cont(e.{n}, 0.5) AS median, quantile_cont(e.{n}, 0.75) AS p75, avg(CASE WHEN p.code IS NOT NULL THEN e.{n} END) AS candidate_mean, avg(CASE WHEN t.code IS NOT NULL THEN e.{n} END) AS plan_mean, 1 - count(e.{n}) / count(*) AS missing_rate FROM d_enriched e LEFT JOIN (SELECT DISTINCT trade_date, code FROM d_pool) p ON e.trade_date = p.trade_date AND e.code = p.code LEFT JOIN (SELECT DISTINCT trade_date, code FROM d_plans) t ON e.trade_date = t.trade_date AND e.code = t.code" for n in _diag)
_DIAG = f"SELECT *, CASE WHEN missing_rate > 0.8 THEN 'high_missing' WHEN missing_rate > 0.3 THEN 'medium_missing' ELSE 'ok' END AS status FROM ({_DIAG})"
DIAG_D = "mean std min max p25 median p75 missing_rate candidate_mean plan_mean"
add("a07_factor_diagnostics", lambda m: quality.factor_diagnostics(m.enriched, _diag, {"candidate": m.pool, "plan": m.plans}), _DIAG, DIAG_D)
add(
    "c22_diagnostics_job",
    lambda m: quality.factor_diagnostics(m.enriched, _diag, {"candidate": m.pool, "plan": m.plans}).where("status <> 'ok' or factor_name like 'pct%'"),
    f"SELECT * FROM ({_DIAG}) WHERE status <> 'ok' OR factor_name LIKE 'pct%'",
    DIAG_D,
)
add(
    "j14_scope_join",
    lambda m: m.pool.select("trade_date", "code").distinct().join(m.enriched.select("trade_date", "code", "pct_chg_5d"), ["trade_date", "code"], "left"),
    "SELECT p.trade_date, p.code, e.pct_chg_5d FROM (SELECT DISTINCT trade_date, code FROM d_pool) p LEFT JOIN d_enriched e ON p.trade_date = "
    "e.trade_date AND p.code = e.code",
    "pct_chg_5d",
)

_VALID_KEYS = "SELECT DISTINCT strategy_name, strategy_version FROM d_evaluation"
_NAMES = "string_split(strategy_names, ',')"
DERIVED["d_exploded"] = f"SELECT p.*, unnest({_NAMES}) AS strategy_name, 'v1' AS strategy_version FROM d_plan_performance p"
DERIVED["d_exploded"] = "SELECT * FROM (" + DERIVED["d_exploded"] + ") WHERE strategy_name <> ''"
DERIVED["d_buys"] = (
    "SELECT * FROM d_exploded WHERE NOT regexp_matches(action, 'watch[_ ]?only|^watch$|sell') AND (regexp_matches(action, 'buy|breakout|support|long') "
    "OR valid_count > 0 OR triggered_count > 0)"
)


def _wm(v: str, w: str) -> str:
    return f"coalesce(sum(CASE WHEN {v} IS NOT NULL THEN {v} * coalesce({w}, 0) END) / nullif(sum(CASE WHEN {v} IS NOT NULL THEN coalesce({w}, 0) END), 0), avg({v}))"


DERIVED["d_plan_admission"] = (
    f"SELECT strategy_name, strategy_version, CAST(sum(valid_count) AS BIGINT) AS trade_plan_valid_count, {_wm('trigger_rate', 'plan_count')} AS "
    f"trade_plan_trigger_rate, {_wm('win_rate', 'valid_count')} AS trade_plan_win_rate, {_wm('avg_return', 'valid_count')} AS trade_plan_avg_return, "
    f"{_wm('avg_max_drawdown', 'valid_count')} AS trade_plan_avg_drawdown FROM d_buys GROUP BY ALL"
)
DERIVED["d_best"] = (
    "SELECT strategy_name, strategy_version, CASE WHEN count(DISTINCT source) > 1 THEN 'mixed' ELSE min(source) END AS source, arg_max(valid_count, "
    "evaluation_score) AS valid_count, arg_max(recommendation, evaluation_score) AS evaluation_recommendation, max(evaluation_score) AS "
    "evaluation_score FROM (SELECT *, 'manual_version' AS source FROM d_evaluation UNION ALL SELECT *, 'parameter_search' FROM d_named_evaluation) "
    "GROUP BY ALL"
)
_pts = lambda key, table: f"coalesce({o.case(key, table, 'NULL')}, 0.0)"
DERIVED["d_admission"] = f"""SELECT *, CASE WHEN coalesce(valid_count, 0) < 30 THEN 'insufficient_samples' WHEN oos_status IN ('failed_oos', 'unstable') OR coalesce(oos_risk = 'high', false) THEN 'oos_failed' WHEN evaluation_recommendation IN ('pause', 'reduce_or_pause') THEN 'risk_rejected' WHEN admission_score >= 70 AND oos_status = 'passed_oos' THEN 'qualified_for_observation' WHEN admission_score >= 50 THEN 'watchlist' ELSE 'research_only' END AS admission_status,
  CASE WHEN coalesce(valid_count, 0) < 30 THEN 'continue_research' WHEN oos_status IN ('failed_oos', 'unstable') OR coalesce(oos_risk = 'high', false) OR evaluation_recommendation IN ('pause', 'reduce_or_pause') THEN 'do_not_enable' WHEN admission_score >= 70 AND oos_status = 'passed_oos' THEN 'enable_observation_candidate' WHEN admission_score >= 50 THEN 'observe_more' ELSE 'continue_research' END AS admission_recommendation
FROM (SELECT *, {_pts('evaluation_recommendation', o.ADVICE)} + least(coalesce(evaluation_score, 0), 50) + {_pts('oos_status', o.STATUS)} + least(coalesce(oos_stability_score, 0), 30) + {o.points(("oos_risk = 'high'", -40), ('valid_count < 30', -20), ('trade_plan_trigger_rate >= 0.3', 10), ('trade_plan_win_rate >= 0.5', 10), ('trade_plan_avg_return > 0', 10), ('trade_plan_avg_drawdown < -0.08', -20))} AS admission_score
  FROM (SELECT b.*, validation_status AS oos_status, overfit_risk AS oos_risk, stability_score AS oos_stability_score, trade_plan_valid_count, trade_plan_trigger_rate, trade_plan_win_rate, trade_plan_avg_return, trade_plan_avg_drawdown FROM d_best b LEFT JOIN d_validation v USING (strategy_name, strategy_version) LEFT JOIN d_plan_admission p USING (strategy_name, strategy_version)))"""


def _exploded(m: Market) -> DataFrame:
    return research.explode_dimensions(m.plan_performance, m.evaluation)


def _best(m: Market) -> DataFrame:
    return research.best_evaluation(m.evaluation, m.named_evaluation)


def _admission(m: Market) -> DataFrame:
    return research.strategy_admission(m.evaluation, m.named_evaluation, m.validation, m.plan_performance)


PLAN_ADM_D = "trade_plan_valid_count trade_plan_trigger_rate trade_plan_win_rate trade_plan_avg_return trade_plan_avg_drawdown"
add(
    "a08_weighted_mean",
    lambda m: _exploded(m).groupBy("strategy_name").agg(research.weighted_mean("avg_return", "valid_count").alias("r")),
    f"SELECT strategy_name, {_wm('avg_return', 'valid_count')} AS r FROM d_exploded GROUP BY strategy_name",
    "r",
)
add(
    "a09_admission_plan_aggregate",
    lambda m: _real(research.admission_plan_aggregate(research.select_buy_actions(_exploded(m))), "trade_plan_valid_count"),
    "SELECT * FROM d_plan_admission",
    PLAN_ADM_D,
)
add("a10_best_evaluation", _best, "SELECT * FROM d_best", "evaluation_score")
add(
    "a11_select_buy_actions",
    lambda m: research.select_buy_actions(m.plan_performance).select("strategy_names", "action", "max_holding_days", "valid_count"),
    "SELECT strategy_names, action, max_holding_days, valid_count FROM d_plan_performance WHERE NOT regexp_matches(action, 'watch[_ "
    "]?only|^watch$|sell') AND (regexp_matches(action, 'buy|breakout|support|long') OR valid_count > 0 OR triggered_count > 0)",
)
add(
    "a13_explode_dimensions",
    lambda m: _exploded(m).select("strategy_names", "action", "max_holding_days", "strategy_name", "strategy_version"),
    "SELECT strategy_names, action, max_holding_days, strategy_name, strategy_version FROM d_exploded",
)
add(
    "a14_expand_holding_days",
    lambda m: m.expanded.select("trade_date", "code", "strategy_names", "max_holding_days"),
    "SELECT trade_date, code, strategy_names, max_holding_days FROM d_expanded",
)
add(
    "j15_merge_oos",
    lambda m: research.merge_oos(_best(m), m.validation),
    "SELECT b.*, validation_status AS oos_status, overfit_risk AS oos_risk, stability_score AS oos_stability_score FROM d_best b LEFT JOIN "
    "d_validation v USING (strategy_name, strategy_version)",
    "evaluation_score oos_stability_score",
)
add(
    "j15_merge_plan_performance",
    lambda m: _real(research.merge_plan_performance(_best(m), m.plan_performance), "trade_plan_valid_count"),
    "SELECT b.*, trade_plan_valid_count, trade_plan_trigger_rate, trade_plan_win_rate, trade_plan_avg_return, trade_plan_avg_drawdown FROM d_best b "
    "LEFT JOIN d_plan_admission p USING (strategy_name, strategy_version)",
    "evaluation_score " + PLAN_ADM_D,
)
add(
    "p26_admission_score",
    lambda m: _admission(m).select("strategy_name", "strategy_version", "admission_score", "admission_status"),
    "SELECT strategy_name, strategy_version, admission_score, admission_status FROM d_admission",
    "admission_score",
)
add(
    "c10_strategy_admission",
    lambda m: _real(_admission(m), "trade_plan_valid_count"),
    "SELECT * FROM d_admission",
    "evaluation_score oos_stability_score admission_score " + PLAN_ADM_D,
)

# Trades
_POS = "planned_action, entry_low, entry_high, position_low, position_high, stop_loss, take_profit_1, take_profit_2"
DERIVED["d_review"] = f"""SELECT t.*, p.rank AS plan_rank, p.action AS planned_action, p.entry_low, p.entry_high, p.position_low, p.position_high, p.stop_loss, p.take_profit_1, p.take_profit_2,
  CASE WHEN p.code IS NULL THEN 'no_plan' ELSE 'matched' END AS plan_match_status,
  CASE WHEN p.code IS NULL THEN 'off_plan' WHEN side = 'sell' THEN 'recorded_sell' WHEN entry_low IS NULL OR entry_high IS NULL THEN 'deviation' WHEN price BETWEEN entry_low AND entry_high THEN 'follow_plan' ELSE 'deviation' END AS execution_status,
  CASE WHEN p.code IS NULL THEN 'plan_not_found' WHEN side = 'sell' THEN 'sell_recorded' WHEN entry_low IS NULL OR entry_high IS NULL THEN 'bought_watch_only' WHEN price BETWEEN entry_low AND entry_high THEN 'price_in_range' WHEN price > entry_high THEN 'chase_above_entry' ELSE 'below_entry_range' END AS execution_flags
FROM actual_trades t LEFT JOIN d_plans p ON t.trade_date = p.trade_date AND t.code = p.code"""
_win = ", ".join(f"lead(close, {k - 1}) OVER w AS c{k}, CASE WHEN lead(1, {k - 1}) OVER w = 1 THEN min(low) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) END AS l{k}, CASE WHEN lead(1, {k - 1}) OVER w = 1 THEN max(high) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) END AS h{k}" for k in (1, 3, 5))
DERIVED["d_performance"] = f"""SELECT *, invalid_reason = '' AS is_valid FROM (SELECT r.trade_date, r.code, r.side, r.price, r.execution_status, r.execution_flags, {', '.join(f"CASE WHEN side = 'buy' THEN c{k} / price - 1 END AS return_{k}d, CASE WHEN side = 'buy' THEN l{k} / price - 1 END AS max_drawdown_{k}d, CASE WHEN side = 'buy' THEN h{k} / price - 1 END AS max_favorable_{k}d" for k in (1, 3, 5))},
  CASE WHEN side <> 'buy' THEN 'sell_trade_not_evaluated' WHEN l1 IS NULL THEN 'insufficient_daily_bars:1d,3d,5d' WHEN l3 IS NULL THEN 'insufficient_daily_bars:3d,5d' WHEN l5 IS NULL THEN 'insufficient_daily_bars:5d' ELSE '' END AS invalid_reason
FROM d_review r ASOF LEFT JOIN (SELECT *, {_win} FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)) b ON r.code = b.code AND r.trade_date <= b.trade_date)"""
REVIEW_D = "price volume amount entry_low entry_high position_low position_high stop_loss take_profit_1 take_profit_2"
TRADE_D = "price " + " ".join(f"{x}_{k}d" for k in (1, 3, 5) for x in ("return", "max_drawdown", "max_favorable"))
add("c12_execution_review", lambda m: _real(m.review, "plan_rank"), "SELECT * FROM d_review", REVIEW_D + " plan_rank")
add(
    "j11_match_trades_to_plan",
    lambda m: ledger.match_trades_to_plan(m.trades, m.plans).select("trade_date", "code", "side", "plan_rank", "planned_action", "entry_low").withColumn("plan_rank", c("plan_rank").cast("double")),
    "SELECT trade_date, code, side, plan_rank, planned_action, entry_low FROM d_review",
    "entry_low plan_rank",
)
_perf_cols = ["trade_date", "code", "side", "price", "execution_status", "execution_flags", *[f"{x}_{k}d" for k in (1, 3, 5) for x in ("return", "max_drawdown", "max_favorable")], "invalid_reason", "is_valid"]
add("c13_trade_performance", lambda m: m.performance.select(*_perf_cols), "SELECT * FROM d_performance", TRADE_D)
add(
    "j12_match_trades_to_review",
    lambda m: ledger.match_trades_to_review(m.trades, m.review).select("trade_date", "code", "side", "plan_match_status", "execution_status"),
    "SELECT trade_date, code, side, plan_match_status, execution_status FROM d_review",
)
QUERIES["p28_performance_comment"] = Query(QUERIES["p28_performance_comment"].run, "SELECT trade_date, code, side, CASE WHEN t = '' THEN 'no clear result' ELSE t END AS performance_comment FROM (SELECT *, array_to_string(list_filter([CASE WHEN return_3d > 0 AND max_drawdown_3d > -0.03 THEN 'steady' END, CASE WHEN return_3d IS NOT NULL AND max_drawdown_3d < -0.05 THEN 'deep drawdown' END, CASE WHEN execution_flags = 'chase_above_entry' THEN 'chased the price' END, CASE WHEN execution_status = 'off_plan' THEN 'off plan' END], lambda x: x IS NOT NULL), '; ') AS t FROM d_performance)")


def _execution(keys: str, source: str, extra: str = "") -> str:
    has = lambda f: f"count_if(execution_flags = '{f}')"
    st = lambda s: f"count_if(execution_status = '{s}')"
    return f"SELECT {keys}, count(*) AS actual_trade_count, count_if(side = 'buy') AS buy_count, count_if(side = 'sell') AS sell_count, count_if(plan_match_status <> 'no_plan') AS matched_plan_count, {st('off_plan')} AS off_plan_count, {st('follow_plan')} AS follow_plan_count, {st('deviation')} AS deviation_count, {has('chase_above_entry')} AS chase_count, CAST(0 AS BIGINT) AS over_position_count, {has('bought_watch_only')} AS bought_watch_only_count{extra} FROM {source} GROUP BY ALL"


def _stats(keys: str, source: str, extra: str = "") -> str:
    ok = lambda cond, x: f"avg(CASE WHEN is_valid AND {cond} THEN {x} END)"
    return f"SELECT {keys}, count_if(is_valid) AS valid_performance_count, {', '.join(f'''{ok('true', f'return_{k}d')} AS avg_return_{k}d''' for k in (1, 3, 5))}, {ok('''execution_status <> 'off_plan' ''', 'return_3d')} AS plan_trade_avg_return_3d, {ok('''execution_status = 'off_plan' ''', 'return_3d')} AS off_plan_avg_return_3d, count_if(is_valid AND execution_flags = 'chase_above_entry') AS chase_trade_count, {ok('''execution_flags = 'chase_above_entry' ''', 'return_3d')} AS chase_avg_return_3d{extra} FROM {source} GROUP BY ALL"


_COUNTS = ["actual_trade", "buy", "sell", "matched_plan", "off_plan", "follow_plan", "deviation", "chase", "over_position", "bought_watch_only", "planned_trade", "valid_performance", "chase_trade"]
_SCORE = "greatest(100 - off_plan_count * 20 - deviation_count * 15 - chase_count * 10 - over_position_count * 10 - bought_watch_only_count * 20, 0)"
_ISSUE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {x}_count > 0 THEN '{x}' END" for x in ("off_plan", "chase", "over_position", "bought_watch_only")) + "], lambda x: x IS NOT NULL), ';')"
_TOTAL = "off_plan_count + deviation_count + chase_count + over_position_count + bought_watch_only_count"


def _scored_sql(inner: str) -> str:
    return f"SELECT *, {_SCORE} AS execution_score, coalesce(nullif({_ISSUE}, ''), 'none') AS main_issues, CASE WHEN {_TOTAL} >= 2 THEN 'trade less and keep to plans' WHEN {_TOTAL} = 1 THEN 'look into the deviation' ELSE 'keep going' END AS next_action_suggestion FROM ({inner})"


STATS_D = "avg_return_1d avg_return_3d avg_return_5d plan_trade_avg_return_3d off_plan_avg_return_3d chase_avg_return_3d"
_day = (
    f"SELECT * REPLACE ({', '.join(f'coalesce({x}_count, 0) AS {x}_count' for x in _COUNTS)}) FROM ({_execution('trade_date', 'd_review')}) FULL JOIN "
    f"(SELECT trade_date, count(*) AS planned_trade_count FROM d_plans GROUP BY trade_date) USING (trade_date) LEFT JOIN "
    f"({_stats('trade_date', 'd_performance')}) USING (trade_date)"
)
add("a15_daily_review", lambda m: ledger.daily_review(m.review, m.plans, m.performance), _scored_sql(_day), STATS_D)
_periods = lambda m: m.trades.select(F.date_trunc("year", "trade_date").cast("date").alias("start_date")).distinct().select(F.year("start_date").cast("string").alias("period"), "start_date", (F.add_months("start_date", 12) - F.expr("interval 1 day")).cast("date").alias("end_date"))
_YEARS = (
    "SELECT DISTINCT CAST(year(trade_date) AS VARCHAR) AS period, make_date(year(trade_date), 1, 1) AS start_date, make_date(year(trade_date), 12, 31) "
    "AS end_date FROM actual_trades"
)
_year = (
    f"SELECT * FROM ({_YEARS}) LEFT JOIN "
    f"({_execution('period', '(SELECT *, CAST(year(trade_date) AS VARCHAR) AS period FROM d_review)', ', count(DISTINCT trade_date) AS trading_days')}) "
    f"USING (period) LEFT JOIN "
    f"({_stats('period', '(SELECT *, CAST(year(trade_date) AS VARCHAR) AS period FROM d_performance)', ', arg_max(code, CASE WHEN is_valid AND return_3d IS NOT NULL THEN {{r: round(return_3d, 9), c: code, d: trade_date}} END) AS best_code, arg_min(code, CASE WHEN is_valid AND return_3d IS NOT NULL THEN {{r: round(return_3d, 9), c: code, d: trade_date}} END) AS worst_code'.replace('{{', '{').replace('}}', '}'))}) "
    f"USING (period)"
)
add("a16_period_review", lambda m: ledger.period_review(m.review, m.performance, _periods(m)), _scored_sql(_year), STATS_D)
_kinds = {"in_plan": "execution_status <> 'off_plan'", "off_plan": "execution_status = 'off_plan'", "chase": "execution_flags = 'chase_above_entry'", "over_position": "false"}
add(
    "a24_performance_by_execution",
    lambda m: ledger.performance_by_execution(m.performance),
    "SELECT " + ", ".join(f"avg(CASE WHEN is_valid AND {v} THEN return_3d END) AS {k}_return_3d, avg(CASE WHEN is_valid AND {v} THEN max_drawdown_3d END) AS {k}_max_drawdown_3d" for k, v in _kinds.items()) + " FROM d_performance",
    " ".join(f"{k}_return_3d {k}_max_drawdown_3d" for k in _kinds),
)

DERIVED["d_fold"] = f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date, trade_time, side) AS i FROM actual_trades WHERE trade_date <= DATE '{AS_OF}'),
  f AS (SELECT code, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS h, CAST(0 AS DOUBLE) AS cost FROM (SELECT DISTINCT code FROM t) UNION ALL
    SELECT f.code, t.i, CAST(CASE WHEN side = 'buy' THEN h + volume ELSE greatest(h - volume, 0) END AS DOUBLE), CAST(CASE WHEN side = 'buy' THEN cost + amount WHEN h - volume > 0 THEN cost - cost / h * volume ELSE 0 END AS DOUBLE) FROM f JOIN t ON f.code = t.code AND t.i = f.i + 1)
SELECT code, arg_max(h, i) AS h, arg_max(cost, i) AS cost FROM f GROUP BY code"""
DERIVED["d_positions"] = f"""SELECT *, CASE WHEN available_volume <= 0 THEN 'not_sellable_today' ELSE 'sellable' END AS t_plus_1_status, CASE WHEN floating_pnl_pct IS NULL THEN 'unknown' WHEN floating_pnl_pct <= -0.05 THEN 'loss_warning' WHEN floating_pnl_pct >= 0.05 THEN 'profit_watch' ELSE 'normal' END AS position_status
FROM (SELECT *, holding_volume - frozen_volume AS available_volume, holding_volume * latest_price AS market_value, holding_volume * latest_price - cost_amount AS floating_pnl, latest_price / cost_price - 1 AS floating_pnl_pct
  FROM (SELECT DATE '{AS_OF}' AS as_of_date, g.code, f.h AS holding_volume, least(g.frozen, f.h) AS frozen_volume, f.cost AS cost_amount, p.latest_price, g.first_buy_date, g.latest_trade_date, CASE WHEN f.h > 0 THEN f.cost / f.h END AS cost_price
    FROM (SELECT code, coalesce(sum(CASE WHEN side = 'buy' AND trade_date = DATE '{AS_OF}' THEN volume END), 0) AS frozen, coalesce(min(CASE WHEN side = 'buy' THEN trade_date END), max(trade_date)) AS first_buy_date, max(trade_date) AS latest_trade_date FROM actual_trades WHERE trade_date <= DATE '{AS_OF}' GROUP BY code) g
    JOIN d_fold f ON g.code = f.code LEFT JOIN (SELECT code, arg_max(close, trade_date) AS latest_price FROM bars WHERE trade_date <= DATE '{AS_OF}' GROUP BY code) p ON g.code = p.code))"""
DERIVED["d_reviewed"] = f"""SELECT *, CASE WHEN below THEN 'high' ELSE 'low' END AS position_risk_level, {o.flag_list(("below", "below_stop_loss"), ("target", "take_profit_zone"), ("locked", "t_plus_1_locked"))} AS position_flags,
  CASE WHEN below AND locked THEN 'handle first thing next day' WHEN below THEN 'follow the stop' WHEN target THEN 'consider taking profit' ELSE 'keep watching' END AS next_action_hint
FROM (SELECT h.*, p.planned_stop_loss, p.planned_take_profit_1, p.planned_take_profit_2, coalesce(latest_price <= planned_stop_loss, false) AS below, coalesce(latest_price >= planned_take_profit_1, false) AS target, t_plus_1_status = 'not_sellable_today' AS locked
  FROM d_positions h LEFT JOIN ({QUERIES["j09_latest_plan_asof"].sql}) p ON h.code = p.code)"""
POS_D = "holding_volume frozen_volume cost_amount latest_price available_volume cost_price market_value floating_pnl floating_pnl_pct"
add("c14_positions", lambda m: m.positions, "SELECT * FROM d_positions", POS_D)
QUERIES["p27_position_status"] = Query(QUERIES["p27_position_status"].run, "SELECT code, position_status FROM d_positions")
add(
    "p27_next_action",
    lambda m: m.reviewed.select("code", "position_flags", "next_action_hint"),
    "SELECT code, position_flags, next_action_hint FROM d_reviewed",
)
add(
    "c15_position_review",
    lambda m: m.reviewed,
    "SELECT * EXCLUDE (below, target, locked) FROM d_reviewed",
    POS_D + " planned_stop_loss planned_take_profit_1 planned_take_profit_2",
)
add(
    "c16_after_market_review",
    lambda m: m.reviewed.select("code", "position_risk_level", "floating_pnl").join(m.performance.groupBy("code").agg(F.count_if("is_valid").alias("valid_trades"), F.avg(F.when(c("is_valid"), c("return_3d"))).alias("avg_return_3d")), "code", "left"),
    "SELECT r.code, position_risk_level, floating_pnl, valid_trades, avg_return_3d FROM d_reviewed r LEFT JOIN (SELECT code, count_if(is_valid) AS "
    "valid_trades, avg(CASE WHEN is_valid THEN return_3d END) AS avg_return_3d FROM d_performance GROUP BY code) p ON r.code = p.code",
    "floating_pnl avg_return_3d",
)
add(
    "a23_positions_totals",
    lambda m: ledger.positions_totals(m.reviewed),
    "SELECT count(*) AS position_count, sum(market_value) AS market_value, sum(floating_pnl) AS floating_pnl, count_if(position_risk_level = 'high') "
    "AS high_risk_count, count_if(locked) AS locked_count FROM d_reviewed",
    "market_value floating_pnl",
)

# Composite jobs
add(
    "c01_select_candidates",
    lambda m: m.pool.select(*POOL.split()),
    f"SELECT {POOL.replace(' ', ', ').replace('risk_flags', 'all_flags AS risk_flags')} FROM d_pool",
    POOL_D,
)
add(
    "c02_candidates_from_signals",
    lambda m: m.signal_pool.select(*POOL.split(), "strategy_names", "active_signal_count"),
    f"SELECT {POOL.replace(' ', ', ').replace('risk_flags', 'all_flags AS risk_flags')}, strategy_names, active_signal_count FROM d_signal_pool",
    POOL_D,
)
add(
    "c03_historical_plans",
    lambda m: m.plans.groupBy("trade_date").agg(F.count(F.lit(1)).alias("plan_count"), F.count_if(c("action") != "watch").alias("active_count"), F.avg("close").alias("avg_close")),
    "SELECT trade_date, count(*) AS plan_count, count_if(action <> 'watch') AS active_count, avg(close) AS avg_close FROM d_plans GROUP BY trade_date",
    "avg_close",
)
add("c04_signal_backtest", lambda m: m.results, "SELECT * FROM d_results", BACKTEST_D)
add(
    "c05_plan_backtest",
    lambda m: _real(m.plan_results.drop("strategy_type"), "holding_days"),
    "SELECT * EXCLUDE (watch, strategy_type) FROM d_plan_results",
    PLAN_RESULT_D + " holding_days",
)
#: How much of the data each version of the grid selects: the grid itself is a list made on the driver.
add(
    "c06_grid",
    lambda m: m.grid.select("strategy_name", "strategy_version").join(signals.all_versions(m.enriched, m.grid).groupBy("strategy_name", "strategy_version").agg(F.count(F.lit(1)).alias("n")), ["strategy_name", "strategy_version"], "left").na.fill(0, ["n"]),
    "SELECT strategy_name, strategy_version, coalesce(n, 0) AS n FROM v_grid LEFT JOIN (SELECT strategy_name, strategy_version, count(*) AS n FROM (" + o.all_versions_sql("v_grid") + ") GROUP BY ALL) USING (strategy_name, strategy_version)",
)
add("c07_parameter_search", lambda m: m.searched, "SELECT * FROM d_searched", EVAL_D)
add("c18_version_backtest", lambda m: m.named_evaluation, "SELECT * FROM d_named_evaluation", EVAL_D)
add("c08_walk_forward", lambda m: m.validation, "SELECT * FROM d_validation", VALID_D)
add(
    "c09_plan_backtest_job",
    lambda m: backtest.plan_performance(m.plan_results, ("strategy_names", "max_holding_days")),
    o.plan_performance_sql("SELECT * FROM d_plan_results", "strategy_names, max_holding_days"),
    PLAN_PERF_D,
)


def _rerun(m: Market) -> DataFrame:
    """Stored plans of eligible candidates backtested again, their performance, and admission on top of it."""
    kept = research.filter_plans_by_candidates(m.expanded, _default_keys(m)).select("plan_id")
    performance = backtest.plan_performance(m.plan_results.join(kept, "plan_id", "left_semi"))
    return _real(research.strategy_admission(m.evaluation, m.named_evaluation, m.validation, performance), "trade_plan_valid_count")


_again = {"d_plan_performance": "d_again_performance", "d_exploded": "d_again_exploded", "d_buys": "d_again_buys", "d_plan_admission": "d_again_plan_admission"}
DERIVED["d_again"] = _of_eligible("d_plan_results")
DERIVED["d_again_performance"] = o.plan_performance_sql("SELECT * FROM d_again")
for _k in ("d_exploded", "d_buys", "d_plan_admission", "d_admission"):
    DERIVED[_again.get(_k, "d_again_admission")] = re.sub("|".join(rf"\b{x}\b" for x in _again), lambda x: _again[x.group()], DERIVED[_k])
add("c11_rerun_plans", _rerun, "SELECT * FROM d_again_admission", "evaluation_score oos_stability_score admission_score " + PLAN_ADM_D)
add(
    "c17_factor_build",
    lambda m: m.enriched.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.avg("moneyflow_score").alias("flow"), F.avg("industry_strength_score").alias("industry"), F.count_if("is_limit_up_close").alias("limit_ups")).join(m.regime.select("trade_date", "market_regime"), "trade_date", "left"),
    "SELECT e.*, r.market_regime FROM (SELECT trade_date, count(*) AS n, avg(moneyflow_score) AS flow, avg(industry_strength_score) AS industry, "
    "count_if(is_limit_up_close) AS limit_ups FROM d_enriched GROUP BY trade_date) e LEFT JOIN d_regime r ON e.trade_date = r.trade_date",
    "flow industry",
)
_CHECKS = {"null_values": "(SELECT " + " + ".join(f"count_if({x} IS NULL)" for x in quality.REQUIRED) + " FROM bars)", "duplicated_rows": "(SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM bars GROUP BY trade_date, code) WHERE k > 1)", "invalid_price_relation": "(SELECT count_if(high < low OR open < low OR open > high OR close < low OR close > high) FROM bars)", "non_positive_price": "(SELECT count_if(open <= 0) + count_if(high <= 0) + count_if(low <= 0) + count_if(close <= 0) FROM bars)", "negative_volume_amount": "(SELECT count_if(volume < 0) + count_if(amount < 0) FROM bars)", "trade_date_format": "0", "code_format": "(SELECT count_if(NOT regexp_full_match(code, '\\d{6}')) FROM bars)"}
_REPORT = "SELECT check_name, CASE WHEN issue_count > 0 THEN bad ELSE 'ok' END AS status, issue_count FROM (SELECT 'empty_data' AS check_name, 'error' AS bad, CAST((SELECT count(*) = 0 FROM bars) AS BIGINT) AS issue_count UNION ALL SELECT 'required_columns', 'error', CAST(0 AS BIGINT) UNION ALL " + " UNION ALL ".join(f"SELECT '{k}', 'warning', CAST({v} AS BIGINT)" for k, v in _CHECKS.items()) + ")"
add("a19_quality_checks", lambda m: quality.quality_checks(m.bars), _REPORT)
add(
    "a28_quality_status",
    lambda m: quality.quality_status(quality.quality_checks(m.bars)),
    f"SELECT *, CASE WHEN error_count > 0 THEN 'error' WHEN warning_count > 0 THEN 'warning' ELSE 'ok' END AS overall_status FROM (SELECT "
    f"count_if(status = 'error') AS error_count, count_if(status = 'warning') AS warning_count FROM ({_REPORT}))",
)
#: Columns, thresholds and what an absence of all columns means.
_groups = {
    "enriched_daily_factors_missing_rate": (["volume_ratio_daily_basic", "total_mv", "circ_mv"], 0.3, "info"),
    "moneyflow_factors_missing_rate": (["moneyflow_score", "main_net_amount", "main_net_amount_ratio"], 0.5, "warning"),
    "industry_strength_missing_rate": (["industry_strength_score", "industry_strength_level"], 0.5, "warning"),
}
_RATES = " UNION ALL ".join(
    f"SELECT '{k}' AS check_name, CASE WHEN n = 0 THEN 'info' WHEN k > {most} * n THEN 'warning' ELSE 'ok' END AS status, CAST(k AS BIGINT) AS issue_count, k / nullif(n, 0) AS missing_rate FROM (SELECT count(*) AS n, count_if({' OR '.join(f'{x} IS NULL' for x in cols)}) AS k FROM d_enriched)"
    for k, (cols, most, _) in _groups.items()
)
add("a20_missing_rate_checks", lambda m: quality.missing_rate_checks(m.enriched, _groups), _RATES, "missing_rate")
_tables = {"moneyflow_table_status": "moneyflow", "stock_industry_map_status": "industry_map"}
_STATES = " UNION ALL ".join(f"SELECT '{k}' AS check_name, CASE WHEN count(*) = 0 THEN 'warning' ELSE 'ok' END AS status, CAST(count(*) = 0 AS BIGINT) AS issue_count FROM {t}" for k, t in _tables.items())


def _quality_job(m: Market) -> DataFrame:
    parts = [quality.quality_checks(m.bars), quality.missing_rate_checks(m.enriched, _groups).drop("missing_rate"), *[quality.table_status(m.table(t), k) for k, t in _tables.items()]]
    parts.append(quality.diagnostics_check(quality.factor_diagnostics(m.enriched, _diag), m.enriched))
    return reduce(DataFrame.unionByName, parts)


add(
    "c19_data_quality_job",
    _quality_job,
    f"SELECT * FROM ({_REPORT}) UNION ALL SELECT check_name, status, issue_count FROM ({_RATES}) UNION ALL SELECT * FROM ({_STATES}) UNION ALL "
    f"SELECT 'factor_diagnostics_high_missing', CASE WHEN k >= 3 THEN 'warning' ELSE 'ok' END, CAST(k AS BIGINT) FROM (SELECT count_if(status = 'high_missing') AS k FROM ({_DIAG}))",
)
add(
    "c21_signal_backtest_job",
    lambda m: backtest.signal_performance(m.results, ("strategy_name",)),
    o.performance_sql("SELECT * FROM d_results", "strategy_name"),
    PERF_D,
)
add(
    "a17_outcome_distribution",
    lambda m: quality.outcome_distribution(m.plan_results.withColumn("exit_reason", F.coalesce("exit_reason", F.lit(""))), ["exit_reason", "invalid_reason"]),
    "SELECT coalesce(exit_reason, '') AS exit_reason, invalid_reason, count(*) AS n FROM d_plan_results GROUP BY ALL",
)
add(
    "a26_holding_distributions",
    lambda m: quality.holding_distributions(m.plan_results),
    "SELECT 'holding' AS kind, strategy_names, CAST(holding_days AS VARCHAR) AS value, count(*) AS n, CAST(NULL AS DOUBLE) AS avg_return FROM "
    "d_plan_results WHERE is_valid GROUP BY ALL UNION ALL SELECT 'exit', strategy_names, exit_reason, count(*), NULL FROM d_plan_results WHERE "
    "is_valid GROUP BY ALL UNION ALL SELECT 'max_days', NULL, CAST(max_holding_days AS VARCHAR), count_if(is_valid), avg(CASE WHEN is_valid THEN "
    "return_pct END) FROM d_plan_results GROUP BY max_holding_days",
    "avg_return",
)
add(
    "a18_status_counts",
    lambda m: quality.status_counts({"evaluation": (m.named_evaluation, "evaluation_status"), "validation": (m.validation, "validation_status"), "admission": (_admission(m), "admission_status")}),
    " UNION ALL ".join(f"SELECT '{k}' AS source, {v} AS status, count(*) AS n FROM {t} GROUP BY ALL" for k, v, t in (("evaluation", "evaluation_status", "d_named_evaluation"), ("validation", "validation_status", "d_validation"), ("admission", "admission_status", "d_admission"))),
)
_tabs = {"orders": "o_orderdate", "lineitem": "l_shipdate", "customer": None, "events": "ts"}
_PROFILE = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, {f'CAST(min({d}) AS DATE)' if d else 'CAST(NULL AS DATE)'} AS min_date, {f'CAST(max({d}) AS DATE)' if d else 'CAST(NULL AS DATE)'} AS max_date, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM {t}" for t, d in _tabs.items())
add("a21_table_profile", lambda m: quality.table_profile({t: (m.table(t), d) for t, d in _tabs.items()}), _PROFILE)
add(
    "a27_research_counts",
    lambda m: quality.table_profile({"signals": (m.signals, "trade_date"), "results": (m.results, "signal_date"), "plans": (m.plans, "trade_date")}).select("table_name", "row_count"),
    "SELECT 'signals' AS table_name, count(*) AS row_count FROM d_signals UNION ALL SELECT 'results', count(*) FROM d_results UNION ALL SELECT "
    "'plans', count(*) FROM d_plans",
)
add(
    "a22_coverage_state",
    lambda m: quality.coverage_state(m.enriched, ["industry_strength_score", "moneyflow_score"]),
    "SELECT max(trade_date) AS latest_date, count_if(trade_date = l) AS latest_rows, avg(CAST(industry_strength_score IS NULL OR moneyflow_score IS "
    "NULL AS DOUBLE)) AS missing_rate, count_if(trade_date = l AND industry_strength_level = 'strong') AS strong_count, count_if(trade_date = l AND "
    "industry_strength_level = 'weak') AS weak_count FROM d_enriched, (SELECT max(trade_date) AS l FROM d_enriched)",
    "missing_rate",
)
add("a25_available_dates", lambda m: quality.available_dates([m.bars, m.trades]), "SELECT trade_date FROM bars UNION SELECT trade_date FROM actual_trades")
add(
    "l02_top_by",
    lambda m: quality.top_by(m.results.where("is_valid").withColumn("r", F.round("return_5d", 9)), "r", 10, ["signal_date", "code", "strategy_name"]).select("signal_date", "code", "strategy_name", "return_5d"),
    "SELECT signal_date, code, strategy_name, return_5d FROM d_results WHERE is_valid ORDER BY round(return_5d, 9) DESC, signal_date, code, "
    "strategy_name LIMIT 10",
    "return_5d",
)
add(
    "l03_limit_offset_page",
    lambda m: quality.page(m.plans, ["trade_date", "code"], 50, 100).select("trade_date", "code", "rank"),
    "SELECT trade_date, code, rank FROM d_plans ORDER BY trade_date, code LIMIT 50 OFFSET 100",
)
add(
    "l01_order_output",
    lambda m: store.order_output(m.industry, "trade_date", "industry_code").select("trade_date", "industry_code"),
    "SELECT trade_date, industry_code FROM d_industry",
)
add(
    "u01_union_signals",
    lambda m: signals.rule(m.enriched, "trend_pullback").unionByName(signals.rule(m.enriched, "breakout_volume")),
    "SELECT * FROM d_signals WHERE strategy_name IN ('trend_pullback', 'breakout_volume')",
    SIGNAL_D,
)
add(
    "u02_union_versions",
    lambda m: m.named_signals.groupBy("strategy_name", "strategy_version").agg(F.count(F.lit(1)).alias("n"), F.sum("signal_strength").alias("s")),
    "SELECT strategy_name, strategy_version, count(*) AS n, sum(signal_strength) AS s FROM d_named_signals GROUP BY ALL",
    "s",
)
add(
    "u03_distinct_dims",
    lambda m: m.plans.select("strategy_names", "strategy_versions").distinct(),
    "SELECT DISTINCT strategy_names, strategy_versions FROM d_plans",
)

# Sources and keyed writes
_half = lambda m, odd: m.table("orders").where(c("o_orderkey") % 3 != (1 if odd else 2)).select(c("o_orderkey").alias("k"), c("o_custkey").alias("run_id"), (c("o_totalprice") * (2 if odd else 1)).alias("v"))
_OLD, _NEW = "SELECT o_orderkey AS k, o_custkey AS run_id, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 2", "SELECT o_orderkey AS k, o_custkey AS run_id, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 3 <> 1"
_UP = f"SELECT * FROM ({_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM ({_NEW}) n WHERE n.k = o.k) UNION ALL {_NEW}"
add(
    "s01_read_table",
    lambda m: store.read_table(m.spark, f"{m.sf_dir}/orders.parquet", "1995-01-01", "1996-06-30", "o_orderdate", o_orderstatus="F").select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND o_orderstatus = 'F'",
    "o_totalprice",
)
_raw = lambda m: m.bars.select(F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), F.concat("code", F.lit(".SZ")).alias("ts_code"), *[c(x).cast("string").alias("vol" if x == "volume" else x) for x in ("open", "high", "low", "close", "volume", "amount")])
BAR_D = "open high low close volume amount"
add(
    "s04_normalize_daily_bars",
    lambda m: normalize.normalize_daily_bars(_raw(m)),
    "SELECT trade_date, code, open, high, low, close, volume, amount FROM bars",
    BAR_D,
)
add(
    "s05_normalize_bars_alt",
    lambda m: normalize.normalize_bars_alt(_raw(m).withColumnsRenamed({"trade_date": "日期", "ts_code": "代码", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘", "vol": "成交量", "amount": "成交额"})),
    "SELECT trade_date, code, open, high, low, close, volume, amount / 1000 AS amount FROM bars",
    BAR_D,
)
add(
    "s03_normalize_stock_basic",
    lambda m: normalize.normalize_stock_basic(m.table("supplier").select(F.concat(F.lpad(c("s_suppkey").cast("string"), 6, "0"), F.lit(".SZ")).alias("ts_code"), c("s_name").alias("name"))).select("code", "name", "market", "board", "list_status"),
    "SELECT lpad(CAST(s_suppkey AS STRING), 6, '0') AS code, s_name AS name, 'SZ' AS market, CASE WHEN substr(lpad(CAST(s_suppkey AS STRING), 6, '0'), "
    "1, 3) IN ('000', '001', '002', '003') THEN 'main' ELSE 'other' END AS board, 'L' AS list_status FROM supplier",
)
add(
    "s06_normalize_trade_calendar",
    lambda m: normalize.normalize_trade_calendar(m.table("calendar")),
    "SELECT cal_date AS trade_date, exchange, CAST(is_open AS BIGINT) AS is_open FROM calendar",
)
add(
    "s07_normalize_daily_basic",
    lambda m: normalize.normalize_daily_basic(m.table("daily_basic")).select("trade_date", "code", "turnover_rate", "volume_ratio", "total_mv"),
    "SELECT trade_date, code, turnover_rate, volume_ratio, total_mv FROM daily_basic",
    "turnover_rate volume_ratio total_mv",
)
add(
    "s08_normalize_stock_limits",
    lambda m: normalize.normalize_stock_limits(m.table("stock_limits")),
    "SELECT trade_date, code, up_limit, down_limit FROM stock_limits",
    "up_limit down_limit",
)
add("s09_normalize_suspend", lambda m: normalize.normalize_suspend(m.table("suspend_daily")), "SELECT trade_date, code, suspend_type FROM suspend_daily")
add(
    "s10_normalize_index_daily",
    lambda m: normalize.normalize_index_daily(m.table("index_daily").withColumn("index_code", F.lower("index_code"))).select("trade_date", "index_code", "close", "pct_chg"),
    "SELECT trade_date, index_code, close, pct_chg FROM index_daily",
    "close pct_chg",
)
add(
    "s11_normalize_limit_list",
    lambda m: normalize.normalize_limit_list(m.table("limit_list_daily")).select("trade_date", "code", "limit_type", "open_times"),
    "SELECT trade_date, code, limit_type, CAST(open_times AS DOUBLE) AS open_times FROM limit_list_daily",
    "open_times",
)
add(
    "s12_normalize_moneyflow",
    lambda m: normalize.normalize_moneyflow(m.table("moneyflow")).select("trade_date", "code", "buy_lg_amount", "sell_elg_vol", "net_mf_amount"),
    "SELECT trade_date, code, buy_lg_amount, sell_elg_vol, net_mf_amount FROM moneyflow",
    "buy_lg_amount sell_elg_vol net_mf_amount",
)
add(
    "s13_normalize_industry_members",
    lambda m: normalize.normalize_industry_members(m.basic.select(c("code").alias("con_code"), c("industry").alias("index_code"), c("code").alias("_seq")), m.table("industry_map").select("industry_code", "industry_name")),
    "SELECT code, industry AS industry_code, industry AS industry_name FROM stock_basic",
)
add(
    "s13_normalize_industry_daily",
    lambda m: normalize.normalize_industry_daily(m.table("sw_daily")).select("trade_date", "industry_code", "industry_name", "close", "pct_change", "amount"),
    "SELECT trade_date, industry_code, industry_name, close, pct_change, amount FROM sw_daily",
    "close pct_change amount",
)
add(
    "s14_normalize_trades",
    lambda m: normalize.normalize_trades(m.trades.drop("amount").withColumn("side", F.upper("side"))).select("trade_date", "trade_time", "code", "side", "price", "volume", "amount"),
    "SELECT trade_date, trade_time, code, side, price, volume, price * volume AS amount FROM actual_trades",
    "price volume amount",
)
add(
    "s15_normalize_date_code",
    lambda m: m.table("orders").select("o_orderkey", fc.normalize_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("d"), fc.normalize_code(F.concat(F.lit("sz."), c("o_orderkey").cast("string"))).alias("code"), fc.exchange_suffix(F.lpad(c("o_orderkey").cast("string"), 6, "0")).alias("full_code")),
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, lpad(substr(CAST(o_orderkey AS STRING), 1, 6), 6, '0') AS code, f || CASE WHEN f[1] = '6' THEN "
    "'.SH' WHEN f[1] IN ('4', '8') THEN '.BJ' ELSE '.SZ' END AS full_code FROM (SELECT *, lpad(CAST(o_orderkey AS STRING), 6, '0') AS f FROM orders)",
)
add(
    "s16_derive_market_board",
    lambda m: normalize.derive_market_board(m.table("orders").select((c("o_orderkey") % 7 * 100000 + c("o_orderkey") % 1000).cast("string").alias("x")).select(F.lpad("x", 6, "0").alias("code")).distinct()),
    "SELECT DISTINCT code, CASE WHEN code[1] = '6' THEN 'SH' WHEN code[1] IN ('0', '3') THEN 'SZ' WHEN code[1] IN ('4', '8') THEN 'BJ' END AS market, "
    "CASE WHEN code[:3] IN ('688', '689') THEN 'STAR' WHEN code[:3] IN ('300', '301') THEN 'ChiNext' WHEN code[1] IN ('4', '8') THEN 'BJ' WHEN "
    "code[:3] IN ('000', '001', '002', '003', '600', '601', '603', '605') THEN 'main' ELSE 'other' END AS board FROM (SELECT lpad(CAST(o_orderkey % 7 "
    "* 100000 + o_orderkey % 1000 AS STRING), 6, '0') AS code FROM orders)",
)
def _merged(m: Market, old: DataFrame, keys: list[str], write, part=None) -> DataFrame:
    """A stored table that holds *old*, after one more write, read back."""
    table = KeyedTable(m.spark, store.scratch(m.spark), keys, part)
    table.merge(old)
    write(table)
    return table.read()


_odd_keys = lambda df: df.withColumn("k", F.nullif("k", F.lit(3)))
add("s17_upsert_by_key", lambda m: _merged(m, _half(m, False), ["k"], lambda t: t.merge(_half(m, True))), _UP, "v")
add(
    "s18_upsert_null_safe",
    lambda m: _merged(m, _odd_keys(_half(m, False)), ["k"], lambda t: t.merge(_odd_keys(_half(m, True)))).withColumn("k", c("k").cast("double")),
    f"SELECT nullif(k, 3) AS k, run_id, v FROM ({_UP})",
    "k v",
)
add(
    "s19_replace_scope",
    lambda m: _merged(m, _half(m, False), ["k"], lambda t: t.replace_scope(_half(m, True).where("run_id < 20"), ["run_id"])),
    f"SELECT * FROM ({_OLD}) WHERE run_id NOT IN (SELECT run_id FROM ({_NEW}) WHERE run_id < 20) UNION ALL SELECT * FROM ({_NEW}) WHERE run_id < 20",
    "v",
)
add("s20_upsert_run_scoped", lambda m: _merged(m, _half(m, False), ["k", "run_id"], lambda t: t.merge(_half(m, True))), _UP, "v")
add(
    "s21_delete_run",
    lambda m: _merged(m, _half(m, False).withColumn("run_id", c("run_id").cast("string")), ["k", "run_id"], lambda t: t.delete(c("run_id") == "7")),
    f"SELECT k, CAST(run_id AS VARCHAR) AS run_id, v FROM ({_OLD}) WHERE run_id <> 7",
    "v",
)
add(
    "s23_trading_dates",
    lambda m: store.trading_dates(m.table("calendar"), m.spark, "1995-01-01", "1996-12-31"),
    "SELECT cal_date AS trade_date FROM calendar WHERE cal_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'",
)


def _extended(m: Market):
    """Factors with the other tables; a run that adds to a stored table reads only their dates after its mark."""

    def enrich(built: DataFrame, since: str | None) -> DataFrame:
        late = lambda df: df if since is None else df.where(c("trade_date") > F.lit(since).cast("date"))
        return factors.enrich_factors(built, late(m.table("daily_basic")), late(m.table("stock_limits")), late(m.table("suspend_daily")), late(m.flow), m.table("industry_map"), late(m.industry))

    return enrich


def _incremental(m: Market) -> DataFrame:
    """Enriched factors from two runs against stored tables: one up to a date, one that adds the later dates."""
    bars = KeyedTable(m.spark, store.scratch(m.spark), ["trade_date", "code"], by_month())
    bars.merge(m.bars)
    table = increment.factor_table(store.scratch(m.spark), bars)
    increment.refresh_factors(bars, table, _extended(m), until=SPLIT)
    increment.refresh_factors(bars, table, _extended(m))
    return table.read()


def _overwritten(m: Market) -> DataFrame:
    """Plan results of two runs in one stored table by run; the second run is made again and replaces its own partition alone."""
    table = KeyedTable(m.spark, store.scratch(m.spark), ["run_id", "plan_id"], c("run_id"))
    first = m.plan_results.withColumn("run_id", F.lit("first"))
    table.merge(first.unionByName(m.plan_results.withColumn("run_id", F.lit("second"))))
    kept = research.filter_plans_by_candidates(m.expanded, _default_keys(m)).select("plan_id")
    table.replace_parts(table.read().where("run_id = 'second'").join(kept, "plan_id", "left_semi"))
    return table.read().groupBy("run_id").agg(F.count(F.lit(1)).alias("plans"), F.count_if("is_triggered").alias("triggered"), F.avg(F.when(c("is_valid"), c("return_pct"))).alias("avg_return"))


add("c17_incremental_factors", _incremental, "SELECT * FROM d_enriched", QUERIES["j01_enrich_factors"].doubles)
add(
    "c11_run_overwrite",
    _overwritten,
    " UNION ALL ".join(f"SELECT '{k}' AS run_id, count(*) AS plans, count_if(is_triggered) AS triggered, avg(CASE WHEN is_valid THEN return_pct END) AS avg_return FROM {t}" for k, t in (("first", "d_plan_results"), ("second", "d_again"))),
    "avg_return",
)
add(
    "c03_stage_counts",
    lambda m: candidates.plan_stage_counts(m.signals, m.enriched, m.basic, m.regime, m.evaluation),
    " UNION ALL ".join(f"SELECT '{k}' AS stage, count(*) AS rows, count(DISTINCT trade_date) AS dates FROM {t}" for k, t in (("signals", "d_signals"), ("pool", "d_signal_pool"), ("plans", "d_plans"))),
)


def _trades_csv(m: Market) -> DataFrame:
    """Trades written as CSV text and read back."""
    path = store.scratch(m.spark)
    m.trades.drop("name").write.option("header", True).csv(path)
    return store.read_trades_csv(m.spark, path).select("trade_date", "trade_time", "code", "side", "price", "volume", "amount")


def _replaced(m: Market) -> DataFrame:
    """A table written twice: the second write is all that is left."""
    path = store.scratch(m.spark)
    store.replace_all(m.table("calendar"), path)
    store.replace_all(m.bars.select("trade_date", "code", "close"), path)
    return store.read_table(m.spark, path)


def _active_config(m: Market) -> DataFrame:
    path = store.scratch(m.spark)
    store.write_active_config(m.named_evaluation.select("strategy_name", "strategy_version", "recommendation"), path, value="reduce_or_pause")
    return store.read_active_config(m.spark, path)


def _steady(factors_: DataFrame) -> DataFrame:
    """A rule of the caller's own."""
    kept = factors_.where((c("pct_chg_5d") > 0.02) & c("above_ma20") & (F.abs("pct_chg_1d") < 0.01))
    return kept.select("trade_date", "code", F.lit("steady").alias("strategy_name"), (c("pct_chg_5d") * 100).alias("signal_strength"))


add("s02_read_trades_csv", _trades_csv, "SELECT trade_date, trade_time, code, side, price, volume, amount FROM actual_trades", "price volume amount")
add("s22_replace_all", _replaced, "SELECT trade_date, code, close FROM bars", "close")
add(
    "s24_active_config",
    _active_config,
    "SELECT strategy_name, strategy_version, recommendation FROM d_named_evaluation WHERE recommendation = 'reduce_or_pause'",
)
add(
    "x01_own_rules",
    lambda m: signals.run_strategies(m.enriched, ["trend_pullback", _steady], o.OVERRIDES).select("trade_date", "code", "strategy_name", "strategy_version", "signal_strength"),
    "SELECT trade_date, code, strategy_name, strategy_version, signal_strength FROM d_signals WHERE strategy_name = 'trend_pullback' UNION ALL SELECT "
    "trade_date, code, 'steady', 'v1', pct_chg_5d * 100 FROM d_enriched WHERE pct_chg_5d > 0.02 AND above_ma20 AND abs(pct_chg_1d) < 0.01",
    SIGNAL_D,
)
add(
    "x02_enabled_rules",
    lambda m: signals.run_strategies(m.enriched, params=o.OVERRIDES, config={"support_rebound": {"enabled": False}, "low_vol_trend": {"enabled": True}}),
    "SELECT * FROM d_signals WHERE strategy_name IN ('trend_pullback', 'breakout_volume', 'low_vol_trend')",
    SIGNAL_D,
)
_optional = ["trade_date", "code", "close", "turnover_rate", "is_suspended", "moneyflow_score", "industry_code"]
add(
    "x04_optional_tables",
    lambda m: factors.enrich_factors(m.factors, None, m.table("stock_limits"), None, m.flow, None, None).select(*_optional, "up_limit"),
    "SELECT trade_date, code, close, CAST(NULL AS DOUBLE) AS turnover_rate, false AS is_suspended, moneyflow_score, CAST(NULL AS VARCHAR) AS "
    "industry_code, up_limit FROM d_enriched",
    "close moneyflow_score up_limit",
)
