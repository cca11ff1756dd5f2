"""Rule parameters: defaults, named versions and the search grid."""

from __future__ import annotations

from itertools import islice, product

from pyspark.sql import DataFrame, SparkSession

_COMMON = {"min_amount_ma5": 10000.0, "min_turnover_rate": 0.3}

#: Rule defaults.  Amounts are in thousand yuan.
DEFAULTS: dict[str, dict] = {
    "trend_pullback": {"min_pct_chg_5d": 0.03, "max_pct_chg_1d": 0.06, "min_close_position_20": 0.55, "min_volume_ratio_5": 1.0, "require_above_ma5": True, "require_above_ma10": True},
    "breakout_volume": {"min_pct_chg_5d": 0.05, "min_volume_ratio_5": 1.3, "min_close_position_20": 0.70, "max_pct_chg_1d": 0.095, "require_above_ma5": True},
    "support_rebound": {"min_pct_chg_1d": -0.095, "max_pct_chg_1d": -0.02, "min_close_position_20": 0.35, "max_close_position_20": 0.75, "require_above_ma20": True, "min_amount_ma5": 0.0},
    "industry_rotation": _COMMON | {"min_industry_strength_score": 60.0, "min_industry_return_3d": 0.0, "min_industry_return_5d": 0.015, "min_industry_amount_ratio_5": 0.9, "min_pct_chg_5d": 0.015, "min_close_position_20": 0.55, "min_moneyflow_score": 0.0, "max_pct_chg_3d": 0.10, "max_pct_chg_5d": 0.14, "max_close_position_20": 0.90, "min_relative_strength_5d": 0.015},
    "moneyflow_accumulation": _COMMON | {"min_moneyflow_score": 12.0, "min_main_net_amount_ratio": 2.0, "min_pct_chg_1d": -0.03, "max_pct_chg_1d": 0.05, "max_pct_chg_3d": 0.08, "min_pct_chg_5d": -0.04, "max_pct_chg_5d": 0.10, "max_turnover_rate": 8.0},
    "low_vol_trend": _COMMON | {"require_above_ma5": True, "require_above_ma10": True, "require_above_ma20": True, "min_pct_chg_5d": 0.01, "max_pct_chg_5d": 0.10, "max_abs_pct_chg_3d": 0.06, "max_abs_pct_chg_1d": 0.035, "max_pct_chg_1d": 0.03, "min_close_position_20": 0.45, "max_close_position_20": 0.88, "min_volume_ratio_5": 0.7, "max_volume_ratio_5": 1.8, "max_turnover_rate": 6.0},
    "oversold_rebound": _COMMON | {"min_pct_chg_3d": -0.09, "max_pct_chg_3d": -0.015, "min_pct_chg_5d": -0.14, "min_pct_chg_10d": -0.22, "min_close_position_20": 0.12, "max_close_position_20": 0.60, "min_moneyflow_score": 3.0, "min_industry_strength_score": 45.0, "max_down_pct_chg_3d": -0.10, "max_down_pct_chg_5d": -0.16, "max_down_pct_chg_10d": -0.25},
    "volume_dryup_breakout": _COMMON | {"require_above_ma5": True, "require_above_ma10": True, "min_volume_ratio_5": 0.85, "max_volume_ratio_5": 1.8, "min_volume_ratio_daily_basic": 1.0, "max_volume_ratio_daily_basic": 2.2, "min_pct_chg_1d": 0.01, "max_pct_chg_1d": 0.065, "max_pct_chg_3d": 0.10, "min_close_position_20": 0.60, "confirm_min_close_position_20": 0.70},
    "relative_strength_pullback": _COMMON | {"require_above_ma10": True, "require_above_ma20": True, "min_relative_strength_5d": 0.015, "min_pct_chg_10d": 0.02, "min_pct_chg_5d": -0.02, "max_pct_chg_5d": 0.07, "min_close_position_20": 0.35, "max_close_position_20": 0.85, "min_industry_strength_score": 50.0, "min_moneyflow_score": 5.0},
}

#: The branch a named version takes beside its parameters, and what it changes of the defaults.
NAMED: dict[str, dict[str, dict]] = {
    "trend_pullback": {"v1": {}, "v2_conservative": {"min_pct_chg_5d": 0.05, "max_pct_chg_1d": 0.04, "min_close_position_20": 0.50}, "v3_loose": {"min_pct_chg_5d": 0.02, "max_pct_chg_1d": 0.08, "min_close_position_20": 0.45, "min_volume_ratio_5": 0.8, "require_above_ma10": False}},
    "breakout_volume": {"v1": {}, "v2_no_chase": {"min_pct_chg_5d": 0.04, "min_volume_ratio_5": 1.5, "min_close_position_20": 0.65, "max_pct_chg_1d": 0.06}},
    "support_rebound": {"v1": {}, "v2_strict_support": {"min_pct_chg_1d": -0.07, "max_pct_chg_1d": -0.025, "min_close_position_20": 0.40, "max_close_position_20": 0.70}},
    "industry_rotation": {"v1_strength_follow": {}, "v2_no_overheat": {"min_industry_strength_score": 62.0, "min_industry_return_5d": 0.012, "min_pct_chg_5d": 0.01, "min_close_position_20": 0.50, "max_pct_chg_3d": 0.07, "max_pct_chg_5d": 0.10, "max_close_position_20": 0.85}, "v3_industry_leader": {"min_industry_strength_score": 58.0, "min_industry_return_5d": 0.01, "min_pct_chg_5d": 0.02, "min_moneyflow_score": 3.0, "min_relative_strength_5d": 0.02}},
    "moneyflow_accumulation": {"v1_main_inflow": {}, "v2_big_order_confirm": {"min_moneyflow_score": 10.0, "min_main_net_amount_ratio": 1.0, "max_pct_chg_1d": 0.055, "max_pct_chg_5d": 0.11}, "v3_price_not_chased": {"min_main_net_amount_ratio": 1.5, "min_pct_chg_1d": -0.025, "max_pct_chg_1d": 0.035, "max_pct_chg_3d": 0.055, "max_pct_chg_5d": 0.07, "max_turnover_rate": 6.0}},
    "low_vol_trend": {"v1_ma_alignment": {}, "v2_low_chase": {"min_pct_chg_5d": 0.005, "max_pct_chg_5d": 0.08, "max_abs_pct_chg_3d": 0.05, "max_abs_pct_chg_1d": 0.03, "max_pct_chg_1d": 0.025, "min_close_position_20": 0.42, "max_close_position_20": 0.82, "max_volume_ratio_5": 1.6}, "v3_steady_volume": {"min_turnover_rate": 0.5, "max_pct_chg_5d": 0.09, "max_abs_pct_chg_3d": 0.05, "max_abs_pct_chg_1d": 0.03, "max_close_position_20": 0.85, "min_volume_ratio_5": 0.8, "max_volume_ratio_5": 1.5, "max_turnover_rate": 5.0}},
    "oversold_rebound": {"v1_mild_oversold": {}, "v2_moneyflow_repair": {"min_pct_chg_3d": -0.10, "max_pct_chg_3d": -0.01, "min_pct_chg_5d": -0.15, "min_close_position_20": 0.10, "max_close_position_20": 0.58, "min_moneyflow_score": 5.0}, "v3_industry_repair": {"min_pct_chg_3d": -0.10, "max_pct_chg_3d": -0.01, "min_pct_chg_5d": -0.15, "min_close_position_20": 0.10, "min_industry_strength_score": 50.0}},
    "volume_dryup_breakout": {"v1_dryup_recover": {}, "v2_breakout_confirm": {"min_volume_ratio_5": 1.0, "max_volume_ratio_5": 2.0, "min_volume_ratio_daily_basic": 1.1, "max_volume_ratio_daily_basic": 2.4, "min_pct_chg_1d": 0.015, "max_pct_chg_1d": 0.07, "max_pct_chg_3d": 0.11, "min_close_position_20": 0.65, "confirm_min_close_position_20": 0.72}},
    "relative_strength_pullback": {"v1_rs_pullback": {}, "v2_industry_strong_pullback": {"min_relative_strength_5d": 0.01, "min_pct_chg_5d": -0.025, "max_pct_chg_5d": 0.065, "min_close_position_20": 0.32, "max_close_position_20": 0.82, "min_industry_strength_score": 55.0}, "v3_moneyflow_confirm": {"min_relative_strength_5d": 0.01, "min_pct_chg_5d": -0.025, "max_pct_chg_5d": 0.065, "min_close_position_20": 0.32, "max_close_position_20": 0.82, "min_moneyflow_score": 8.0}},
}

#: Per rule the number of combinations taken, what differs from the defaults, and the values searched, the last
#: key varying fastest.
SEARCH: dict[str, tuple[int, dict, dict[str, list[float]]]] = {
    "trend_pullback": (50, {}, {"min_pct_chg_5d": [0.02, 0.03, 0.05], "max_pct_chg_1d": [0.04, 0.06, 0.08], "min_close_position_20": [0.45, 0.55, 0.65], "min_volume_ratio_5": [0.8, 1.0, 1.2]}),
    "breakout_volume": (40, {}, {"min_pct_chg_5d": [0.04, 0.05, 0.08], "min_volume_ratio_5": [1.2, 1.5, 2.0], "min_close_position_20": [0.65, 0.75, 0.85], "max_pct_chg_1d": [0.06, 0.08, 0.095]}),
    "support_rebound": (40, {}, {"min_pct_chg_1d": [-0.095, -0.07], "max_pct_chg_1d": [-0.02, -0.025, -0.03], "min_close_position_20": [0.30, 0.35, 0.40], "max_close_position_20": [0.70, 0.75, 0.80]}),
    "industry_rotation": (24, {}, {"min_industry_strength_score": [58.0, 62.0, 66.0], "min_industry_return_5d": [0.01, 0.015], "min_pct_chg_5d": [0.01, 0.02], "min_relative_strength_5d": [0.01, 0.02]}),
    "moneyflow_accumulation": (24, {}, {"min_moneyflow_score": [10.0, 12.0, 15.0], "min_main_net_amount_ratio": [1.5, 2.0, 3.0], "max_pct_chg_1d": [0.035, 0.05], "max_pct_chg_5d": [0.07, 0.10]}),
    "low_vol_trend": (20, {}, {"min_pct_chg_5d": [0.005, 0.01], "max_pct_chg_5d": [0.08, 0.10], "max_abs_pct_chg_3d": [0.05, 0.06], "max_abs_pct_chg_1d": [0.03, 0.035], "max_close_position_20": [0.82, 0.88], "max_volume_ratio_5": [1.5, 1.8]}),
    "oversold_rebound": (24, {}, {"min_pct_chg_3d": [-0.10, -0.08], "max_pct_chg_3d": [-0.01, -0.015, -0.02], "min_pct_chg_5d": [-0.15, -0.12], "min_close_position_20": [0.10, 0.15], "max_close_position_20": [0.55, 0.60]}),
    "volume_dryup_breakout": (20, {}, {"min_volume_ratio_5": [0.85, 1.0], "max_volume_ratio_5": [1.8, 2.0], "min_pct_chg_1d": [0.01, 0.015], "max_pct_chg_1d": [0.06, 0.07], "min_close_position_20": [0.60, 0.70]}),
    "relative_strength_pullback": (24, {}, {"min_relative_strength_5d": [0.01, 0.015, 0.02], "min_pct_chg_10d": [0.015, 0.02], "min_pct_chg_5d": [-0.025, -0.015], "max_pct_chg_5d": [0.06, 0.07], "min_close_position_20": [0.32, 0.38], "max_close_position_20": [0.82, 0.86]}),
}
PARAMS = sorted({p for d in DEFAULTS.values() for p in d})


def named_versions(overrides: dict | None = None, named: dict[str, dict[str, dict]] = NAMED) -> list[dict]:
    """Rows name, version, branch and all parameters; the version's own name is its branch.

    *overrides* go on top of every version, for data in other units.  A version of *named* with "enabled": False is left out."""
    return [_row(rule, v, v, changes | (overrides or {})) for rule, versions in named.items() for v, changes in versions.items() if changes.get("enabled", True)]


def grid(search: dict = SEARCH, overrides: dict | None = None, limit_rules: int | None = None, limit_each: int | None = None) -> list[dict]:
    """Ordered product of the searched values per rule, cut at the rule's number of combinations; numbered versions take no
    branch."""
    out = []
    for rule, (most, base, space) in islice(search.items(), limit_rules):
        most = min(most, limit_each) if limit_each else most
        for i, values in enumerate(islice(product(*space.values()), most), 1):
            out.append(_row(rule, f"search_{i:03d}", "", base | dict(zip(space, values)) | (overrides or {})))
    return out


def _row(rule: str, version: str, branch: str, changes: dict) -> dict:
    own = DEFAULTS[rule] | {k: v for k, v in changes.items() if k in DEFAULTS[rule]}
    return {"strategy_name": rule, "strategy_version": version, "branch": branch} | {p: None if own.get(p) is None else float(own[p]) for p in PARAMS}


def version_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """As many rows as there are versions, a few hundred: broadcast by rule."""
    schema = "strategy_name string, strategy_version string, branch string, " + ", ".join(f"p_{p} double" for p in PARAMS)
    return spark.createDataFrame([(r["strategy_name"], r["strategy_version"], r["branch"], *[r[p] for p in PARAMS]) for r in rows], schema)
