"""Candidate pools and trade plans, for every date at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import append_flags, clip, contains_flag, fixed, holds, nearest, price, split_flags, zero

c = F.col

#: Weight of a recommendation and multiplier of a risk level; anything else counts 0.8.
RECOMMENDATION_WEIGHT = {"enable_observation": 1.20, "observe": 1.00, "continue_backtest": 0.80, "reduce_or_pause": 0.50, "pause": 0.00}
RISK_MULTIPLIER = {"low": 1.00, "medium": 0.85, "high": 0.60, "unknown": 0.80}

#: Entry, stop and targets as multiples of the close, and position sizes.
PLAN_PRICES = {
    "trend_pullback": dict(entry_low=0.975, entry_high=0.995, stop_loss=0.95, take_profit_1=1.04, take_profit_2=1.08, position_low=0.10, position_high=0.20),
    "breakout_watch": dict(entry_low=1.005, entry_high=1.025, stop_loss=0.97, take_profit_1=1.05, take_profit_2=1.10, position_low=0.05, position_high=0.15),
    "support_watch": dict(entry_low=0.96, entry_high=0.985, stop_loss=0.94, take_profit_1=1.035, take_profit_2=1.07, position_low=0.05, position_high=0.15),
}
ACTIONS = {"trend_pullback": "buy_pullback", "breakout_watch": "watch_breakout", "support_watch": "watch_support", "watch_only": "watch"}
INVALID = {"trend_pullback": "void on a gap up of 5 % or a close below the entry range", "breakout_watch": "void unless volume confirms; void on a fall below the last close", "support_watch": "void on a close below the stop", "watch_only": "no entry; wait for new confirmation"}
SETTLEMENT = "shares bought today can be sold from the next trading day on"
RISK_TEXT = [("suspended", "suspended"), ("limit_up_close", "closed at the upper limit"), ("limit_down_close", "closed at the lower limit"), ("market_high_risk", "weak market"), ("strong_main_outflow", "large outflow"), ("strong_main_inflow", "large inflow"), ("weak_industry", "weak industry"), ("strong_industry", "strong industry"), ("missing_industry_strength", "industry strength missing")]


def attach_stock_basic(df: DataFrame, basic: DataFrame) -> DataFrame:
    """Name, market and board of each code, from a dimension table that Spark broadcasts while it is small."""
    return df.join(basic.select("code", "name", "market", "board"), "code", "left")


def candidate_filter(df: DataFrame, min_amount: float = 0.0) -> DataFrame:
    move = c("pct_chg_1d")
    return df.where((c("close") > 0) & (c("amount_ma5") >= min_amount) & (move < 0.095) & (move > -0.095) & c("close_position_20").isNotNull() & (c("above_ma5") | c("above_ma10")))


def extension_filters(df: DataFrame, drop_suspended: bool = True, drop_limit_up: bool = False, drop_limit_down: bool = True, turnover: tuple[float | None, float | None] = (None, None), circ_mv: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Missing-data and status flags; drops suspended and limit closes by switch and rows outside the bounds (null passes)."""
    null = lambda *names: F.exists(F.array(*names), lambda x: x.isNull())
    base = c("risk_flags") if "risk_flags" in df.columns else F.lit("")
    marks = [(null("volume_ratio_daily_basic", "total_mv", "circ_mv"), "missing_daily_basic"), (null("total_mv", "circ_mv"), "missing_market_value"), (c("volume_ratio_daily_basic").isNull(), "missing_volume_ratio_daily_basic"), (c("turnover_rate").isNull(), "missing_turnover_rate"), (null("up_limit", "down_limit"), "missing_limit_data"), (c("is_suspended"), "suspended"), (c("is_limit_up_close"), "limit_up_close"), (c("is_limit_down_close"), "limit_down_close")]
    df = df.withColumn("risk_flags", append_flags(base, *marks))
    for on, name in ((drop_suspended, "is_suspended"), (drop_limit_up, "is_limit_up_close"), (drop_limit_down, "is_limit_down_close")):
        df = df.where(~holds(c(name))) if on else df
    for name, (low, high) in (("turnover_rate", turnover), ("circ_mv", circ_mv)):
        df = df if low is None else df.where(F.coalesce(c(name) >= low, F.lit(True)))
        df = df if high is None else df.where(F.coalesce(c(name) <= high, F.lit(True)))
    return df


# Fixed values of the functions below: weights of the score, points and levels.
def score_candidates(df: DataFrame) -> DataFrame:
    above = sum(c(f"above_ma{n}").cast("double") for n in (5, 10, 20))
    return df.withColumn("score", zero("pct_chg_5d") * 100 + zero("pct_chg_10d") * 50 + zero("close_position_20") * 20 + clip(zero("volume_ratio_5"), high=3) * 5 + above * 5)


def adjust_market_regime(df: DataFrame, regime: DataFrame) -> DataFrame:
    """regime: trade_date, market_regime, risk_level, one row per date (small: as many rows as dates)."""
    df = df.join(regime.select("trade_date", "market_regime", "risk_level"), "trade_date", "left")
    high = holds(F.lower("risk_level") == "high")
    points = F.when(high, -5.0).when(holds(F.lower("market_regime") == "strong"), 3.0).otherwise(0.0)
    return df.withColumns({"score": c("score") + points, "risk_flags": append_flags("risk_flags", (high, "market_high_risk"))})


def adjust_moneyflow(df: DataFrame) -> DataFrame:
    copied = [(contains_flag("moneyflow_risk_flags", f), f) for f in ("main_outflow", "strong_main_outflow", "strong_main_inflow", "missing_moneyflow")]
    marks = [(c("moneyflow_score").isNull(), "missing_moneyflow"), (c("moneyflow_score") > 20, "strong_main_inflow"), *copied]
    return df.withColumns({"score": c("score") + clip(zero("moneyflow_score"), -20, 30), "risk_flags": append_flags("risk_flags", *marks)})


def adjust_industry(df: DataFrame) -> DataFrame:
    level = F.lower(F.trim(F.coalesce("industry_strength_level", F.lit(""))))
    copied = [(contains_flag("industry_risk_flags", f), f) for f in ("strong_industry", "weak_industry", "shrinking_amount", "high_activity")]
    marks = [(c("industry_strength_score").isNull() & (level == ""), "missing_industry_strength"), (level == "strong", "strong_industry"), (level == "weak", "weak_industry"), *copied]
    points = F.when(level == "strong", 5.0).when(level == "weak", -5.0).otherwise(0.0)
    return df.withColumns({"score": c("score") + points, "risk_flags": append_flags("risk_flags", *marks)})


def rank_candidates(df: DataFrame, top_n: int = 20) -> DataFrame:
    order = Window.partitionBy("trade_date").orderBy(F.round("score", 9).desc(), "code")
    return df.withColumn("rank", F.row_number().over(order)).where(c("rank") <= top_n)


def select_candidates(factors: DataFrame, basic: DataFrame, regime: DataFrame, top_n: int = 20, min_amount: float = 0.0) -> DataFrame:
    """Top candidates of every date from factors alone."""
    df = attach_stock_basic(factors, basic).transform(candidate_filter, min_amount).transform(extension_filters).transform(score_candidates)
    return df.transform(adjust_market_regime, regime).transform(adjust_moneyflow).transform(adjust_industry).transform(rank_candidates, top_n)


def attach_evaluation(signals: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Recommendation and risk level of the signal's rule and version."""
    version = lambda: F.when(F.coalesce("strategy_version", F.lit("")) == "", "v1").otherwise(c("strategy_version"))
    own = evaluation.withColumn("strategy_version", version()).select("strategy_name", "strategy_version", "recommendation", "risk_level")
    return signals.withColumn("strategy_version", version()).join(own, ["strategy_name", "strategy_version"], "left")


def strategy_weight(recommendation: Column, risk: Column) -> Column:
    look = lambda table, key: F.coalesce(*[F.when(F.trim(key) == k, F.lit(v)) for k, v in table.items()], F.lit(0.8))
    return look(RECOMMENDATION_WEIGHT, recommendation) * look(RISK_MULTIPLIER, risk)


def _joined(value: str, on: str) -> Column:
    """Distinct non-empty values in order of rule and version, comma-joined."""
    items = F.array_sort(F.collect_list(F.when(c(on) & (F.coalesce(value, F.lit("")) != ""), F.struct("strategy_name", "strategy_version", c(value).alias("v")))))
    return F.array_join(F.array_distinct(F.transform(items, lambda x: x["v"])), ",")


def aggregate_signals(signals: DataFrame) -> DataFrame:
    """Signals of a date and code in one row; signals need strategy_weight, recommendation and risk_level."""
    df = signals.withColumns({"active": c("strategy_weight") > 0, "weighted": zero("signal_strength") * c("strategy_weight"), "all": F.lit(True)})
    marks = F.array_sort(F.collect_list(F.struct("strategy_name", "strategy_version", "risk_flags")))
    risk = F.array_distinct(F.flatten(F.transform(marks, lambda x: split_flags(x["risk_flags"]))))
    return df.groupBy("trade_date", "code").agg(F.count("strategy_name").alias("signal_count"), F.count_if("active").alias("active_signal_count"), F.max("signal_strength").alias("max_signal_strength"), F.sum("signal_strength").alias("total_signal_strength"), F.sum("weighted").alias("total_weighted_signal_strength"), F.avg("strategy_weight").alias("avg_strategy_weight"), _joined("strategy_name", "active").alias("strategy_names"), _joined("strategy_version", "active").alias("strategy_versions"), _joined("recommendation", "active").alias("recommendations"), _joined("entry_reason", "active").alias("reason"), F.array_join(risk, ",").alias("risk_flags"))


def candidate_reason(df: DataFrame) -> DataFrame:
    part = lambda label, x: F.when(x != "", F.concat(F.lit(label), x))
    source = F.when((c("strategy_names") != "") | (c("strategy_versions") != ""), F.concat(F.lit("versions: "), c("strategy_names"), F.lit(" / "), c("strategy_versions")))
    return df.withColumn("reason", F.concat_ws("; ", source, part("evaluation: ", c("recommendations")), part("", c("reason"))))


SLICE = ["close", "pct_chg_1d", "pct_chg_3d", "pct_chg_5d", "pct_chg_10d", "volume_ratio_5", "close_position_20", "above_ma5", "above_ma10", "above_ma20", "amount_ma5", "turnover_rate", "volume_ratio_daily_basic", "total_mv", "circ_mv", "up_limit", "down_limit", "is_suspended", "is_limit_up_close", "is_limit_down_close", "moneyflow_score", "moneyflow_risk_flags", "industry_strength_score", "industry_strength_level", "industry_risk_flags"]


def select_candidates_from_signals(signals: DataFrame, factors: DataFrame, basic: DataFrame, regime: DataFrame, evaluation: DataFrame | None = None, top_n: int = 20, min_amount: float = 0.0) -> DataFrame:
    """Top candidates of every date from rule signals, weighted by their evaluation; all weigh 1 without one."""
    if evaluation is None:
        df = signals.withColumns({"recommendation": F.lit(""), "risk_level": F.lit(""), "strategy_weight": F.lit(1.0)})
    else:
        df = attach_evaluation(signals, evaluation).withColumn("strategy_weight", strategy_weight(c("recommendation"), c("risk_level")))
    df = aggregate_signals(df).where("active_signal_count > 0").transform(candidate_reason)
    df = df.join(factors.select("trade_date", "code", *SLICE), ["trade_date", "code"], "left").transform(attach_stock_basic, basic)
    df = df.where(c("amount_ma5") >= min_amount).transform(extension_filters)
    df = df.withColumn("score", zero("total_weighted_signal_strength") + c("active_signal_count") * 10)
    return df.transform(adjust_market_regime, regime).transform(adjust_moneyflow).transform(adjust_industry).transform(rank_candidates, top_n)


def classify_plan(df: DataFrame) -> DataFrame:
    """Plan type and action from flags and factors, the first rule that fits."""
    risk, position = split_flags("risk_flags"), c("close_position_20")
    barred = F.array_contains(risk, "suspended") | F.array_contains(risk, "limit_down_close")
    kind = F.when(barred, "watch_only").when(holds(c("above_ma5") & c("above_ma10") & (position >= 0.6)), "trend_pullback").when(holds((c("pct_chg_5d") > 0.05) & (c("volume_ratio_5") >= 1.2) & (position >= 0.7)), "breakout_watch").when(holds((c("pct_chg_1d") < -0.03) & c("above_ma20")), "support_watch").otherwise("watch_only")
    action = F.coalesce(*[F.when(c("strategy_type") == k, v) for k, v in ACTIONS.items()])
    return df.withColumn("strategy_type", kind).withColumn("action", action)


def plan_prices(df: DataFrame) -> DataFrame:
    def pick(name: str, scaled: bool) -> Column:
        options = [F.when(c("strategy_type") == k, price(c("close") * v[name]) if scaled else F.lit(v[name])) for k, v in PLAN_PRICES.items()]
        return F.coalesce(*options, *([] if scaled else [F.lit(0.0)]))

    prices = {n: pick(n, True) for n in ("entry_low", "entry_high", "stop_loss", "take_profit_1", "take_profit_2")}
    return df.withColumns(prices | {n: pick(n, False) for n in ("position_low", "position_high")})


def plan_text(df: DataFrame) -> DataFrame:
    """Condition that voids the plan, settlement note, and a reason with figures."""
    figure = lambda x, s="": F.when(x.isNull(), "NA").otherwise(F.concat(fixed(x), F.lit(s)))
    void = F.coalesce(*[F.when(c("strategy_type") == k, v) for k, v in INVALID.items()])
    risk = F.array_join(F.array_compact(F.array(*[F.when(contains_flag("risk_flags", f), t) for f, t in RISK_TEXT])), "; ")
    own = c("reason") if "reason" in df.columns else F.lit(None)
    text = F.concat(F.coalesce(own, F.lit("in the candidate pool")), F.lit("; score="), figure(c("score")), F.lit(", 5d="), figure(c("pct_chg_5d") * 100, "%"), F.lit(", volume ratio="), figure(c("volume_ratio_5")), F.lit(", position="), figure(c("close_position_20")))
    return df.withColumns({"invalid_condition": void, "t_plus_1_risk": F.lit(SETTLEMENT), "plan_reason": F.concat_ws(". ", text, F.nullif(risk, F.lit("")))})


PLAN = ["trade_date", "code", "name", "rank", "strategy_names", "strategy_versions", "active_signal_count", "avg_strategy_weight", "recommendations", "risk_flags", "close", "strategy_type", "action", "entry_low", "entry_high", "position_low", "position_high", "stop_loss", "take_profit_1", "take_profit_2", "invalid_condition", "t_plus_1_risk", "plan_reason"]


def generate_trade_plan(pool: DataFrame, max_items: int = 5) -> DataFrame:
    df = pool.where(c("rank") <= max_items)
    missing = {n: F.lit(None).cast(t) for n, t in (("name", "string"), ("strategy_names", "string"), ("strategy_versions", "string"), ("recommendations", "string"), ("active_signal_count", "bigint"), ("avg_strategy_weight", "double")) if n not in df.columns}
    df = df.withColumns(missing) if missing else df
    df = df.transform(classify_plan).transform(plan_prices).transform(plan_text)
    return df.withColumns({"close": price(c("close")), "avg_strategy_weight": nearest(c("avg_strategy_weight"), 4)}).select(*PLAN)


def plan_stage_counts(signals: DataFrame, factors: DataFrame, basic: DataFrame, regime: DataFrame, evaluation: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Rows and dates of every stage of a plan build, one row per stage, observed while the plans are written to *path* (or nowhere):
    no stage is computed for the sake of its count."""
    seen = {n: Observation(n) for n in ("signals", "pool", "plans")}
    watch = lambda df, n: df.observe(seen[n], F.count(F.lit(1)).alias("rows"), F.size(F.collect_set("trade_date")).cast("bigint").alias("dates"))
    pool = watch(select_candidates_from_signals(watch(signals, "signals"), factors, basic, regime, evaluation), "pool")
    plans = watch(generate_trade_plan(pool), "plans").write.mode("overwrite")
    plans.parquet(path) if path else plans.format("noop").save()
    return signals.sparkSession.createDataFrame([(n, o.get["rows"], o.get["dates"]) for n, o in seen.items()], "stage string, rows bigint, dates bigint")
