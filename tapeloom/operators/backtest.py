"""Backtests of signals and plans: next-bar entry and holding windows by row number, never bars times signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import dimension_list, holds
from tapeloom.operators.factors import by_code
from tapeloom.operators.orderstats import with_medians

c = F.col
HORIZONS = (1, 3, 5)

#: Holding days tried per rule; other rules take DEFAULT_DAYS.
HOLDING_DAYS = {
    "oversold_rebound": [3, 5, 8], "support_rebound": [3, 5, 8, 10], "volume_dryup_breakout": [3, 5, 8, 10, 15], "breakout_volume": [3, 5, 8, 10, 15],
    "trend_pullback": [5, 8, 10, 15, 20], "relative_strength_pullback": [5, 8, 10, 15, 20], "moneyflow_accumulation": [5, 10, 15, 20],
    "low_vol_trend": [10, 15, 20, 30], "industry_rotation": [10, 15, 20, 30],
}
DEFAULT_DAYS = 5


def next_bar(events: DataFrame, bars: DataFrame, payload: list[str], date: str = "trade_date", same_day: bool = False) -> DataFrame:
    """Forward as-of join: each event with the first bar of its code after its date (or on it), as struct ``bar``.

    Union of both sides and one sort per code, read backwards, so that the last bar seen is the next one; no range join.  The new name of
    the code lets Spark see that both sides of a union are dealt alike: sides that are stored in as many buckets by code meet without a shuffle."""
    rows = bars.select(c("code").alias("_code"), c("trade_date").alias("_at"), F.struct("trade_date", *payload).alias("bar"), F.lit(0 if not same_day else 1).alias("_event"))
    asked = events.select(c("code").alias("_code"), c(date).alias("_at"), F.struct(*events.columns).alias("_row"), F.lit(1 if not same_day else 0).alias("_event"))
    both = rows.unionByName(asked, allowMissingColumns=True)
    ahead = Window.partitionBy("_code").orderBy(c("_at").desc(), c("_event").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("bar", F.last("bar", ignorenulls=True).over(ahead)).where("_row is not null").select("_row.*", "bar")


def forward_returns(bars: DataFrame) -> DataFrame:
    """Per bar: entry at its open, exits k bars later, lowest low from the bar to the exit."""
    out = {"entry_open": c("open")}
    for k in HORIZONS:
        whole = F.lead("close", k).over(by_code())
        low = F.min("low").over(by_code().rowsBetween(0, k))
        out[f"exit_close_{k}d"], out[f"low_{k}d"] = whole, F.when(F.lead(F.lit(1), k).over(by_code()) == 1, low)
    return bars.withColumns(out)


def signal_backtest(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Next-open entry, close exits after 1, 3 and 5 bars, and drawdowns; or the reason why there are none."""
    known = bars.select("code").distinct().withColumn("_has", F.lit(True))
    returns = forward_returns(bars)
    payload = ["entry_open", *[f"{x}_{k}d" for k in HORIZONS for x in ("exit_close", "low")]]
    # Versions that signal the same code on the same date share one entry.
    at = ["trade_date", "code"]
    entries = next_bar(signals.select(*at).distinct(), returns, payload).join(known, "code", "left")
    df = signals.join(entries, at, "left")
    entry = c("bar.entry_open")
    reason = F.when(c("_has").isNull(), "no_daily_bars_for_code").when(c("bar").isNull(), "no_next_trading_day").when(~holds(entry != 0), "invalid_entry_open").when(c(f"bar.exit_close_{HORIZONS[-1]}d").isNull(), "insufficient_future_bars").otherwise("")
    df = df.withColumns({"invalid_reason": reason, "is_valid": reason == "", "entry_date": c("bar.trade_date"), "entry_open": entry})
    for k in HORIZONS:
        ok = holds(entry != 0)
        df = df.withColumns({f"return_{k}d": F.when(ok, F.try_divide(c(f"bar.exit_close_{k}d"), entry) - 1), f"max_drawdown_{k}d": F.when(ok, F.try_divide(c(f"bar.low_{k}d"), entry) - 1)})
    return df.select(c("trade_date").alias("signal_date"), "code", "strategy_name", "strategy_version", "signal_strength", "entry_date", "entry_open", *[f"{x}_{k}d" for k in HORIZONS for x in ("return", "max_drawdown")], "is_valid", "invalid_reason")


def signal_performance(results: DataFrame, keys: tuple[str, ...] = ("strategy_name", "strategy_version"), medians: bool = True) -> DataFrame:
    """Counts, win rates, means, exact medians and drawdowns of valid rows; groups without one are kept.

    Medians read the results a second time; callers that need none leave them out."""
    aggs = [F.count(F.lit(1)).alias("sample_count"), F.count_if("is_valid").alias("valid_count")]
    for k in HORIZONS:
        r = F.when(c("is_valid"), c(f"return_{k}d"))
        aggs += [F.avg((r > 0).cast("double")).alias(f"win_rate_{k}d"), F.avg(r).alias(f"avg_return_{k}d"), F.avg(F.when(c("is_valid"), c(f"max_drawdown_{k}d"))).alias(f"avg_max_drawdown_{k}d")]
    if not medians:
        return results.groupBy(*keys).agg(*aggs)
    values = {f"median_return_{k}d": F.when(c("is_valid"), c(f"return_{k}d")) for k in HORIZONS}
    return with_medians(results.groupBy(*keys).agg(*aggs), results, list(keys), values)


def holding_days(names: Column) -> Column:
    """Ascending union of the holding days of the rules named in a composite text."""
    grids = F.transform(dimension_list(names), lambda n: F.coalesce(*[F.when(n == k, F.array(*map(F.lit, v))) for k, v in HOLDING_DAYS.items()], F.array(F.lit(DEFAULT_DAYS))))
    union = F.array_sort(F.array_distinct(F.flatten(grids)))
    return F.when(F.size(union) > 0, union).otherwise(F.array(F.lit(DEFAULT_DAYS)))


def expand_holding_days(plans: DataFrame, mode: str = "strategy_grid", days: int = DEFAULT_DAYS) -> DataFrame:
    if mode not in ("fixed", "strategy_grid"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "fixed":
        return plans.withColumn("max_holding_days", F.lit(max(1, days)))
    return plans.withColumn("max_holding_days", F.explode(holding_days(F.coalesce("strategy_names", "strategy_type"))))


def bars_for_plans(bars: DataFrame, plans: DataFrame) -> DataFrame:
    return bars.join(plans.select("code").distinct(), "code", "left_semi")


#: What decides a plan's entry and its first stop or target; plans that agree in it differ in their holding days alone.
TERMS = ["trade_date", "code", "action", "entry_low", "entry_high", "stop_loss", "take_profit_1", "take_profit_2"]


def plan_backtest(plans: DataFrame, bars: DataFrame) -> DataFrame:
    """Entry on the bar after the plan if its range is touched; the first stop or target, else the last bar of the window.

    Plans of the same terms are followed once, over their longest window: bars are numbered per code, the window's numbers are joined with
    them, and running extremes and the first hit stream over its bars.  Each plan then reads the one row at which it ends.
    plans need a key column plan_id and max_holding_days."""
    whole = bars.where("open is not null and high is not null and low is not null and close is not null").withColumn("rn", F.row_number().over(by_code()))
    terms = plans.groupBy(F.struct(*TERMS).alias("_terms")).agg(F.min("plan_id").alias("_lead"), F.max("max_holding_days").alias("_days"))
    df = next_bar(terms.select("_terms.*", "_terms", "_lead", "_days"), whole, ["open", "high", "low", "rn"])
    low, high, op = c("bar.low"), c("bar.high"), c("bar.open")
    watch = (c("action") == "watch") | c("entry_low").isNull() | c("entry_high").isNull()
    reason = F.when(watch, "watch_only_or_no_entry_range").when(c("bar").isNull(), "no_next_trading_day").when(low > c("entry_high"), "gap_above_entry_range").when(high < c("entry_low"), "not_reach_entry_range").otherwise("")
    entry = F.when(op.between(c("entry_low"), c("entry_high")), op).when(op < c("entry_low"), c("entry_low")).otherwise(c("entry_high"))
    df = df.withColumns({"invalid_reason": reason, "is_triggered": reason == "", "entry_date": F.when(~watch, c("bar.trade_date")), "entry_price": F.when(reason == "", entry)})

    held = df.where("is_triggered").select("_lead", "code", "stop_loss", "take_profit_1", "take_profit_2", c("bar.rn").alias("first"), F.explode(F.sequence(c("bar.rn"), c("bar.rn") + c("_days") - 1)).alias("rn"))
    held = held.join(whole.select("code", "rn", c("trade_date").alias("d"), "high", "low", "close"), ["code", "rn"])
    hit = F.when(holds(c("low") <= c("stop_loss")), "stop_loss").when(holds(c("high") >= c("take_profit_2")), "take_profit_2").when(holds(c("high") >= c("take_profit_1")), "take_profit_1")
    so_far = Window.partitionBy("_lead").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("hit", hit).withColumns({"low_": F.min("low").over(so_far), "high_": F.max("high").over(so_far), "hits": F.count("hit").over(so_far)})
    # Up to the first hit: a window ends at the last of these rows that it reaches.
    held = held.where((c("hits") == 0) | (c("hits") == 1) & c("hit").isNotNull()).withColumn("n", (c("rn") - c("first") + 1).cast("int"))
    last = F.max("n").over(Window.partitionBy("_lead"))
    held = held.withColumn("last", last).select(c("_lead").alias("_path"), "n", "last", F.struct(c("d").alias("exit_date"), "hit", "close", "low_", "high_").alias("x"))

    ends = held.groupBy("_path").agg(F.max("last").alias("last"))
    df = plans.withColumn("_terms", F.struct(*TERMS)).join(df.select("_terms", "_lead", "invalid_reason", "is_triggered", "entry_date", "entry_price"), "_terms", "left")
    df = df.join(ends, c("_lead") == c("_path"), "left").drop("_path").withColumn("holding_days", F.when(c("last").isNotNull(), F.least("last", c("max_holding_days"))).cast("int"))
    df = df.join(held.select("_path", "n", "x"), (c("_lead") == c("_path")) & (c("holding_days") == c("n")), "left")
    df = df.withColumns({"exit_date": c("x.exit_date"), "exit_reason": F.when(c("holding_days").isNotNull(), F.coalesce("x.hit", F.lit("time_exit")))})
    out_price = F.when(c("exit_reason") == "stop_loss", c("stop_loss")).when(c("exit_reason") == "take_profit_2", c("take_profit_2")).when(c("exit_reason") == "take_profit_1", c("take_profit_1")).otherwise(c("x.close"))
    rel = lambda x: F.try_divide(x, c("entry_price")) - 1
    df = df.withColumns({"exit_price": F.when(c("is_triggered"), out_price), "is_valid": c("is_triggered") & c("holding_days").isNotNull()})
    df = df.withColumns({"return_pct": rel(c("exit_price")), "max_drawdown": rel(c("x.low_")), "max_favorable": rel(c("x.high_"))})
    new = ["invalid_reason", "is_triggered", "entry_date", "entry_price", "holding_days", "exit_date", "exit_reason", "exit_price", "is_valid", "return_pct", "max_drawdown", "max_favorable"]
    return df.select(*plans.columns, *new)


def plan_performance(results: DataFrame, keys: tuple[str, ...] = ("strategy_names", "strategy_versions", "action", "max_holding_days")) -> DataFrame:
    """Trigger, win and exit rates, means and medians by composite strategy, action and holding days."""
    df = results.withColumns({k: F.coalesce(k, F.lit("")) for k in keys if dict(results.dtypes)[k] == "string"})
    ok = lambda x: F.when(c("is_valid"), x)
    rate = lambda *names: F.avg(ok(c("exit_reason").isin(*names).cast("double")))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("plan_count"), F.count_if("is_triggered").alias("triggered_count"), F.count_if("is_valid").alias("valid_count"), F.avg(c("is_triggered").cast("double")).alias("trigger_rate"), F.avg(ok((c("return_pct") > 0).cast("double"))).alias("win_rate"), F.avg(ok(c("return_pct"))).alias("avg_return"), F.avg(ok(c("max_drawdown"))).alias("avg_max_drawdown"), F.avg(ok(c("max_favorable"))).alias("avg_max_favorable"), rate("stop_loss").alias("stop_loss_rate"), rate("take_profit_1", "take_profit_2").alias("take_profit_rate"), rate("time_exit").alias("time_exit_rate"))
    return with_medians(out, df, list(keys), {"median_return": ok(c("return_pct"))})


def signals_from_backtest(results: DataFrame) -> DataFrame:
    return results.select(c("signal_date").alias("trade_date"), "code", "strategy_name", "strategy_version", "signal_strength", F.lit("").alias("entry_reason"), F.lit("").alias("risk_flags"))
