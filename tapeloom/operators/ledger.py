"""Executed trades: plan matching, performance, positions, and daily and period reviews, for all dates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import contains_flag, flag_text, flags, holds, zero
from tapeloom.operators.orderstats import placed
from tapeloom.operators.backtest import next_bar
from tapeloom.operators.factors import by_code

c = F.col
DAYS = (1, 3, 5)
TRADE_KEY = ["trade_date", "trade_time", "code", "side"]


def match_trades_to_plan(trades: DataFrame, plans: DataFrame) -> DataFrame:
    own = plans.select("trade_date", "code", c("rank").alias("plan_rank"), c("action").alias("planned_action"), "entry_low", "entry_high", "position_low", "position_high", "stop_loss", "take_profit_1", "take_profit_2", F.lit(True).alias("_plan"))
    return trades.join(own, ["trade_date", "code"], "left")


def execution_review(trades: DataFrame, plans: DataFrame) -> DataFrame:
    """How each trade keeps to its plan: match, status and flags."""
    df = match_trades_to_plan(trades, plans)
    none, buy, price = c("_plan").isNull(), c("side") == "buy", c("price")
    watch = c("entry_low").isNull() | c("entry_high").isNull()
    ranged = buy & ~watch
    ratio = c("position_ratio") if "position_ratio" in trades.columns else F.lit(None).cast("double")
    over = buy & holds(ratio > c("position_high"))
    marks = flags((none, "plan_not_found"), (~none & (c("side") == "sell"), "sell_recorded"), (~none & ~c("side").isin("buy", "sell"), "unknown_side"), (~none & buy & watch, "bought_watch_only"), (~none & ranged & price.isNull(), "price_missing"), (~none & ranged & price.between(c("entry_low"), c("entry_high")), "price_in_range"), (~none & ranged & (price > c("entry_high")), "chase_above_entry"), (~none & ranged & (price < c("entry_low")), "below_entry_range"), (~none & over, "over_position"))
    status = F.when(none, "off_plan").when(c("side") == "sell", "recorded_sell").when(~buy, "recorded").when(watch | over, "deviation").when(price.isNull(), "recorded").when(holds(price.between(c("entry_low"), c("entry_high"))), "follow_plan").otherwise("deviation")
    return df.withColumns({"plan_match_status": F.when(none, "no_plan").otherwise("matched"), "execution_status": status, "execution_flags": flag_text(marks)}).drop("_plan")


def match_trades_to_review(trades: DataFrame, review: DataFrame) -> DataFrame:
    return trades.join(review.select(*TRADE_KEY, "plan_match_status", "execution_status", "execution_flags"), TRADE_KEY, "left")


def performance_comment(df: DataFrame) -> DataFrame:
    r, d = c("return_3d"), c("max_drawdown_3d")
    parts = F.array(F.when(holds((r > 0) & (d > -0.03)), "steady"), F.when(holds(r.isNotNull() & (d < -0.05)), "deep drawdown"), F.when(contains_flag("execution_flags", "chase_above_entry"), "chased the price"), F.when(holds(c("execution_status") == "off_plan"), "off plan"))
    text = F.array_join(F.array_compact(parts), "; ")
    return df.withColumn("performance_comment", F.when(text == "", "no clear result").otherwise(text))


def trade_performance(trades: DataFrame, bars: DataFrame, review: DataFrame) -> DataFrame:
    """Windows of 1, 3 and 5 bars that start on the trade date, against the price paid; sells are not evaluated."""
    return reviewed_performance(match_trades_to_review(trades, review), bars)


def reviewed_performance(reviewed: DataFrame, bars: DataFrame) -> DataFrame:
    """The same of trades that have the columns of their review with them."""
    payload, w = [], bars
    for k in DAYS:
        span = by_code().rowsBetween(0, k - 1)
        whole = F.lead(F.lit(1), k - 1).over(by_code()) == 1
        w = w.withColumns({f"_close_{k}": F.lead("close", k - 1).over(by_code()), f"_low_{k}": F.when(whole, F.min("low").over(span)), f"_high_{k}": F.when(whole, F.max("high").over(span)), f"_has_{k}": holds(whole)})
        payload += [f"_close_{k}", f"_low_{k}", f"_high_{k}", f"_has_{k}"]
    known = bars.select("code").distinct().withColumn("_known", F.lit(True))
    df = next_bar(reviewed.join(known, "code", "left"), w, payload, same_day=True)
    short = F.array_compact(F.array(*[F.when(~holds(c(f"bar._has_{k}")), F.lit(f"{k}d")) for k in DAYS]))
    reason = F.when(c("side") != "buy", "sell_trade_not_evaluated").when(~holds(c("price") > 0), "invalid_entry_price").when(c("_known").isNull(), "no_daily_bars_found").when(F.size(short) > 0, F.concat(F.lit("insufficient_daily_bars:"), F.array_join(short, ","))).otherwise("")
    df = df.withColumns({"invalid_reason": reason, "is_valid": reason == ""})
    fits = (c("side") == "buy") & holds(c("price") > 0)
    for k in DAYS:
        rel = lambda x, k=k: F.when(fits & holds(c(f"bar._has_{k}")), F.try_divide(c(f"bar._{x}_{k}"), c("price")) - 1)
        df = df.withColumns({f"return_{k}d": rel("close"), f"max_drawdown_{k}d": rel("low"), f"max_favorable_{k}d": rel("high")})
    text = {x: F.coalesce(x, F.lit("")) for x in ("plan_match_status", "execution_status", "execution_flags")}
    return df.withColumns(text).drop("bar", "_known").transform(performance_comment)


def latest_price_asof(bars: DataFrame, as_of: str) -> DataFrame:
    return bars.where(c("trade_date") <= as_of).groupBy("code").agg(F.max_by("close", "trade_date").alias("latest_price"))


def latest_plan_asof(plans: DataFrame, as_of: str) -> DataFrame:
    row = F.struct("stop_loss", "take_profit_1", "take_profit_2")
    return plans.where(c("trade_date") <= as_of).groupBy("code").agg(F.max_by(row, "trade_date").alias("p")).select("code", c("p.stop_loss").alias("planned_stop_loss"), c("p.take_profit_1").alias("planned_take_profit_1"), c("p.take_profit_2").alias("planned_take_profit_2"))


def position_status(pnl: Column) -> Column:
    return F.when(pnl.isNull(), "unknown").when(pnl <= -0.05, "loss_warning").when(pnl >= 0.05, "profit_watch").otherwise("normal")


#: Trades that one task folds in a row; below this a sale has emptied a holding.
CHUNK, NOTHING = 4096, 1e-9


def _folded(own: DataFrame) -> DataFrame:
    """Holding and its cost per code after all trades: a segmented scan over chunks of a code's trades.

    Trades are laid out in order of code and time by range partitions, and cut into chunks.  What a chunk does to a holding has
    the form max(holding + net, least), since a sale beyond the holding resets it to nothing; running sums and maxima of these two
    numbers give the holding at the start of every chunk.  Each chunk is then folded by itself into a share and a cost, as it keeps a share of
    the cost before it and adds its own, and the chunks' pairs are folded in turn."""
    item = own.select("code", "trade_date", "trade_time", "side", zero("volume").alias("v"), F.coalesce("amount", zero("price") * zero("volume")).alias("a"))
    item = item.where((c("side") == "buy") | ((c("side") == "sell") & (c("v") > 0)))
    rows = placed(item, ["code", "trade_date", "trade_time", "side", "v", "a"])
    block = F.floor(c("_place") / CHUNK).alias("_block")
    trades = F.array_sort(F.collect_list(F.struct("_place", (c("side") == "buy").alias("buy"), "v", "a")))
    chunks = rows.groupBy("code", "_part", block).agg(trades.alias("trades"))

    def move(s: Column, x: Column) -> Column:
        d = F.when(x["buy"], x["v"]).otherwise(-x["v"])
        least = F.when(x["buy"], s["least"] + d).otherwise(F.greatest(s["least"] + d, F.lit(0.0)))
        return F.struct((s["net"] + d).alias("net"), least.alias("least"))

    start = F.struct(F.lit(0.0).alias("net"), F.lit(float("-inf")).alias("least"))
    chunks = chunks.withColumn("move", F.aggregate("trades", start, move))
    order = Window.partitionBy("code").orderBy("_part", "_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # As many rows per code as it has chunks.
    chunks = chunks.withColumn("net", F.sum("move.net").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = chunks.withColumn("held", F.coalesce(F.sum("move.net").over(before) + F.greatest(F.lit(0.0), F.max(c("move.least") - c("net")).over(before)), F.lit(0.0)))

    def fold(s: Column, x: Column) -> Column:
        left = s["h"] - x["v"]
        share = F.when(left <= NOTHING, 0.0).otherwise(left / s["h"])
        bought = F.struct((s["h"] + x["v"]).alias("h"), s["kept"].alias("kept"), (s["cost"] + x["a"]).alias("cost"))
        sold = F.struct(F.when(left <= NOTHING, 0.0).otherwise(left).alias("h"), (s["kept"] * share).alias("kept"), (s["cost"] * share).alias("cost"))
        return F.when(x["buy"], bought).otherwise(sold)

    begin = F.struct(c("held").alias("h"), F.lit(1.0).alias("kept"), F.lit(0.0).alias("cost"))
    done = chunks.select("code", "_part", "_block", F.aggregate("trades", begin, fold).alias("f"))
    codes = done.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("_part", "_block", "f"))).alias("all"))
    cost = F.aggregate("all", F.lit(0.0), lambda s, x: s * x["f"]["kept"] + x["f"]["cost"])
    return codes.select("code", F.element_at("all", -1)["f"]["h"].alias("h"), cost.alias("cost"))


def positions(trades: DataFrame, bars: DataFrame, as_of: str) -> DataFrame:
    """Average-cost positions per code: what an ordered fold over the code's trades gives, with the price as of the date.

    A sale beyond the holding resets it to nothing; buys of the day itself are frozen."""
    own = trades.where(c("trade_date") <= as_of)
    frozen = F.sum(F.when((c("side") == "buy") & (c("trade_date") == as_of), zero("volume")).otherwise(0.0))
    df = own.groupBy("code").agg(frozen.alias("_frozen"), F.coalesce(F.min(F.when(c("side") == "buy", c("trade_date"))), F.max("trade_date")).alias("first_buy_date"), F.max("trade_date").alias("latest_trade_date"))
    df = df.join(_folded(own), "code", "left").withColumns({"h": zero("h"), "cost": zero("cost")}).join(latest_price_asof(bars, as_of), "code", "left")
    df = df.select(F.lit(as_of).cast("date").alias("as_of_date"), "code", c("h").alias("holding_volume"), F.least("_frozen", "h").alias("frozen_volume"), c("cost").alias("cost_amount"), "latest_price", "first_buy_date", "latest_trade_date")
    df = df.withColumns({"available_volume": c("holding_volume") - c("frozen_volume"), "cost_price": F.when(c("holding_volume") > 0, c("cost_amount") / c("holding_volume")), "market_value": c("holding_volume") * c("latest_price")})
    df = df.withColumns({"floating_pnl": c("market_value") - c("cost_amount"), "floating_pnl_pct": F.try_divide("latest_price", "cost_price") - 1})
    return df.withColumns({"t_plus_1_status": F.when(c("available_volume") <= 0, "not_sellable_today").otherwise("sellable"), "position_status": position_status(c("floating_pnl_pct"))})


def position_review(held: DataFrame, plans: DataFrame, as_of: str) -> DataFrame:
    """Stop, target, settlement and concentration flags of positions, and what to do next."""
    df = held.join(latest_plan_asof(plans, as_of), "code", "left")
    ratio = c("position_ratio") if "position_ratio" in held.columns else F.lit(None).cast("double")
    below, target, locked = holds(c("latest_price") <= c("planned_stop_loss")), holds(c("latest_price") >= c("planned_take_profit_1")), c("t_plus_1_status") == "not_sellable_today"
    marks = flags((below, "below_stop_loss"), (target, "take_profit_zone"), (locked, "t_plus_1_locked"), (ratio > 0.25, "high_position_ratio"))
    hint = F.when(below & locked, "handle first thing next day").when(below, "follow the stop").when(target, "consider taking profit").otherwise("keep watching")
    risk = F.when(below, "high").when(holds(ratio > 0.25), "medium").otherwise("low")
    return df.withColumns({"position_risk_level": risk, "position_flags": flag_text(marks), "next_action_hint": hint})


def _performance_stats() -> dict[str, Column]:
    """Per statistic the condition that it counts, or what it is the mean of, null where a trade does not take part."""
    off, chase = c("execution_status") == "off_plan", contains_flag("execution_flags", "chase_above_entry")
    ok = lambda cond, x: F.when(c("is_valid") & cond, c(x))
    yes = F.lit(True)
    return {"valid_performance_count": c("is_valid"), **{f"avg_return_{k}d": ok(yes, f"return_{k}d") for k in DAYS}, "plan_trade_avg_return_3d": ok(~off, "return_3d"), "off_plan_avg_return_3d": ok(off, "return_3d"), "chase_trade_count": c("is_valid") & chase, "chase_avg_return_3d": ok(chase, "return_3d")}


def _execution_counts() -> list[Column]:
    has = lambda f: F.count_if(contains_flag("execution_flags", f))
    status = lambda s: F.count_if(c("execution_status") == s)
    return [F.count(F.lit(1)).alias("actual_trade_count"), F.count_if(c("side") == "buy").alias("buy_count"), F.count_if(c("side") == "sell").alias("sell_count"), F.count_if(c("plan_match_status") != "no_plan").alias("matched_plan_count"), status("off_plan").alias("off_plan_count"), status("follow_plan").alias("follow_plan_count"), status("deviation").alias("deviation_count"), has("chase_above_entry").alias("chase_count"), has("over_position").alias("over_position_count"), has("bought_watch_only").alias("bought_watch_only_count")]


def _scored(df: DataFrame) -> DataFrame:
    n = lambda x: c(f"{x}_count")
    score = 100 - n("off_plan") * 20 - n("deviation") * 15 - n("chase") * 10 - n("over_position") * 10 - n("bought_watch_only") * 20
    issues = F.array_join(F.array_compact(F.array(*[F.when(n(x) > 0, F.lit(x)) for x in ("off_plan", "chase", "over_position", "bought_watch_only")])), ";")
    total = n("off_plan") + n("deviation") + n("chase") + n("over_position") + n("bought_watch_only")
    advice = F.when(total >= 2, "trade less and keep to plans").when(total == 1, "look into the deviation").otherwise("keep going")
    return df.withColumns({"execution_score": F.greatest(score, F.lit(0)), "main_issues": F.when(issues == "", "none").otherwise(issues), "next_action_suggestion": advice})


def daily_review(review: DataFrame, plans: DataFrame, performance: DataFrame) -> DataFrame:
    """One row per date with plans or trades: counts, score, return means, issues."""
    day = "trade_date"
    stats = [(F.count_if if n.endswith("_count") else F.avg)(x).alias(n) for n, x in _performance_stats().items()]
    planned = plans.groupBy(day).agg(F.count(F.lit(1)).alias("planned_trade_count"))
    df = review.groupBy(day).agg(*_execution_counts()).join(planned, day, "full_outer").join(performance.groupBy(day).agg(*stats), day, "left")
    counts = [x for x, _ in df.dtypes if x.endswith("_count")]
    return df.withColumns({x: F.coalesce(x, F.lit(0)) for x in counts}).transform(_scored)


def in_periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows with every period that their trade_date lies in: an interval join by dates.

    Dates on which something happened are few beside the rows, and each is looked up once: a period is cut into whole months and the
    days of the months it covers in part, so that it meets dates by equality of month or day, whatever its length."""
    first, last = F.to_date("start_date"), F.to_date("end_date")
    months = F.when(first <= last, F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))
    each = periods.select("period", first.alias("_from"), last.alias("_to"), F.explode(months).alias("_month"))
    each = each.withColumns({"_low": F.greatest("_from", "_month"), "_high": F.least("_to", F.last_day("_month"))})
    full = (c("_low") == c("_month")) & (c("_high") == F.last_day("_month"))
    dates = df.select("trade_date").where("trade_date is not null").distinct().withColumns({"_day": F.to_date("trade_date"), "_month": F.trunc("trade_date", "month")})
    by_month = dates.join(each.where(full).select("_month", "period"), "_month").select("trade_date", "period")
    by_day = dates.join(each.where(~full).select(F.explode(F.sequence("_low", "_high")).alias("_day"), "period"), "_day").select("trade_date", "period")
    return df.join(by_month.unionByName(by_day), "trade_date")


def period_review(review: DataFrame, performance: DataFrame, periods: DataFrame) -> DataFrame:
    """The same over periods (period, start_date, end_date; any number of them, overlapping or not), with trading days and best and
    worst code by three-day return.

    Trades are summed by date first, as counts and sums of returns add up: periods meet a row per date, not every trade."""
    day, stats = "trade_date", _performance_stats()
    counts = review.groupBy(day).agg(*_execution_counts())
    counts = in_periods(counts, periods).groupBy("period").agg(*[F.sum(n).alias(n) for n in counts.columns if n != day], F.countDistinct(day).alias("trading_days"))
    order = F.when(c("is_valid") & c("return_3d").isNotNull(), F.struct(F.round("return_3d", 9).alias("r"), c("code").alias("code"), c(day).alias("d")))
    sums = [a for n, x in stats.items() for a in ([F.count_if(x).alias(n)] if n.endswith("_count") else [F.sum(x).alias(n), F.count(x).alias(f"_n_{n}")])]
    totals = [(F.sum(n) if n.endswith("_count") else F.try_divide(F.sum(n), F.sum(f"_n_{n}"))).alias(n) for n in stats]
    earned = performance.groupBy(day).agg(*sums, F.max(order).alias("_best"), F.min(order).alias("_worst"))
    earned = in_periods(earned, periods).groupBy("period").agg(*totals, F.max("_best")["code"].alias("best_code"), F.min("_worst")["code"].alias("worst_code"))
    return periods.join(counts, "period", "left").join(earned, "period", "left").transform(_scored)


def positions_totals(reviewed: DataFrame) -> DataFrame:
    return reviewed.agg(F.count(F.lit(1)).alias("position_count"), F.sum("market_value").alias("market_value"), F.sum("floating_pnl").alias("floating_pnl"), F.count_if(c("position_risk_level") == "high").alias("high_risk_count"), F.count_if(contains_flag("position_flags", "t_plus_1_locked")).alias("locked_count"))


def performance_by_execution(performance: DataFrame) -> DataFrame:
    kinds = {"in_plan": c("execution_status") != "off_plan", "off_plan": c("execution_status") == "off_plan", "chase": contains_flag("execution_flags", "chase_above_entry"), "over_position": contains_flag("execution_flags", "over_position")}
    aggs = [a for k, cond in kinds.items() for a in (F.avg(F.when(c("is_valid") & cond, c("return_3d"))).alias(f"{k}_return_3d"), F.avg(F.when(c("is_valid") & cond, c("max_drawdown_3d"))).alias(f"{k}_max_drawdown_3d"))]
    return performance.agg(*aggs)
