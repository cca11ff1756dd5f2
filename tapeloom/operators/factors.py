"""Technical factors, money flow, industry strength, market regime, and their join into one factor table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tapeloom.functions.columns import flag_text, flags, holds, safe_divide, zero

FACTORS = ["trade_date", "code", "close", "pct_chg_1d", "pct_chg_3d", "pct_chg_5d", "pct_chg_10d", "ma5", "ma10", "ma20", "volume_ma5", "volume_ratio_5", "amount_ma5", "high_20", "low_20", "close_position_20", "above_ma5", "above_ma10", "above_ma20"]


def by_code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("trade_date")


def trailing(n: int, window: WindowSpec | None = None) -> WindowSpec:
    return (window or by_code()).rowsBetween(1 - n, 0)


def dedup_last(df: DataFrame, keys: list[str], seq: str, first: bool = False) -> DataFrame:
    """One row per key: the last (or first) by *seq*."""
    order = F.col(seq).asc() if first else F.col(seq).desc()
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where("_rn = 1").drop("_rn")


def lag_returns(bars: DataFrame, steps: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    change = lambda n: F.try_divide(F.col("close"), F.lag("close", n).over(by_code())) - 1
    return bars.withColumns({f"pct_chg_{n}d": change(n) for n in steps})


def rolling_means(bars: DataFrame) -> DataFrame:
    means = {f"ma{n}": F.avg("close").over(trailing(n)) for n in (5, 10, 20)}
    return bars.withColumns(means | {f"{c}_ma5": F.avg(c).over(trailing(5)) for c in ("volume", "amount")})


def rolling_extremes(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"high_20": F.max("high").over(trailing(20)), "low_20": F.min("low").over(trailing(20))})


def relative_levels(df: DataFrame) -> DataFrame:
    above = {f"above_ma{n}": holds(F.col("close") > F.col(f"ma{n}")) for n in (5, 10, 20)}
    position = safe_divide(F.col("close") - F.col("low_20"), F.col("high_20") - F.col("low_20"))
    return df.withColumns({"volume_ratio_5": safe_divide("volume", "volume_ma5"), "close_position_20": position, **above})


def daily_factors(bars: DataFrame) -> DataFrame:
    """All technical factors of a bar table in one window pass per code."""
    return bars.transform(lag_returns).transform(rolling_means).transform(rolling_extremes).transform(relative_levels).select(*FACTORS)


FLOW_INPUTS = [*[f"{side}_{s}_{w}" for s in ("sm", "lg", "elg") for side in ("buy", "sell") for w in ("vol", "amount")], "buy_md_amount", "net_mf_vol", "net_mf_amount"]


def moneyflow_factors(flow: DataFrame) -> DataFrame:
    """Net flows by order size, their score and flags; null inputs count as 0 and raise missing_moneyflow."""
    have = [c for c in FLOW_INPUTS if c in flow.columns]
    get = lambda c: zero(c) if c in have else F.lit(0.0)
    big = get("buy_lg_amount") - get("sell_lg_amount")
    main = big + get("buy_elg_amount") - get("sell_elg_amount")
    small = get("buy_sm_amount") - get("sell_sm_amount")
    bought = F.greatest(get("buy_sm_amount") + get("buy_md_amount") + get("buy_lg_amount") + get("buy_elg_amount"), F.lit(1.0))
    out = flow.select("trade_date", "code", get("net_mf_amount").alias("net_mf_amount"), main.alias("main_net_amount"), (main / bought).alias("main_net_amount_ratio"), big.alias("big_net_amount"), small.alias("small_net_amount"), (F.lit(len(have) < len(FLOW_INPUTS)) | F.exists(F.array(*have), lambda x: x.isNull()) if have else F.lit(True)).alias("_missing"))
    m, r, b, s, n = (F.col(c) for c in ("main_net_amount", "main_net_amount_ratio", "big_net_amount", "small_net_amount", "net_mf_amount"))
    #: Steps and points.
    points = [(m > 0, 10), (r > 0.05, 10), (r > 0.10, 10), (b > 0, 5), (n > 0, 5), (m < 0, -10), (r < -0.05, -10), (r < -0.10, -10), ((s > 0) & (m < 0), -5)]
    out = out.withColumn("moneyflow_score", sum(F.when(c, float(p)).otherwise(0.0) for c, p in points))
    raised = flags((m < 0, "main_outflow"), (r < -0.10, "strong_main_outflow"), (F.col("moneyflow_score") < 0, "weak_moneyflow"), (r > 0.10, "strong_main_inflow"), (F.col("_missing"), "missing_moneyflow"))
    return out.withColumn("moneyflow_risk_flags", flag_text(raised)).drop("_missing")


def percent_rank_desc(value: str, by: str) -> Column:
    """Average rank from the top, over the number of values; null for null."""
    day, same = Window.partitionBy(by), Window.partitionBy(by, value)
    rank = F.rank().over(day.orderBy(F.col(value).desc_nulls_last())) + (F.count(F.lit(1)).over(same) - 1) / 2
    return F.when(F.col(value).isNotNull(), rank / F.count(value).over(day))


def industry_strength(sw: DataFrame) -> DataFrame:
    """Returns, activity and ranks of industries; score, level and flags."""
    w = Window.partitionBy("industry_code").orderBy("trade_date")
    back = lambda n: F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1
    df = sw.withColumns({"industry_return_3d": back(3), "industry_return_5d": back(5), "_amount": F.avg("amount").over(trailing(5, w)), "_ma5": F.avg("close").over(trailing(5, w)), "_ma10": F.avg("close").over(trailing(10, w))})
    df = df.withColumns({"industry_amount_ratio_5": F.try_divide("amount", "_amount"), "above_ma5": holds(F.col("close") > F.col("_ma5")), "above_ma10": holds(F.col("close") > F.col("_ma10"))})
    df = df.withColumns({"rank_pct_change": percent_rank_desc("pct_change", "trade_date"), "rank_return_3d": percent_rank_desc("industry_return_3d", "trade_date"), "rank_return_5d": percent_rank_desc("industry_return_5d", "trade_date")})
    c = F.col
    #: Steps, points and levels.
    points = [(c("pct_change") > 0, 10), (c("industry_return_3d") > 0, 10), (c("industry_return_5d") > 0, 15), (c("above_ma5"), 10), (c("above_ma10"), 10), (c("industry_amount_ratio_5") > 1.2, 10), (c("rank_pct_change") <= 0.2, 15), (c("rank_return_5d") <= 0.2, 15), (c("industry_return_5d") < -0.03, -15), (~c("above_ma5") & ~c("above_ma10"), -10)]
    df = df.withColumn("industry_strength_score", sum(F.when(holds(k), float(p)).otherwise(0.0) for k, p in points))
    level = F.when(c("industry_strength_score") >= 60, "strong").when(c("industry_strength_score") >= 30, "neutral").otherwise("weak")
    df = df.withColumn("industry_strength_level", level)
    raised = flags((level == "weak", "weak_industry"), (level == "strong", "strong_industry"), (c("industry_amount_ratio_5") < 0.8, "shrinking_amount"), (c("industry_amount_ratio_5") > 1.2, "high_activity"))
    return df.select("trade_date", "industry_code", "industry_name", "pct_change", "industry_return_3d", "industry_return_5d", "industry_amount_ratio_5", "rank_pct_change", "rank_return_3d", "rank_return_5d", "industry_strength_score", "industry_strength_level", flag_text(raised).alias("industry_risk_flags"))


#: Words that mark a broken board, and columns that may hold the height of a streak.
BROKEN_WORDS = ("炸板", "打开", "开板", "broken", "break")
STREAKS = ("strth", "streak", "lianban", "连板数", "连板高度")


def limit_masks(limits: DataFrame) -> DataFrame:
    """Whether a limit event is an upper limit, a lower limit, or a board that broke."""
    kind = F.upper(F.coalesce("limit_type", F.lit("")))
    status = F.coalesce("status", F.lit("")) if "status" in limits.columns else F.lit("")
    opened = zero(F.col("open_times").cast("double")) if "open_times" in limits.columns else F.lit(0.0)
    broken = opened > 0
    for word in BROKEN_WORDS:
        broken |= status.contains(word)
    return limits.withColumns({"is_up": kind.contains("U") | kind.contains("涨停"), "is_down": kind.contains("D") | kind.contains("跌停"), "is_broken": broken, "_opened": opened})


def sentiment_by_date(limits: DataFrame) -> DataFrame:
    """Counts of upper limits, lower limits and broken boards, mean re-openings and the highest streak, per date."""
    streaks = [F.max(F.col(x).cast("string").try_cast("double")) for x in STREAKS if x in limits.columns]
    high = F.coalesce(*streaks) if streaks else F.max(F.lit(None).cast("double"))
    return limit_masks(limits).groupBy("trade_date").agg(F.count_if("is_up").alias("limit_up_count"), F.count_if("is_down").alias("limit_down_count"), F.count_if("is_broken").alias("break_board_count"), F.avg(F.when(F.col("is_up"), F.col("_opened"))).alias("limit_up_open_times_avg"), high.alias("highest_streak"))


# Fixed values of the three functions below: steps of the scores, their points, and the levels of the regime.
def sentiment_score(df: DataFrame) -> DataFrame:
    up, down = F.col("limit_up_count"), F.col("limit_down_count")
    ratio = F.col("break_board_count") / F.greatest(up, F.lit(1))
    score = sum(F.when(holds(k), float(p)).otherwise(0.0) for k, p in [(up >= 50, 20), (up >= 80, 20), (down >= 20, -20), (ratio > 0.3, -20), (ratio > 0.5, -20)])
    return df.withColumn("sentiment_score", score)


def index_trend_score(df: DataFrame) -> DataFrame:
    c = F.col
    score = sum(F.when(holds(k), float(p)).otherwise(0.0) for k, p in [(c("close") > c("ma5"), 10), (c("close") > c("ma10"), 10), (c("close") > c("ma20"), 20), (c("pct_chg") > 0, 10), (c("pct_chg") < -1.5, -20)])
    return df.withColumn("index_trend_score", score)


def regime_label(total: Column) -> tuple[Column, Column]:
    name = F.when(total >= 50, "strong").when(total >= 20, "neutral").otherwise("weak")
    risk = F.when(total >= 50, "low").when(total >= 20, "medium").otherwise("high")
    return name, risk


def market_regime(index: DataFrame, limits: DataFrame, code: str = "000001.SH") -> DataFrame:
    """Trend of one index plus limit sentiment, one row per date."""
    marked = index.withColumn("_own", F.upper(F.trim("index_code")) == code)
    some = marked.agg(F.max("_own").alias("_some"))
    own = marked.join(F.broadcast(some), F.col("_own") | ~F.col("_some")).where("trade_date is not null and close is not null")
    own = dedup_last(own.withColumn("_seq", F.xxhash64("index_code", "close")), ["trade_date"], "_seq")
    w = Window.partitionBy("_some").orderBy("trade_date")
    own = own.withColumns({f"ma{n}": F.avg("close").over(trailing(n, w)) for n in (5, 10, 20)}).transform(index_trend_score)
    df = own.select("trade_date", "close", "pct_chg", "index_trend_score").join(sentiment_by_date(limits), "trade_date", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("limit_up_count", "limit_down_count", "break_board_count")}
    df = df.withColumns(counts).transform(sentiment_score)
    df = df.withColumn("total_score", F.col("index_trend_score") + F.col("sentiment_score"))
    name, risk = regime_label(F.col("total_score"))
    text = F.format_string("trend=%.2f sentiment=%.2f total=%.2f", "index_trend_score", "sentiment_score", "total_score")
    return df.withColumns({"market_regime": name, "risk_level": risk, "reason": text})


def suspend_any(suspensions: DataFrame) -> DataFrame:
    hit = F.coalesce("suspend_type", F.lit("")) == "S"
    return suspensions.groupBy("trade_date", "code").agg(F.max(hit).alias("is_suspended"))


EXTENSIONS = {
    **dict.fromkeys(("turnover_rate", "turnover_rate_f", "volume_ratio_daily_basic", "pe_ttm", "pb", "total_mv", "circ_mv", "up_limit", "down_limit", "net_mf_amount", "main_net_amount", "main_net_amount_ratio", "big_net_amount", "small_net_amount", "moneyflow_score"), "double"),
    "is_suspended": "boolean", "moneyflow_risk_flags": "string", "industry_code": "string", "industry_name": "string",
    **dict.fromkeys(("industry_strength_score", "industry_return_3d", "industry_return_5d", "industry_amount_ratio_5"), "double"),
    "industry_strength_level": "string", "industry_risk_flags": "string",
}
STRENGTH = ["trade_date", "industry_code", "industry_strength_score", "industry_strength_level", "industry_return_3d", "industry_return_5d", "industry_amount_ratio_5", "industry_risk_flags"]


def attach_industry(df: DataFrame, mapping: DataFrame, strength: DataFrame | None = None) -> DataFrame:
    df = df.join(mapping.select("code", "industry_code", "industry_name"), "code", "left")
    return df if strength is None else df.join(strength.select(*STRENGTH), ["trade_date", "industry_code"], "left")


def limit_status(df: DataFrame) -> DataFrame:
    up, down, close = F.col("up_limit"), F.col("down_limit"), F.col("close")
    return df.withColumns({"is_limit_up_close": holds(close >= up * 0.999), "is_limit_down_close": holds(close <= down * 1.001), "limit_up_distance": F.when(close > 0, F.try_divide(up, close) - 1), "limit_down_distance": F.when((close > 0) & (down > 0), F.try_divide(close, down) - 1)})


def enrich_factors(factors: DataFrame, basic: DataFrame | None = None, limits: DataFrame | None = None, suspensions: DataFrame | None = None, flow: DataFrame | None = None, mapping: DataFrame | None = None, strength: DataFrame | None = None) -> DataFrame:
    """Factors with daily basics, price limits, suspension, money flow and industry; an absent table gives nulls."""
    key, df = ["trade_date", "code"], factors
    if basic is not None:
        df = df.join(basic.select(*key, "turnover_rate", "turnover_rate_f", F.col("volume_ratio").alias("volume_ratio_daily_basic"), "pe_ttm", "pb", "total_mv", "circ_mv"), key, "left")
    if limits is not None:
        df = df.join(limits.select(*key, "up_limit", "down_limit"), key, "left")
    if suspensions is not None:
        df = df.join(suspend_any(suspensions), key, "left")
    if flow is not None:
        df = df.join(flow.select(*key, "net_mf_amount", "main_net_amount", "main_net_amount_ratio", "big_net_amount", "small_net_amount", "moneyflow_score", "moneyflow_risk_flags"), key, "left")
    if mapping is not None:
        df = attach_industry(df, mapping, strength)
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in EXTENSIONS.items() if c not in df.columns})
    df = df.withColumn("is_suspended", F.coalesce("is_suspended", F.lit(False))).transform(limit_status)
    return df.select(*FACTORS, *EXTENSIONS, "is_limit_up_close", "is_limit_down_close", "limit_up_distance", "limit_down_distance")


def asof_regime(dates: DataFrame, regime: DataFrame) -> DataFrame:
    """For each date the regime of that date or else the latest before it: one sort of the union."""
    both = regime.select("trade_date", F.struct("market_regime", "risk_level", F.col("trade_date").alias("regime_date")).alias("r"), F.lit(0).alias("_ask")).unionByName(dates.select("trade_date", F.lit(1).alias("_ask")).distinct(), allowMissingColumns=True)
    last = F.last("r", ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy("trade_date", "_ask").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("r", last).where("_ask = 1").select("trade_date", "r.*")


