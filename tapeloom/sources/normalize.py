"""Raw landed tables to canonical ones: one batch transform per table, whatever the number of codes and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.columns import board_of, market_of, normalize_code, normalize_date, number
from tapeloom.operators.factors import dedup_last

c = F.col

#: Columns of each source table; text columns first, then numbers.
BASIC = ["turnover_rate", "turnover_rate_f", "volume_ratio", "pe", "pe_ttm", "pb", "ps", "ps_ttm", "total_share", "float_share", "total_mv", "circ_mv"]
FLOW = [f"{side}_{s}_{w}" for s in ("sm", "md", "lg", "elg") for side in ("buy", "sell") for w in ("vol", "amount")] + ["net_mf_vol", "net_mf_amount"]


def first_of(df: DataFrame, *names: str) -> Column:
    """First of the named columns that exists, else null."""
    have = [n for n in names if n in df.columns]
    return c(have[0]) if have else F.lit(None).cast("string")


def required(df: DataFrame, *names: str) -> None:
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")


def _numbers(df: DataFrame, names: list[str]) -> list[Column]:
    return [(number(n) if n in df.columns else F.lit(None).cast("double")).alias(n) for n in names]


def _code(df: DataFrame) -> Column:
    return normalize_code(first_of(df, "ts_code", "code", "symbol")).alias("code")


def _date(df: DataFrame, *names: str) -> Column:
    return normalize_date(first_of(df, *(names or ("trade_date", "date")))).alias("trade_date")


def normalize_stock_basic(df: DataFrame) -> DataFrame:
    suffix = F.upper(F.substring_index(first_of(df, "ts_code").cast("string"), ".", -1))
    market = F.coalesce(F.when(suffix.isin("SH", "SZ", "BJ"), suffix), market_of(_code(df)))
    text = lambda *n: F.trim(F.coalesce(first_of(df, *n).cast("string"), F.lit("")))
    return df.select(_code(df), text("name", "stock_name").alias("name"), market.alias("market"), F.coalesce(F.nullif(text("market_board", "board"), F.lit("")), board_of(_code(df))).alias("board"), F.nullif(text("industry"), F.lit("")).alias("industry"), F.coalesce(F.nullif(text("list_status", "status"), F.lit("")), F.lit("L")).alias("list_status"))


def normalize_daily_bars(df: DataFrame) -> DataFrame:
    required(df, "trade_date", "open", "high", "low", "close")
    df = df.withColumnRenamed("vol", "volume") if "vol" in df.columns else df
    return df.select(_date(df), _code(df), *_numbers(df, ["open", "high", "low", "close", "volume", "amount"])).where("trade_date is not null and code is not null")


#: Headers of the second provider.
ALT_HEADERS = {"日期": "trade_date", "date": "trade_date", "股票代码": "code", "代码": "code", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount"}


def normalize_bars_alt(df: DataFrame) -> DataFrame:
    """The second provider: its headers, and amounts in yuan to thousands."""
    for old, new in ALT_HEADERS.items():
        df = df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df
    return normalize_daily_bars(df).withColumn("amount", c("amount") / 1000)


def normalize_trade_calendar(df: DataFrame) -> DataFrame:
    return df.select(_date(df, "cal_date", "trade_date"), F.coalesce(first_of(df, "exchange"), F.lit("SSE")).alias("exchange"), F.coalesce(first_of(df, "is_open").cast("string").try_cast("bigint"), F.lit(0)).alias("is_open"))


def normalize_daily_basic(df: DataFrame) -> DataFrame:
    return df.select(_date(df), _code(df), *_numbers(df, BASIC))


def normalize_stock_limits(df: DataFrame) -> DataFrame:
    return df.select(_date(df), _code(df), *_numbers(df, ["up_limit", "down_limit"]))


def normalize_suspend(df: DataFrame) -> DataFrame:
    return df.select(_date(df, "trade_date", "suspend_date"), _code(df), F.coalesce(first_of(df, "suspend_type").cast("string"), F.lit("")).alias("suspend_type"))


def normalize_index_daily(df: DataFrame) -> DataFrame:
    name = F.upper(F.trim(first_of(df, "ts_code", "index_code").cast("string"))).alias("index_code")
    df = df.withColumnRenamed("vol", "volume") if "vol" in df.columns else df
    return df.select(_date(df), name, *_numbers(df, ["open", "high", "low", "close", "pct_chg", "volume", "amount"]))


def normalize_limit_list(df: DataFrame) -> DataFrame:
    kind = F.coalesce(first_of(df, "limit_type", "limit").cast("string"), F.lit("")).alias("limit_type")
    return df.select(_date(df), _code(df), kind, *_numbers(df, ["open_times", "strth", "limit_times", "close", "pct_chg"]))


def normalize_moneyflow(df: DataFrame) -> DataFrame:
    return df.select(_date(df), _code(df), *_numbers(df, FLOW))


def normalize_industry_classification(df: DataFrame) -> DataFrame:
    text = lambda *n: F.trim(first_of(df, *n).cast("string"))
    return df.select(text("index_code", "industry_code").alias("industry_code"), text("industry_name", "name").alias("industry_name"), text("level").alias("level"), text("src").alias("src"))


def normalize_industry_members(df: DataFrame, classification: DataFrame, seq: str = "_seq") -> DataFrame:
    """Current members, the last row per code, with the industry's name."""
    own = df.where(F.upper(F.coalesce(first_of(df, "is_new").cast("string"), F.lit("Y"))) != "N").select(normalize_code(first_of(df, "con_code", "ts_code", "code")).alias("code"), F.trim(first_of(df, "index_code", "industry_code").cast("string")).alias("industry_code"), seq)
    own = dedup_last(own.where("code is not null"), ["code"], seq).drop(seq)
    names = dedup_last(classification.select("industry_code", "industry_name", F.xxhash64("industry_code", "industry_name").alias("_s")), ["industry_code"], "_s").drop("_s")
    return own.join(names, "industry_code", "left").select("code", "industry_code", "industry_name")


def normalize_industry_daily(df: DataFrame) -> DataFrame:
    for old, new in (("pct_chg", "pct_change"), ("vol", "volume"), ("ts_code", "industry_code"), ("name", "industry_name")):
        df = df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df
    return df.select(_date(df), F.trim("industry_code").alias("industry_code"), first_of(df, "industry_name").alias("industry_name"), *_numbers(df, ["open", "high", "low", "close", "pct_change", "volume", "amount"]))


TRADES = ["trade_date", "trade_time", "code", "name", "side", "price", "volume", "amount", "position_ratio", "strategy_name", "plan_rank", "reason", "emotion", "notes"]


def normalize_trades(df: DataFrame) -> DataFrame:
    """Fixed columns, trimmed text, side buy, sell or unknown, amount from price and volume when missing."""
    text = lambda n: F.trim(F.coalesce(first_of(df, n).cast("string"), F.lit(""))).alias(n)
    side = F.lower(F.trim(F.coalesce(first_of(df, "side").cast("string"), F.lit(""))))
    num = {n: (number(n) if n in df.columns else F.lit(None).cast("double")) for n in ("price", "volume", "amount", "position_ratio", "plan_rank")}
    amount = F.coalesce(num["amount"], num["price"] * num["volume"])
    return df.select(_date(df), text("trade_time"), normalize_code(first_of(df, "code"), "joined").alias("code"), text("name"), F.when(side.isin("buy", "sell"), side).otherwise("unknown").alias("side"), num["price"].alias("price"), num["volume"].alias("volume"), amount.alias("amount"), num["position_ratio"].alias("position_ratio"), text("strategy_name"), num["plan_rank"].alias("plan_rank"), text("reason"), text("emotion"), text("notes"))


def derive_market_board(df: DataFrame) -> DataFrame:
    return df.withColumns({"market": market_of("code"), "board": board_of("code")})


def build_stock_industry_map(stocks: DataFrame, members: DataFrame, classification: DataFrame) -> DataFrame:
    """Industry of each stock: by membership, else by a classification of the same name; the source says which."""
    by_code = members.select("code", c("industry_code").alias("_m_code"), c("industry_name").alias("_m_name"))
    by_name = classification.groupBy(c("industry_name").alias("industry")).agg(F.min("industry_code").alias("_n_code"))
    df = stocks.join(by_code, "code", "left").join(by_name, "industry", "left")
    source = F.when(c("_m_code").isNotNull(), "member").when(c("_n_code").isNotNull(), "name_match").otherwise("unmapped")
    return df.select("code", F.coalesce("_m_code", "_n_code").alias("industry_code"), F.coalesce("_m_name", F.when(c("_n_code").isNotNull(), c("industry"))).alias("industry_name"), source.alias("mapping_source"))
