"""Data quality, provider comparison, diagnostics and small report aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import col, holds, number
from tapeloom.operators.orderstats import exact_quantiles

c = F.col
REQUIRED = ("trade_date", "code", "open", "high", "low", "close", "volume", "amount")
PRICES = ("open", "high", "low", "close")


def _sum(cond: Column) -> Column:
    return F.coalesce(F.sum(holds(cond).cast("bigint")), F.lit(0))


def _report(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """One aggregated row to one row per check; a positive count takes the check's status."""
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("bad"), x.cast("bigint").alias("issue_count")) for n, s, x in checks])
    out = df.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("check_name", F.when(c("issue_count") > 0, c("bad")).otherwise("ok").alias("status"), "issue_count")


def quality_checks(bars: DataFrame) -> DataFrame:
    """Report on a bar table: one aggregate over the rows and one over duplicated keys."""
    absent = [x for x in REQUIRED if x not in bars.columns]
    if absent:
        df = bars.agg(F.count(F.lit(1)).alias("n"))
        names = ("null_values", "duplicated_rows", "invalid_price_relation", "non_positive_price", "negative_volume_amount", "trade_date_format", "code_format")
        return _report(df, [("empty_data", "error", (c("n") == 0).cast("int")), ("required_columns", "error", F.lit(len(absent))), *[(x, "ok", F.lit(0)) for x in names]])
    p = {x: number(x) for x in (*PRICES, "volume", "amount")}
    wrong = reduce(lambda a, b: a | b, [holds(x) for x in (p["high"] < p["low"], p["open"] < p["low"], p["open"] > p["high"], p["close"] < p["low"], p["close"] > p["high"])])
    one = bars.agg(F.count(F.lit(1)).alias("n"), sum(_sum(c(x).isNull()) for x in REQUIRED).alias("nulls"), _sum(wrong).alias("relation"), sum(_sum(p[x] <= 0) for x in PRICES).alias("non_positive"), (_sum(p["volume"] < 0) + _sum(p["amount"] < 0)).alias("negative"), _sum(F.try_to_timestamp(c("trade_date").cast("string")).isNull()).alias("dates"), _sum(~F.coalesce(c("code").cast("string"), F.lit("")).rlike(r"^\d{6}$")).alias("codes"))
    twice = bars.groupBy("trade_date", "code").agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("dups"))
    df = one.join(F.broadcast(twice), F.lit(True))
    return _report(df, [("empty_data", "error", (c("n") == 0).cast("int")), ("required_columns", "error", F.lit(0)), ("null_values", "warning", c("nulls")), ("duplicated_rows", "warning", c("dups")), ("invalid_price_relation", "warning", c("relation")), ("non_positive_price", "warning", c("non_positive")), ("negative_volume_amount", "warning", c("negative")), ("trade_date_format", "warning", c("dates")), ("code_format", "warning", c("codes"))])


def missing_rate_checks(df: DataFrame, groups: dict[str, tuple[list[str], float, str]]) -> DataFrame:
    """Rows with any null among a group's columns that are there, their share, and a warning above the group's threshold.

    groups: check name to columns, threshold, and the status where none of the columns is there (warning: every row counts; info: none).
    An empty table is info with a count of 0."""
    parts, facts = {"_n": F.count(F.lit(1))}, []
    for name, (columns, most, absent) in groups.items():
        have = [x for x in columns if x in df.columns]
        hit = F.exists(F.array(*[c(x).isNull() for x in have]), lambda x: x) if have else F.lit(absent == "warning")
        parts[name] = _sum(hit)
        facts.append((name, F.when(c(name) > most * c("_n"), "warning").otherwise("ok") if have else F.lit(absent)))
    one = df.agg(*[x.alias(k) for k, x in parts.items()])
    rows = [F.struct(F.lit(k).alias("check_name"), F.when(c("_n") == 0, "info").otherwise(status).alias("status"), c(k).cast("bigint").alias("issue_count"), F.try_divide(c(k), c("_n")).alias("missing_rate")) for k, status in facts]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def table_status(df: DataFrame, name: str) -> DataFrame:
    """One row: a warning if the optional table is empty."""
    empty = F.count(F.lit(1)) == 0
    return df.agg(F.lit(name).alias("check_name"), F.when(empty, "warning").otherwise("ok").alias("status"), empty.cast("bigint").alias("issue_count"))


def diagnostics_check(diagnostics: DataFrame, factors: DataFrame, most: int = 3) -> DataFrame:
    """One row: a warning if *most* factors or more are mostly missing or nothing was diagnosed; info where there are no factors."""
    high = diagnostics.agg(F.count(F.lit(1)).alias("n"), _sum(c("status") == "high_missing").alias("k")) if "status" in diagnostics.columns else diagnostics.agg(F.lit(0).alias("n"), F.lit(0).alias("k"))
    rows = factors.agg(F.count(F.lit(1)).alias("rows"))
    status = F.when(c("rows") == 0, "info").when((c("n") == 0) | (c("k") >= most), "warning").otherwise("ok")
    return high.join(F.broadcast(rows), F.lit(True)).select(F.lit("factor_diagnostics_high_missing").alias("check_name"), status.alias("status"), F.when(c("rows") == 0, 0).otherwise(c("k")).cast("bigint").alias("issue_count"))


def factor_diagnostics(factors: DataFrame, names: list[str], scopes: dict[str, DataFrame] | None = None) -> DataFrame:
    """Coverage, distribution and means inside scopes (distinct trade_date, code) per factor: one unpivot and aggregate, and
    all quartiles from one layout in order of value."""
    df = factors
    scopes = scopes or {}
    for s, keys in scopes.items():
        df = df.join(keys.select("trade_date", "code").distinct().withColumn(f"_{s}", F.lit(True)), ["trade_date", "code"], "left")
    marks = [f"_{s}" for s in scopes]
    long = df.select(*marks, *[c(n).cast("double") for n in names]).unpivot(marks, names, "factor_name", "v") if marks else df.select(*[c(n).cast("double") for n in names]).unpivot([], names, "factor_name", "v")
    inside = [F.avg(F.when(c(f"_{s}"), c("v"))).alias(f"{s}_mean") for s in scopes]
    quarters = exact_quantiles(long, ["factor_name"], "v", [0.25, 0.5, 0.75]).select("factor_name", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "median", "p75"))])
    out = long.groupBy("factor_name").agg(F.count(F.lit(1)).alias("total_count"), F.count("v").alias("non_null_count"), F.avg("v").alias("mean"), F.when(F.count("v") == 1, 0.0).otherwise(F.stddev_samp("v")).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), *inside).join(quarters, "factor_name", "left")
    rate = 1 - F.try_divide(c("non_null_count"), c("total_count"))
    out = out.withColumn("missing_rate", rate)
    return out.withColumn("status", F.when(c("missing_rate") > 0.8, "high_missing").when(c("missing_rate") > 0.3, "medium_missing").otherwise("ok"))


FIELDS = {**dict.fromkeys(PRICES, 0.01), "volume": 0.20, "amount": 0.20}


def compare_providers(left: DataFrame, right: DataFrame, tolerances: dict[str, float] | None = None) -> DataFrame:
    """Rows only one side has, and one row per field whose relative difference exceeds its tolerance."""
    tolerances = tolerances or FIELDS
    key = ["trade_date", "code"]
    side = lambda df, s: df.select(*key, *[c(f).cast("double").alias(f"{f}_{s}") for f in tolerances], F.lit(True).alias(f"_{s}"))
    df = side(left, "l").join(side(right, "r"), key, "full_outer")

    def issue(field: str, most: float) -> Column:
        a, b = c(f"{field}_l"), c(f"{field}_r")
        diff = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))
        return F.when(holds(diff > most), F.struct(F.lit(field).alias("field"), a.alias("left_value"), b.alias("right_value"), diff.alias("relative_diff"), F.lit("warning").alias("status")))

    def absent(status: str) -> Column:
        null = F.lit(None).cast("double")
        return F.array(F.struct(F.lit("row").alias("field"), null.alias("left_value"), null.alias("right_value"), null.alias("relative_diff"), F.lit(status).alias("status")))

    issues = F.when(c("_r").isNull(), absent("missing_right")).when(c("_l").isNull(), absent("missing_left")).otherwise(F.array_compact(F.array(*[issue(f, t) for f, t in tolerances.items()])))
    return df.select(*key, F.explode(issues).alias("i")).select(*key, "i.*")


def provider_diff_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("field").agg(F.count(F.lit(1)).alias("issue_count"), F.max("relative_diff").alias("max_relative_diff"), F.avg("relative_diff").alias("avg_relative_diff"))


def outcome_distribution(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def holding_distributions(results: DataFrame) -> DataFrame:
    """Counts by strategy and holding days, and by strategy and exit reason, and metrics by holding days, in one table."""
    a = results.where("is_valid").groupBy("strategy_names", "holding_days").agg(F.count(F.lit(1)).alias("n")).select(F.lit("holding").alias("kind"), "strategy_names", c("holding_days").cast("string").alias("value"), "n", F.lit(None).cast("double").alias("avg_return"))
    b = results.where("is_valid").groupBy("strategy_names", "exit_reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("exit").alias("kind"), "strategy_names", c("exit_reason").alias("value"), "n", F.lit(None).cast("double").alias("avg_return"))
    d = results.groupBy("max_holding_days").agg(F.count_if("is_valid").alias("n"), F.avg(F.when(c("is_valid"), c("return_pct"))).alias("avg_return")).select(F.lit("max_days").alias("kind"), F.lit(None).cast("string").alias("strategy_names"), c("max_holding_days").cast("string").alias("value"), "n", "avg_return")
    return a.unionByName(b).unionByName(d)


def status_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [df.groupBy(c(s).alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("source"), "status", "n") for n, (df, s) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_profile(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and first and last date of each table, as one union of small aggregates."""
    def one(name: str, df: DataFrame, date: str | None) -> DataFrame:
        at = col(date).cast("date") if date else F.lit(None).cast("date")
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.min(at).alias("min_date"), F.max(at).alias("max_date"))

    out = reduce(DataFrame.unionByName, [one(n, df, d) for n, (df, d) in tables.items()])
    return out.withColumn("status", F.when(c("row_count") > 0, "ok").otherwise("empty"))


def coverage_state(factors: DataFrame, merged: list[str]) -> DataFrame:
    """Latest date, missing rate of merged columns, and strong and weak counts on the latest date."""
    last = factors.agg(F.max("trade_date").alias("latest_date"))
    df = factors.join(F.broadcast(last), F.lit(True))
    now = c("trade_date") == c("latest_date")
    gone = F.exists(F.array(*[c(m).isNull() for m in merged]), lambda x: x)
    return df.agg(F.max("latest_date").alias("latest_date"), F.count_if(now).alias("latest_rows"), F.avg(gone.cast("double")).alias("missing_rate"), F.count_if(now & (c("industry_strength_level") == "strong")).alias("strong_count"), F.count_if(now & (c("industry_strength_level") == "weak")).alias("weak_count"))


def quality_status(report: DataFrame) -> DataFrame:
    df = report.agg(F.count_if(c("status") == "error").alias("error_count"), F.count_if(c("status") == "warning").alias("warning_count"))
    return df.withColumn("overall_status", F.when(c("error_count") > 0, "error").when(c("warning_count") > 0, "warning").otherwise("ok"))


def available_dates(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select("trade_date") for t in tables]).distinct()


def latest_per_group(df: DataFrame, group: str, order: str = "trade_date") -> DataFrame:
    w = Window.partitionBy(group).orderBy(c(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_by(df: DataFrame, metric: str, n: int, tie: list[str]) -> DataFrame:
    """The n highest non-null values: planned as one take-ordered step."""
    return df.where(c(metric).isNotNull()).orderBy(c(metric).desc(), *tie).limit(n)


def page(df: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
