"""Evaluation, out-of-sample validation and admission of rule versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import dimension_list, holds, zero
from tapeloom.operators.backtest import signal_backtest, signal_performance
from tapeloom.operators.factors import dedup_last

c = F.col
KEY = ["strategy_name", "strategy_version"]


def ladder(default: tuple[str, ...], *steps: tuple[Column, tuple[str, ...]]) -> list[Column]:
    """Several text columns decided together, first true condition wins; unknown counts as false."""
    out = []
    for i, last in enumerate(default):
        x = None
        for cond, values in steps:
            x = F.when(holds(cond), values[i]) if x is None else x.when(holds(cond), values[i])
        out.append(x.otherwise(last))
    return out


def evaluate_versions(perf: DataFrame, min_valid: int = 30, min_win: float = 0.5, min_return: float = 0.0, max_drawdown: float = -0.08) -> DataFrame:
    n, w, r, d = zero("valid_count"), zero("win_rate_3d"), zero("avg_return_3d"), zero("avg_max_drawdown_3d")
    status, risk, advice = ladder(("neutral", "medium", "observe"), (n < min_valid, ("insufficient_samples", "unknown", "continue_backtest")), ((r < min_return) & (w < min_win), ("weak", "medium", "pause")), (d < max_drawdown, ("high_drawdown", "high", "reduce_or_pause")), ((w >= min_win) & (r >= min_return), ("qualified", "low", "enable_observation")))
    score = w * 40 + r * 100 + zero("median_return_3d") * 50 + d * 50 + F.least(n, F.lit(200.0)) / 200 * 10
    return perf.select(*KEY, "sample_count", "valid_count", "win_rate_3d", "avg_return_3d", "median_return_3d", "avg_max_drawdown_3d", F.round(score, 4).alias("evaluation_score"), status.alias("evaluation_status"), risk.alias("risk_level"), advice.alias("recommendation"))


def classify_oos(min_train: int = 30, min_validation: int = 10) -> tuple[Column, Column]:
    t, v = c("train_avg_return_3d"), c("validation_avg_return_3d")
    risk, status = ladder(("medium", "needs_more_observation"), (c("train_valid_count") < min_train, ("unknown", "insufficient_train_samples")), (c("validation_valid_count") < min_validation, ("unknown", "insufficient_validation_samples")), ((t > 0) & (v < 0), ("high", "failed_oos")), ((c("return_decay") < -0.03) | (c("win_rate_decay") < -0.15), ("medium", "unstable")), ((v >= 0) & (c("validation_win_rate_3d") >= 0.5), ("low", "passed_oos")))
    return risk, status


def train_validation_join(versions: DataFrame, train: DataFrame, validation: DataFrame) -> DataFrame:
    side = lambda df, p: df.select(*KEY, c("valid_count").alias(f"{p}_valid_count"), c("win_rate_3d").alias(f"{p}_win_rate_3d"), c("avg_return_3d").alias(f"{p}_avg_return_3d"), c("avg_max_drawdown_3d").alias(f"{p}_avg_drawdown_3d"))
    df = versions.select(*KEY).join(side(train, "train"), KEY, "left").join(side(validation, "validation"), KEY, "left")
    counts = {f"{p}_valid_count": F.coalesce(f"{p}_valid_count", F.lit(0)) for p in ("train", "validation")}
    return df.withColumns(counts | {f"{p}_{m}": zero(f"{p}_{m}") for p in ("train", "validation") for m in ("win_rate_3d", "avg_return_3d", "avg_drawdown_3d")})


def validate(joined: DataFrame, min_train: int = 30, min_validation: int = 10) -> DataFrame:
    """Decays, stability score, overfit risk and status of versions joined with both periods."""
    v = lambda m: c(f"validation_{m}")
    df = joined.withColumns({"return_decay": v("avg_return_3d") - c("train_avg_return_3d"), "win_rate_decay": v("win_rate_3d") - c("train_win_rate_3d"), "drawdown_worsening": v("avg_drawdown_3d") - c("train_avg_drawdown_3d")})
    score = v("win_rate_3d") * 40 + v("avg_return_3d") * 100 + v("avg_drawdown_3d") * 50 + F.least(v("valid_count"), F.lit(100)) / 100 * 10 - F.abs("return_decay") * 30 - F.abs("win_rate_decay") * 10
    risk, status = classify_oos(min_train, min_validation)
    return df.withColumns({"stability_score": F.round(score, 4), "overfit_risk": risk, "validation_status": status})


def walk_forward(signals: DataFrame, bars: DataFrame, versions: DataFrame, split: str, min_train: int = 30, min_validation: int = 10) -> DataFrame:
    """Signals and bars clipped to the time before *split* and from it on, backtested apart and compared."""
    def side(old: bool) -> DataFrame:
        keep = (c("trade_date") < split) if old else (c("trade_date") >= split)
        return signal_performance(signal_backtest(signals.where(keep), bars.where(keep)), medians=False)

    return validate(train_validation_join(versions, side(True), side(False)), min_train, min_validation)


def best_evaluation(named: DataFrame, searched: DataFrame) -> DataFrame:
    """The better of manual and searched evaluations per version; source mixed where both exist."""
    part = lambda df, s: df.select("strategy_name", F.coalesce("strategy_version", F.lit("v1")).alias("strategy_version"), F.lit(s).alias("source"), "valid_count", c("recommendation").alias("evaluation_recommendation"), "evaluation_score")
    both = part(named, "manual_version").unionByName(part(searched, "parameter_search"))
    best = both.groupBy(*KEY).agg(F.max_by(F.struct("source", "valid_count", "evaluation_recommendation", "evaluation_score"), F.struct(F.coalesce("evaluation_score", F.lit(float("-inf"))), c("source"))).alias("b"), F.countDistinct("source").alias("n"))
    return best.select(*KEY, F.when(c("n") > 1, "mixed").otherwise(c("b.source")).alias("source"), "b.valid_count", "b.evaluation_recommendation", "b.evaluation_score")


def merge_oos(base: DataFrame, validation: DataFrame) -> DataFrame:
    own = validation.select("strategy_name", F.coalesce("strategy_version", F.lit("v1")).alias("strategy_version"), c("validation_status").alias("oos_status"), c("overfit_risk").alias("oos_risk"), c("stability_score").alias("oos_stability_score"))
    return base.join(own, KEY, "left")


def select_buy_actions(perf: DataFrame) -> DataFrame:
    """Rows of buying actions: watch and sell words out, buy words or any trigger in; all rows if no action is given."""
    act = F.lower(F.trim(F.coalesce("action", F.lit(""))))
    buys = ~act.rlike(r"watch[_ ]?only|^watch$|sell") & (act.rlike(r"buy|breakout|support|long") | (zero("valid_count") > 0) | (zero("triggered_count") > 0))
    given = perf.agg(F.max(act != "").alias("_given"))
    return perf.join(F.broadcast(given), F.lit(True)).where(~holds(c("_given")) | buys).drop("_given")


def explode_dimensions(perf: DataFrame, valid: DataFrame) -> DataFrame:
    """Composite rows to one row per rule and version.

    A name takes its versions that are valid keys; else, in order: its own position if the lists are equally long, the
    only version, v1 if valid.  A single name takes all versions.  *valid* is a small dimension of known versions."""
    names, versions = dimension_list("strategy_names"), dimension_list("strategy_versions")
    df = perf.withColumns({"_names": names, "_versions": F.when(F.size(versions) > 0, versions).otherwise(F.array(F.lit("v1")))}).withColumn("_id", F.xxhash64(*perf.columns))
    df = df.select("*", F.posexplode("_names").alias("_pos", "strategy_name"))
    known = valid.select("strategy_name", "strategy_version").distinct().groupBy("strategy_name").agg(F.collect_set("strategy_version").alias("_known"))
    df = df.join(known, "strategy_name", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
    hit = F.filter("_versions", lambda v: F.array_contains(c("_known"), v))
    paired = F.when(F.size("_names") == 1, c("_versions")).when(F.size(hit) > 0, hit).when(F.size("_names") == F.size("_versions"), F.array(F.get("_versions", c("_pos")))).when(F.size("_versions") == 1, c("_versions")).when(F.array_contains("_known", "v1"), F.array(F.lit("v1"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("strategy_version", F.explode(paired)).drop("_names", "_versions", "_pos", "_known", "_id")


def weighted_mean(value: str, weight: str) -> Column:
    known = c(value).isNotNull()
    return F.coalesce(F.try_divide(F.sum(F.when(known, c(value) * zero(weight))), F.nullif(F.sum(F.when(known, zero(weight))), F.lit(0.0))), F.avg(value))


def admission_plan_aggregate(exploded: DataFrame) -> DataFrame:
    return exploded.groupBy(*KEY).agg(F.sum("valid_count").alias("trade_plan_valid_count"), F.coalesce(weighted_mean("trigger_rate", "plan_count"), F.try_divide(F.sum("triggered_count"), F.sum("plan_count"))).alias("trade_plan_trigger_rate"), weighted_mean("win_rate", "valid_count").alias("trade_plan_win_rate"), weighted_mean("avg_return", "valid_count").alias("trade_plan_avg_return"), weighted_mean("avg_max_drawdown", "valid_count").alias("trade_plan_avg_drawdown"))


def merge_plan_performance(base: DataFrame, perf: DataFrame) -> DataFrame:
    plan = admission_plan_aggregate(explode_dimensions(select_buy_actions(perf), base))
    return base.join(plan, KEY, "left")


#: Points of a recommendation and of an out-of-sample status.
ADVICE_POINTS = {"enable_observation": 30, "observe": 15, "continue_backtest": 5, "pause": -50, "reduce_or_pause": -30}
STATUS_POINTS = {"passed_oos": 30, "needs_more_observation": 10, "failed_oos": -50, "unstable": -25}


def admission_score(min_valid: int = 30) -> Column:
    points = lambda table, key: F.coalesce(*[F.when(c(key) == k, float(v)) for k, v in table.items()], F.lit(0.0))
    when = lambda cond, v: F.when(holds(cond), float(v)).otherwise(0.0)
    return points(ADVICE_POINTS, "evaluation_recommendation") + F.least(zero("evaluation_score"), F.lit(50.0)) + points(STATUS_POINTS, "oos_status") + F.least(zero("oos_stability_score"), F.lit(30.0)) + when(c("oos_risk") == "high", -40) + when(c("valid_count") < min_valid, -20) + when(c("trade_plan_trigger_rate") >= 0.3, 10) + when(c("trade_plan_win_rate") >= 0.5, 10) + when(c("trade_plan_avg_return") > 0, 10) + when(c("trade_plan_avg_drawdown") < -0.08, -20)


def admission_decision(min_valid: int = 30) -> tuple[Column, Column]:
    steps = [(zero("valid_count") < min_valid, ("insufficient_samples", "continue_research")), (c("oos_status").isin("failed_oos", "unstable") | holds(c("oos_risk") == "high"), ("oos_failed", "do_not_enable")), (c("evaluation_recommendation").isin("pause", "reduce_or_pause"), ("risk_rejected", "do_not_enable")), ((c("admission_score") >= 70) & (c("oos_status") == "passed_oos"), ("qualified_for_observation", "enable_observation_candidate")), (c("admission_score") >= 50, ("watchlist", "observe_more"))]
    status, advice = ladder(("research_only", "continue_research"), *steps)
    return status, advice


def strategy_admission(named: DataFrame, searched: DataFrame, validation: DataFrame, plan_perf: DataFrame, min_valid: int = 30) -> DataFrame:
    df = merge_plan_performance(merge_oos(best_evaluation(named, searched), validation), plan_perf)
    df = df.withColumn("admission_score", admission_score(min_valid))
    status, advice = admission_decision(min_valid)
    return df.withColumns({"admission_status": status, "admission_recommendation": advice})


def filter_active_versions(versions: DataFrame, active: DataFrame) -> DataFrame:
    return versions.join(active.select(*KEY).distinct(), KEY, "left_semi")


def eligible_candidate_keys(evaluation: DataFrame, validation: DataFrame) -> DataFrame:
    """Versions neither paused nor failed, unstable or of high risk out of sample."""
    own = validation.select(*KEY, "validation_status", "overfit_risk")
    df = evaluation.where(~F.coalesce("recommendation", F.lit("")).isin("pause", "reduce_or_pause")).select(*KEY).distinct().join(own, KEY, "left")
    return df.where(~F.coalesce("validation_status", F.lit("")).isin("failed_oos", "unstable") & (F.coalesce("overfit_risk", F.lit("")) != "high")).select(*KEY)


def filter_plans_by_candidates(plans: DataFrame, eligible: DataFrame) -> DataFrame:
    """Plans with an eligible rule and version among theirs; all plans if none has one at all.  plans need plan_id."""
    keys = explode_dimensions(plans.select("plan_id", "strategy_names", "strategy_versions"), eligible)
    hit = keys.join(eligible.select(*KEY), KEY, "left_semi").select("plan_id").distinct().withColumn("_hit", F.lit(True))
    any_hit = hit.agg((F.count(F.lit(1)) > 0).alias("_any"))
    df = plans.join(hit, "plan_id", "left").join(F.broadcast(any_hit), F.lit(True))
    return df.where(~c("_any") | c("_hit").isNotNull()).drop("_hit", "_any")


def filter_validation(validation: DataFrame, status: str | None = None) -> DataFrame:
    """One status, or without it everything unstable: risk high or medium, or status failed or unstable."""
    if status is not None:
        return validation.where(c("validation_status") == status)
    return validation.where(c("overfit_risk").isin("high", "medium") | c("validation_status").isin("failed_oos", "unstable"))


def evaluation_with_performance(evaluation: DataFrame, perf: DataFrame) -> DataFrame:
    first = dedup_last(perf.withColumn("_seq", F.xxhash64(*[x for x in perf.columns])), KEY, "_seq", first=True).drop("_seq")
    extra = [x for x in first.columns if x not in evaluation.columns]
    return evaluation.join(first.select(*KEY, *extra), KEY, "left")


def top_n_per_strategy(evaluation: DataFrame, n: int = 3) -> DataFrame:
    order = Window.partitionBy("strategy_name").orderBy(c("evaluation_score").desc_nulls_last(), "strategy_version")
    return evaluation.withColumn("place", F.row_number().over(order)).where(c("place") <= n)
