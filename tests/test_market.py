"""Market operators on hand-made frames, and registered queries against DuckDB."""

import datetime as dt
import importlib
import math
import random
import shutil
import sys
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeloom import market
from tapeloom import oracles as o
from tapeloom import queries as core
from tapeloom.functions import columns as fc
from tapeloom.market import Market
from tapeloom.operators import backtest, candidates, factors, ledger, orderstats, quality, research, signals, versions
from tapeloom.oracles import OVERRIDES
from tapeloom.sources import adapters, normalize, store

DIR = "/root/testdata/sf0.001"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def bars(spark, *rows, code="600000"):
    """rows: open, high, low, close per day."""
    data = [(day(i), code, *map(float, r), 100.0, 1000.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "trade_date date, code string, open double, high double, low double, close double, volume double, amount double")


def test_daily_factors(spark):
    got = factors.daily_factors(bars(spark, (10, 11, 9, 10), (10, 12, 10, 11), (0, 0, 0, 0), (5, 6, 4, 5))).orderBy("trade_date").collect()
    assert got[0].pct_chg_1d is None and got[1].pct_chg_1d == pytest.approx(0.1)
    assert got[3].pct_chg_1d is None  # zero base
    assert got[1].ma5 == pytest.approx(10.5) and got[1].close_position_20 == pytest.approx(2 / 3) and got[0].above_ma5 is False
    assert factors.daily_factors(bars(spark, (1, 1, 1, 1)).where("false")).columns == factors.FACTORS
    flat = factors.daily_factors(bars(spark, (5, 5, 5, 5))).first()
    assert flat.close_position_20 == 0.0 and flat.volume_ratio_5 == 1.0


def test_percent_rank(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, 5.0), (1, None)], "d int, v double")
    assert sorted((r.r is None, r.r or 0) for r in df.select(factors.percent_rank_desc("v", "d").alias("r")).collect()) == [(False, 0.5), (False, 0.5), (False, 1.0), (True, 0)]


def test_column_functions(spark):
    df = spark.createDataFrame([("20240131", "sz.000001", "a, b,a", " Yes "), ("2024-01-31", "1", "", "0"), ("bad", "abc", None, None)], "d string, c string, f string, b string")
    got = df.select(fc.normalize_date("d").alias("d"), fc.normalize_code("c").alias("c"), fc.split_flags("f").alias("f"), fc.to_bool("b").alias("b"), fc.append_flags("f", (F.lit(True), "b"), (F.lit(True), "z")).alias("g")).collect()
    assert [r.d for r in got] == [dt.date(2024, 1, 31)] * 2 + [None] and [r.c for r in got] == ["000001", "000001", None]
    assert got[0].f == ["a", "b", "a"] and [r.b for r in got] == [True, False, False] and got[0].g == "a,b,z" and got[2].g == "b,z"
    one = spark.range(1).select(fc.safe_divide(F.lit(1.0), F.lit(0.0)).alias("x"), fc.safe_divide(F.lit(None).cast("double"), F.lit(0.0)).alias("y"), fc.dimension_list(F.lit('["a", "b"]')).alias("j"), fc.dimension_list(F.lit("a|b; c+a,nan")).alias("p"), *[fc.normalize_code(F.lit("SH600001x12"), m).alias(m) for m in ("first_run", "six_run", "joined")]).first()
    assert one.x == 0.0 and one.y is None and one.j == ["a", "b"] and one.p == ["a", "b", "c"] and one.first_run == one.six_run == "600001" and one.joined == "600001"


PLAN = "plan_id string, trade_date date, code string, action string, strategy_names string, strategy_versions string, max_holding_days int, entry_low double, entry_high double, stop_loss double, take_profit_1 double, take_profit_2 double"


@pytest.mark.parametrize("rows, want", [
    ([(10, 10, 10, 10), (13, 14, 12.5, 13)], ("gap_above_entry_range", None, None, 0)),
    ([(10, 10, 10, 10), (8, 8.5, 7, 8)], ("not_reach_entry_range", None, None, 0)),
    ([(10, 10, 10, 10), (10, 13, 8, 10)], ("", "stop_loss", 9.0, 1)),
    ([(10, 10, 10, 10), (10, 12.5, 9.6, 12)], ("", "take_profit_2", 12.0, 1)),
    ([(10, 10, 10, 10), (10, 10.2, 9.9, 10), (10, 11.2, 9.9, 11)], ("", "take_profit_1", 11.0, 2)),
    ([(10, 10, 10, 10), (10, 10.2, 9.9, 10), (10, 10.3, 9.8, 10.1)], ("", "time_exit", 10.1, 2)),
    ([(10, 10, 10, 10)], ("no_next_trading_day", None, None, 0)),
])
def test_plan_backtest(spark, rows, want):
    plan = spark.createDataFrame([("p", day(0), "600000", "buy_pullback", "x", "v1", 3, 9.5, 10.5, 9.0, 11.0, 12.0)], PLAN)
    r = backtest.plan_backtest(plan, bars(spark, *rows)).first()
    assert (r.invalid_reason, r.exit_reason, r.exit_price, r.holding_days or 0) == want and r.is_valid == (want[0] == "")


def test_signal_backtest(spark):
    b = bars(spark, *[(10 + i, 11 + i, 9 + i, 10 + i) for i in range(8)])
    s = spark.createDataFrame([(day(0), "600000", "a", "v1", 1.0), (day(5), "600000", "a", "v1", 1.0), (day(7), "600000", "a", "v1", 1.0), (day(0), "000009", "a", "v1", 1.0)], "trade_date date, code string, strategy_name string, strategy_version string, signal_strength double")
    got = {(r.signal_date, r.code): r for r in backtest.signal_backtest(s, b).collect()}
    r = got[day(0), "600000"]
    assert r.is_valid and r.entry_open == 11 and r.return_1d == pytest.approx(12 / 11 - 1) and r.max_drawdown_1d == pytest.approx(10 / 11 - 1)
    assert [got[k].invalid_reason for k in ((day(5), "600000"), (day(7), "600000"), (day(0), "000009"))] == ["insufficient_future_bars", "no_next_trading_day", "no_daily_bars_for_code"]
    perf = backtest.signal_performance(backtest.signal_backtest(s, b)).first()
    assert (perf.sample_count, perf.valid_count, perf.win_rate_1d) == (4, 1, 1.0)


def test_positions(spark):
    rows = [(day(0), "10:00", "600000", "buy", 10.0, 100.0, 1000.0), (day(1), "10:00", "600000", "buy", 20.0, 100.0, 2000.0), (day(2), "10:00", "600000", "sell", 18.0, 50.0, 900.0), (day(3), "10:00", "000001", "buy", 5.0, 10.0, 50.0), (day(3), "11:00", "000001", "sell", 5.0, 99.0, 495.0)]
    trades = spark.createDataFrame(rows, "trade_date date, trade_time string, code string, side string, price double, volume double, amount double")
    got = {r.code: r for r in ledger.positions(trades, bars(spark, *[(16, 16, 16, 16)] * 4), str(day(3))).collect()}
    a = got["600000"]
    assert (a.holding_volume, a.cost_amount, a.cost_price, a.floating_pnl, a.position_status) == (150.0, 2250.0, 15.0, 150.0, "profit_watch")
    assert got["000001"].holding_volume == 0 and got["000001"].cost_amount == 0 and got["000001"].t_plus_1_status == "not_sellable_today"
    later = ledger.positions(trades.where("code = '600000'"), bars(spark, (16, 16, 16, 16)), str(day(1))).first()
    assert later.frozen_volume == 100 and later.available_volume == 100


def test_explode_dimensions(spark):
    perf = spark.createDataFrame([("a,b", "v1,v2"), ("a", "v1,v2"), ("a,b", "v9"), ("a,b", "x,y,z"), ("", "v1")], "strategy_names string, strategy_versions string")
    valid = spark.createDataFrame([("a", "v1"), ("b", "v1"), ("b", "v2")], "strategy_name string, strategy_version string")
    got = sorted((r.strategy_names, r.strategy_versions, r.strategy_name, r.strategy_version) for r in research.explode_dimensions(perf, valid).collect())
    assert got == sorted([("a,b", "v1,v2", "a", "v1"), ("a,b", "v1,v2", "b", "v1"), ("a,b", "v1,v2", "b", "v2"), ("a", "v1,v2", "a", "v1"), ("a", "v1,v2", "a", "v2"), ("a,b", "v9", "a", "v9"), ("a,b", "v9", "b", "v9"), ("a,b", "x,y,z", "a", "v1"), ("a,b", "x,y,z", "b", "v1")])


def test_grid():
    rows = versions.grid()
    assert len(rows) == 266 and rows[1]["min_volume_ratio_5"] == 1.0 and rows[0]["strategy_version"] == "search_001"
    assert len(versions.named_versions()) == 24


def test_quality(spark):
    b = bars(spark, (10, 9, 11, 10), (-1, 1, -1, 0)).unionByName(bars(spark, (10, 9, 11, 10))).withColumn("code", F.when(F.col("open") < 0, "x").otherwise(F.col("code")))
    got = {r.check_name: r.issue_count for r in quality.quality_checks(b).collect()}
    assert got == {"empty_data": 0, "required_columns": 0, "null_values": 0, "duplicated_rows": 2, "invalid_price_relation": 2, "non_positive_price": 3, "negative_volume_amount": 0, "trade_date_format": 0, "code_format": 1}
    assert {r.check_name: r.issue_count for r in quality.quality_checks(b.drop("open", "high")).collect()}["required_columns"] == 2
    assert quality.quality_status(quality.quality_checks(b.where("false"))).first().overall_status == "error"


def test_missing_rates(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 2.0, None), (3, 3.0, 1.0)], "a int, b double, c double")
    groups = {"half": (["b", "c"], 0.5, "info"), "few": (["b", "absent"], 0.5, "info"), "gone": (["x"], 0.5, "warning"), "none": (["x"], 0.5, "info")}
    got = {r.check_name: (r.status, r.issue_count) for r in quality.missing_rate_checks(df, groups).collect()}
    assert got == {"half": ("warning", 2), "few": ("ok", 1), "gone": ("warning", 3), "none": ("info", 0)}
    assert {(r.status, r.issue_count, r.missing_rate) for r in quality.missing_rate_checks(df.where("false"), groups).collect()} == {("info", 0, None)}
    assert quality.table_status(df, "t").first().status == "ok" and quality.table_status(df.where("false"), "t").first().status == "warning"
    high = spark.createDataFrame([("high_missing",)] * 3, "status string")
    assert [quality.diagnostics_check(d, f).first().status for d, f in ((high, df), (high.limit(2), df), (high.where("false"), df), (df, df), (high, df.where("false")))] == ["warning", "ok", "warning", "warning", "info"]


def test_enabled_and_own_rules(spark):
    m = Market(spark, DIR)
    assert signals.enabled_rules() == ["trend_pullback", "breakout_volume", "support_rebound"]
    assert signals.enabled_rules({"trend_pullback": {"enabled": False}, "low_vol_trend": {"enabled": True}}) == ["breakout_volume", "support_rebound", "low_vol_trend"]
    assert {r.strategy_name for r in signals.run_strategies(m.enriched, params=OVERRIDES).select("strategy_name").distinct().collect()} <= set(signals.enabled_rules())
    twice = lambda f: f.limit(3).selectExpr("trade_date", "code", "'mine' AS strategy_name", "'7' AS signal_strength").unionByName(f.limit(3).selectExpr("trade_date", "code", "'mine' AS strategy_name", "'x' AS signal_strength"))
    one = spark.createDataFrame(m.enriched.limit(3).collect(), m.enriched.schema)
    got = signals.run_strategies(one, [twice]).collect()
    assert len(got) == 3 and {(r.strategy_version, r.signal_strength, r.entry_reason) for r in got} == {("v1", 7.0, None)}
    assert signals.run_strategies(one, []).count() == 0
    named = {"trend_pullback": {"v1": {}, "v2": {"enabled": False}}}
    assert [r["strategy_version"] for r in versions.named_versions(named=named)] == ["v1"]


def test_loosest_bounds_lose_no_signal(spark):
    """The prefilter against every version on its own."""
    m = Market(spark, DIR)
    rng = random.Random(4)
    rows = [r for n in signals.RULES for r in rng.sample([x for x in versions.named_versions(OVERRIDES) + versions.grid(overrides=OVERRIDES) if x["strategy_name"] == n], 3)]
    table = versions.version_table(spark, rows)
    every = signals.all_versions(m.enriched, table).groupBy("strategy_name", "strategy_version").count().collect()
    get = lambda k: F.col("branch") if k == "branch" else F.col(f"p_{k}")
    hit = F.coalesce(*[F.when(F.col("strategy_name") == n, signals._signal(m.enriched.columns, n, get, F.col("strategy_version"))) for n in signals.RULES])
    alone = m.enriched.crossJoin(table).withColumn("s", hit).where("s is not null").groupBy("strategy_name", "strategy_version").count().collect()
    assert sorted(every) == sorted(alone) and len(every) > 5


def test_positions_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for code in ("000001", "000002", "000003"):
        h = cost = 0.0
        for day in range(1, 40):
            side, v = rng.choice(["buy", "sell", "sell", "hold"]), float(rng.randint(0, 9))
            rows.append((f"2024-01-{day % 28 + 1:02d}" if day < 28 else f"2024-02-{day - 27:02d}", "10:00:00", code, side, 2.0 + day, v, None))
        for date, _, c, side, price, v, _ in sorted(r for r in rows if r[2] == code):
            if side == "buy":
                h, cost = h + v, cost + price * v
            elif side == "sell" and v > 0:
                h, cost = (h - v, cost - cost / h * v) if h > v else (0.0, 0.0)
        want[code] = (round(h, 6), round(cost, 6))
    trades = spark.createDataFrame(rows, "trade_date string, trade_time string, code string, side string, price double, volume double, amount double").withColumn("trade_date", F.col("trade_date").cast("date"))
    got = {r.code: (round(r.holding_volume, 6), round(r.cost_amount, 6)) for r in ledger.positions(trades, bars(spark, (10, 9, 11, 10)), "2024-03-01").collect()}
    assert got == want


def test_shared_market_follows_the_files(spark, tmp_path):
    for t in adapters.BASE:
        shutil.copy(f"{DIR}/{t}.parquet", tmp_path)
    one = market.shared(spark, str(tmp_path))
    assert market.shared(spark, str(tmp_path)) is one
    spark.read.parquet(f"{DIR}/lineitem.parquet").limit(10).write.parquet(str(tmp_path / "more.parquet"))
    assert market.shared(spark, str(tmp_path)) is not one


def test_keyed_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "r1"), (2, "b", "r1"), (None, "c", None)], "k int, v string, run_id string")
    new = spark.createDataFrame([(2, "x", "r1", 1), (2, "y", "r1", 2), (None, "z", None, 1)], "k int, v string, run_id string, s int")
    got = {(r.k, r.v) for r in store.upsert_by_key(old, new, ["k"], "s", null_safe=True).collect()}
    assert got == {(1, "a"), (2, "y"), (None, "z")}
    assert {r.v for r in store.upsert_run_scoped(old, new, ["k"], "s").collect()} == {"a", "y", "z"}
    assert store.delete_run(old, "r1").count() == 1
    path = str(tmp_path / "t")
    store.write_partitions(old, path, ["run_id"])
    for _ in range(2):  # loading again changes nothing
        table = store.read_table(spark, path, run_id="r1")
        store.write_partitions(store.upsert_by_key(table, new.where("run_id = 'r1'").drop("s").dropDuplicates(["k"]), ["k"]).select("k", "v", "run_id"), path, ["run_id"])
    assert spark.read.parquet(path).count() == 3
    store.replace_all(old, path + "2")
    assert store.write_active_config(old.withColumn("recommendation", F.lit("enable_observation")), path + "3").count() == 3


def test_trades_csv(spark, tmp_path):
    f = tmp_path / "trades.csv"
    f.write_text("trade_date,code,side,price,volume\n2024-01-02,sh600000,BUY,10,100\n20240103,1,hold,x,5\n")
    a, b = store.read_trades_csv(spark, str(f)).orderBy("trade_date").collect()
    assert (a.code, a.side, a.amount) == ("600000", "buy", 1000.0) and (b.code, b.side, b.price, b.amount) == ("000001", "unknown", None, None)
    with pytest.raises(ValueError):
        normalize.normalize_daily_bars(spark.createDataFrame([("a",)], "x string"))
    assert store.trading_dates(None, spark, "2024-01-01", "2024-01-05").count() == 5


def test_one_date_equals_all_dates(spark):
    m = Market(spark, DIR)
    whole = signals.rule(m.enriched, "support_rebound").where("trade_date = '1996-05-01'").collect()
    single = signals.rule(m.enriched.where("trade_date = '1996-05-01'"), "support_rebound").collect()
    assert sorted(whole) == sorted(single)


def test_versions_equal_single_rules(spark):
    m = Market(spark, DIR)
    rows = [r for r in versions.named_versions({"min_amount_ma5": 0.0}) if r["strategy_name"] == "trend_pullback"]
    every = signals.all_versions(m.enriched, versions.version_table(spark, rows)).where("strategy_version = 'v2_conservative'").drop("strategy_version").collect()
    one = signals.rule(m.enriched, "trend_pullback", versions.NAMED["trend_pullback"]["v2_conservative"]).drop("strategy_version").collect()
    assert sorted(every) == sorted(one) and every


def test_plans_are_native(spark):
    m = Market(spark, DIR)
    plan = m.enriched._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert factors.daily_factors(m.bars)._jdf.queryExecution().executedPlan().toString().count("Window [") <= 4


def frame(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else str(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["w05_daily_factors", "w06_industry_strength", "w07_market_regime", "p06_moneyflow_factors", "j01_enrich_factors", "g10_run_strategies", "c04_signal_backtest", "a19_quality_checks", "c14_positions", "s17_upsert_by_key", "j13_compare_providers"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in adapters.BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(core.oracle_sql()[name]).df()
    got = core.queries()[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and frame(got) == frame(want)


def test_entry_without_optional_part(monkeypatch):
    for gone in [m for m in sys.modules if m.startswith(("tapeloom.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, gone)
    monkeypatch.setitem(sys.modules, "tapeloom.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert not [n for n in entry.queries() if n.startswith("op")] and set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_fixed_text(spark):
    """Two decimals by a double's exact value, as Python writes them: ties of the shortest decimal, true halves, signs and neighbours."""
    random.seed(3)
    ties = [(2 * random.randrange(10**k) + 1) / 200 for k in range(1, 9) for _ in range(60)]
    values = [1.025, 1.005, 0.125, 0.375, 2.675, 0.005, 0.015, 1e-20, 0.0, -0.0, -0.001, 1e12 + 0.125, 12345678.125, *ties, *[-t for t in ties], *[math.nextafter(t, up) for t in ties for up in (0, 1e9)], *[random.uniform(-200, 200) for _ in range(500)]]
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", fc.fixed("v").alias("t")).collect()
    assert [(r.v, r.t) for r in got if r.t != f"{r.v:.2f}"] == []
    assert spark.range(1).select(fc.fixed(F.lit(None).cast("double")).alias("t")).first().t is None


#: What plan_sql reads of a pool.
POOL = "trade_date date, code string, name string, rank int, strategy_names string, strategy_versions string, active_signal_count bigint, avg_strategy_weight double, recommendations string, risk_flags string, close double, reason string, score double, pct_chg_1d double, pct_chg_5d double, volume_ratio_5 double, close_position_20 double, above_ma5 boolean, above_ma10 boolean, above_ma20 boolean"


def planned(spark, rows, columns):
    """Plans of a hand-made pool by Spark and by the SQL of the plans: rows with these columns."""
    got = candidates.generate_trade_plan(spark.createDataFrame(rows, POOL)).select("code", *columns)
    names = [x.split()[0] for x in POOL.split(", ")]
    kinds = {"string": "VARCHAR", "int": "INT"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pool (" + ", ".join(f"{n} {kinds.get(t, t)}" for n, t in (x.split() for x in POOL.split(", "))) + ", all_flags VARCHAR)")
    con.executemany(f"INSERT INTO pool VALUES ({', '.join('?' * (len(names) + 1))})", [[*r, r[names.index("risk_flags")]] for r in rows])
    doubles = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in columns if n.startswith("position_"))
    want = con.execute(f"SELECT code, {', '.join(columns)} FROM (SELECT *{f' REPLACE ({doubles})' if doubles else ''} FROM ({o.plan_sql('SELECT * FROM pool')}))").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(want)


def pool_row(i, close=100.0, weight=1.0, score=10.0, ratio=1.0, place=0.7):
    return (day(0), f"{i:06d}", "n", 1, "a", "v1", 1, weight, "observe", "", close, "r", score, 0.01, 0.0125, ratio, place, True, True, True)


def test_plan_text_ties(spark):
    """Figures of a plan's reason at ties of the second decimal: 1.025 is less as a double, 0.125 a true half."""
    rows = [pool_row(i, score=v, ratio=v, place=v) for i, v in enumerate([1.025, 0.125, 0.375, 1.005, 2.675, *[(2 * k + 1) / 200 for k in range(120, 200)]])]
    got, want = planned(spark, rows, ["plan_reason"])
    assert got == want and "volume ratio=1.02," in got[0][1]


def test_plan_ties(spark):
    """Whole plans whose prices and weights lie at ties, to the last bit: the product of 128.105 and 100 is below 12810.5."""
    weights = [(2 * k + 1) / 20000 for k in range(4000, 4200)]
    closes = [128.105, 1.005, 2.675, *[100 + (2 * k + 1) / 200 for k in range(500)]]
    rows = [pool_row(i, close=v, weight=weights[i % len(weights)]) for i, v in enumerate(closes)]
    got, want = planned(spark, rows, ["close", "avg_strategy_weight", "entry_low", "entry_high", "stop_loss", "take_profit_1", "take_profit_2", "position_low", "position_high", "plan_reason"])
    assert got == want and got[0][1] == 128.1


def test_performance_meets_bars_in_buckets(spark):
    """Reviews and performance are computed from trades and bars in buckets by code: not stored, not shuffled, and the rows of the general operator."""
    m = Market(spark, DIR, keep=True)
    columns = ["trade_date", "code", "side", "return_3d", "max_drawdown_5d", "invalid_reason", "performance_comment"]
    df = m.performance.select(*columns)
    got = sorted(map(str, df.collect()))
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not {"review", "performance"} & set(m.kept) and "actual_trades" in m.kept
    assert got and got == sorted(map(str, ledger.trade_performance(m.trades, m.bars, m.review).select(*columns).collect()))
    m.release()


def test_next_bar_order(spark):
    """First bar after each event, or on its date: before, between and after bars, on a date of one, of a code without bars, without a date."""
    b = bars(spark, *[(i, i, i, i) for i in range(3)]).withColumn("trade_date", F.expr("date_add(trade_date, cast(open as int))"))  # days 0, 2, 4
    e = spark.createDataFrame([(day(n), "600000") for n in range(-1, 6)] + [(day(0), "x"), (None, "600000")], "trade_date date, code string")
    for same, want in ((False, [0, 1, 1, 2, 2, None, None]), (True, [0, 0, 1, 1, 2, 2, None])):
        got = {(r.trade_date, r.code): r.bar and r.bar.open for r in backtest.next_bar(e, b, ["open"], same_day=same).collect()}
        assert [got[day(n), "600000"] for n in range(-1, 6)] == want and got[day(0), "x"] is None and got[None, "600000"] == 0


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    """A stored table leaves no shuffle files behind, and the session's setting is what it was."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in (lambda x: [x.apply(i) for i in range(x.size())])(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, before = files(), spark.conf.get(setting)
    df = spark.range(20000).select((F.col("id") % 50).alias("code"), F.rand(1).alias("x"))
    store.bucketed(df.groupBy("code", "x").count(), str(tmp_path / "t"), "code")
    orderstats.placed(df, ["code", "x"])
    m = Market(spark, DIR, keep=True)
    m._stored("t", lambda: df.groupBy("code").agg(F.sum("x")))
    for _ in range(40):
        if not files() - old:
            break
        time.sleep(0.5)
    assert not files() - old and spark.conf.get(setting) == before
    m.release()


def test_period_review_meets_dates(spark, monkeypatch):
    """Overlapping and empty periods against sums by hand; what meets the periods is a row per date, not per trade."""
    random.seed(5)
    rows = [(day(random.randrange(6)), f"{i % 7:06d}", "buy", random.choice(["matched", "no_plan"]), random.choice(["off_plan", "follow_plan", "deviation"]), random.choice(["", "chase_above_entry"]), random.random() < 0.8, random.choice([None, random.uniform(-1, 1)])) for i in range(400)]
    df = spark.createDataFrame(rows, "trade_date date, code string, side string, plan_match_status string, execution_status string, execution_flags string, is_valid boolean, return_3d double")
    df = df.withColumns({"return_1d": F.col("return_3d") * 2, "return_5d": F.lit(None).cast("double")})
    spans = {"a": (0, 2), "b": (1, 5), "c": (2, 2), "none": (30, 40)}
    periods = spark.createDataFrame([(k, day(x), day(y)) for k, (x, y) in spans.items()], "period string, start_date date, end_date date")
    met, plain = [], ledger.in_periods
    monkeypatch.setattr(ledger, "in_periods", lambda d, p: (met.append(d), plain(d, p))[1])
    got = {r.period: r for r in ledger.period_review(df, df, periods).collect()}
    assert [d.count() for d in met] == [6, 6]
    for k, (x, y) in spans.items():
        own = [r for r in rows if day(x) <= r[0] <= day(y)]
        counted = [r for r in own if r[6] and r[7] is not None]
        mean = lambda v: sum(v) / len(v) if v else None
        want = (len(own) or None, len({r[0] for r in own}) or None, sum(r[6] for r in own) if own else None, sum(r[4] == "off_plan" for r in own) if own else None)
        r = got[k]
        assert (r.actual_trade_count, r.trading_days, r.valid_performance_count, r.off_plan_count) == want
        assert r.avg_return_5d is None and r.best_code == (max((round(v[7], 9), v[1]) for v in counted)[1] if counted else None) and r.worst_code == (min((round(v[7], 9), v[1]) for v in counted)[1] if counted else None)
        for name, v in (("avg_return_3d", [v[7] for v in counted]), ("avg_return_1d", [2 * v[7] for v in counted]), ("off_plan_avg_return_3d", [v[7] for v in counted if v[4] == "off_plan"]), ("chase_avg_return_3d", [v[7] for v in counted if v[5]])):
            assert r[name] == (pytest.approx(mean(v)) if v else None)
