"""Stored keyed tables, incremental factors and exact order statistics against plain code."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import increment
from tapeloom.operators.factors import daily_factors
from tapeloom.sources.adapters import view
from tapeloom.sources.keyed import PART, ConcurrentWrite, KeyedTable, by_hash, by_month

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, data, schema="k int, run string, v int"):
    return spark.createDataFrame(data, schema)


def test_merge_touches_only_its_partitions(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], F.pmod("k", F.lit(4)).cast("string"))
    t.merge(frame(spark, [(i, "a", i) for i in range(20)]))
    first = t.manifest()["parts"]
    t.merge(frame(spark, [(1, "b", 100), (5, "b", 500), (41, "b", 41)]).union(frame(spark, [(1, "b", 100)])))
    second = t.manifest()["parts"]
    assert {p for p in first if first[p] != second[p]} == {f"{PART}=1"}
    want = {i: ("a", i) for i in range(20)} | {1: ("b", 100), 5: ("b", 500), 41: ("b", 41)}
    assert rows(t.read()) == sorted((k, *v) for k, v in want.items())
    assert rows(t.read(version=0)) == [(i, "a", i) for i in range(20)]
    t.merge(t.read().where("k < 3").withColumn("v", F.col("v") + 1))  # reads from itself
    assert rows(t.read().where("k < 3")) == [(0, "a", 1), (1, "b", 101), (2, "a", 3)]
    assert t.versions() == [1, 2]


def test_last_by_sequence_and_null_keys(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k", "run"], by_hash("k", parts=3))
    t.merge(frame(spark, [(1, None, 1), (None, "a", 2), (2, "x", 3)]))
    new = frame(spark, [(1, None, 10, 1), (1, None, 11, 2), (None, "a", 20, 1), (None, None, 30, 1)], "k int, run string, v int, s int")
    t.merge(new, seq="s")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted((tuple(r) for r in t.read().collect()), key=key) == sorted([(1, None, 11), (None, "a", 20), (None, None, 30), (2, "x", 3)], key=key)


def test_scope_delete_and_whole_partitions(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k", "run"], by_hash("k", parts=4))
    t.merge(frame(spark, [(i, "ab"[i % 2], i) for i in range(12)]))
    t.replace_scope(frame(spark, [(100, "b", 1), (101, "b", 2)]), ["run"])
    assert rows(t.read()) == [(i, "a", i) for i in range(0, 12, 2)] + [(100, "b", 1), (101, "b", 2)]
    t.delete(F.col("run") == "a")
    assert rows(t.read()) == [(100, "b", 1), (101, "b", 2)]
    t.delete(F.col("run") == "nobody")
    t.delete(F.col("k") > 0)
    assert rows(t.read()) == []
    runs = KeyedTable(spark, str(tmp_path / "runs"), ["run", "k"], F.col("run"))
    runs.merge(frame(spark, [(1, "r 1/x", 1), (2, "r 1/x", 2), (1, "r2", 1), (9, None, 9)]))
    kept = runs.manifest()["parts"]
    runs.replace_parts(frame(spark, [(7, "r 1/x", 7)]))
    assert sorted(map(str, rows(runs.read().fillna("-", ["run"])))) == ["(1, 'r2', 1)", "(7, 'r 1/x', 7)", "(9, '-', 9)"]
    assert sum(kept[p] == s for p, s in runs.manifest()["parts"].items()) == 2
    runs.delete(F.col("run").isNull())
    assert rows(runs.read()) == [(1, "r2", 1), (7, "r 1/x", 7)]


def test_a_dead_run_changes_nothing(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    t.merge(frame(spark, [(i, "a", i) for i in range(10)]))
    before, state = rows(t.read()), t.manifest()

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            t.merge(frame(spark, [(1, "z", -1)]))
    again = KeyedTable(spark, t.path, ["k"])
    assert rows(again.read()) == before and again.manifest() == state
    assert again.vacuum() and not again.vacuum()
    assert rows(again.read()) == before
    assert sorted(os.listdir(f"{t.path}/manifests")) == [n for n in sorted(os.listdir(f"{t.path}/manifests")) if n.startswith(("v", ".v"))]


def test_two_writers_and_schema(spark, tmp_path, monkeypatch):
    t, other = (KeyedTable(spark, str(tmp_path / "t"), ["k"]) for _ in range(2))
    t.merge(frame(spark, [(1, "a", 1)]), properties={"x": "1"})
    old = t.manifest()
    other.merge(frame(spark, [(2, "b", 2)]))
    with monkeypatch.context() as m:
        m.setattr(t, "manifest", lambda version=None: old)
        with pytest.raises(ConcurrentWrite):
            t.merge(frame(spark, [(3, "c", 3)]))
    assert rows(t.read()) == [(1, "a", 1), (2, "b", 2)] and t.properties() == {"x": "1"}
    t.merge(frame(spark, [(2, 5)], "k int, extra int"))
    assert sorted(t.read().columns) == ["extra", "k", "run", "v"] and t.read().where("extra = 5").count() == 1
    t.merge(t.read().limit(0), properties={"x": "2"})
    assert t.read().count() == 2 and t.properties() == {"x": "2"}
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "none"), ["k"]).read()


def scanned(df):
    """Files that the plan's scans chose."""
    df.collect()
    return sum(int(x.metrics().apply("numFiles").value()) for x in _scans(df._jdf.queryExecution().executedPlan()))


def _scans(plan):
    name = plan.getClass().getSimpleName()
    if name == "FileSourceScanExec":
        return [plan]
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    return [s for p in [*inner, *(children.apply(i) for i in range(children.size()))] for s in _scans(p)]


def test_incremental_factors(spark, tmp_path):
    bars = KeyedTable(spark, str(tmp_path / "bars"), ["trade_date", "code"], by_month())
    whole = view(spark, SF, "bars").select(*increment.BARS)
    # One code stops early: its halo lies far back; another begins late.
    codes = [r[0] for r in whole.select("code").distinct().orderBy("code").limit(2).collect()]
    whole = whole.where(~((F.col("code") == codes[0]) & (F.col("trade_date").between("1995-01-01", "1997-06-01")))).where(~((F.col("code") == codes[1]) & (F.col("trade_date") < "1997-01-01")))
    bars.merge(whole)
    whole = bars.read().select(*increment.BARS)
    table = increment.factor_table(str(tmp_path / "factors"), bars)
    want = {(r["trade_date"], r["code"]): tuple(r) for r in daily_factors(whole).collect()}
    first = increment.refresh_factors(bars, table, until="1996-12-01")
    assert first.agg(F.max("trade_date")).first()[0] == datetime.date(1996, 12, 1)
    added = increment.refresh_factors(bars, table, until="1997-03-01")
    assert {r[0] for r in added.select("trade_date").distinct().collect()} == {datetime.date(1997, m, 1) for m in (1, 2, 3)}
    increment.refresh_factors(bars, table)
    assert increment.refresh_factors(bars, table).count() == 0
    got = {(r["trade_date"], r["code"]): tuple(r) for r in table.read().select(*daily_factors(whole).columns).collect()}
    assert got == want and table.properties()["through"] == str(max(want)[0])
    # What a later run reads: the months since the mark, by the scan's own filter, and no other files.
    late = increment.bars_after(bars, "1998-01-01")
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert PART in plan.split("PartitionFilters:")[1].split("]")[0]
    months = {r[0] for r in whole.where("trade_date >= '1998-01-01'").select(F.date_format("trade_date", "yyyy-MM")).distinct().collect()}
    assert len(months) <= scanned(late) <= scanned(bars.read()) - 30


def test_corrected_bars(spark, tmp_path):
    bars = KeyedTable(spark, str(tmp_path / "bars"), ["trade_date", "code"], by_month())
    bars.merge(view(spark, SF, "bars").select(*increment.BARS))
    table = increment.factor_table(str(tmp_path / "factors"), bars)
    increment.refresh_factors(bars, table, until="1997-12-01")
    fixed = bars.read().where("code = '000001' and trade_date = '1997-10-01'").withColumn("close", F.col("close") * 2)
    assert fixed.count() == 1
    bars.merge(fixed)
    increment.rebuild_codes(bars, table, fixed.select("code"))
    increment.refresh_factors(bars, table)
    columns = daily_factors(bars.read()).columns
    assert rows(table.read().select(*columns).na.fill(-1.0)) == rows(daily_factors(bars.read().select(*increment.BARS)).na.fill(-1.0))


def test_bucketed_tables_join_without_exchange(spark, tmp_path, monkeypatch):
    from tapeloom.operators import factors
    from tapeloom.sources import store

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        month = F.date_format("trade_date", "yyyy-MM").alias("month")
        tables = {n: view(spark, SF, n) for n in ("bars", "daily_basic", "stock_limits", "suspend_daily", "moneyflow")}
        held = {n: store.bucketed(df.select("*", month), str(tmp_path / n), "code", 4, "month") for n, df in tables.items()}
        late = {n: df.where("month >= '1998-01'").drop("month") for n, df in held.items()}
        joined = factors.enrich_factors(factors.daily_factors(late["bars"]), late["daily_basic"], late["stock_limits"], late["suspend_daily"], factors.moneyflow_factors(late["moneyflow"]))
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert plan.count("PartitionFilters: [isnotnull(month") >= 5
        plain = {n: df.where("date_format(trade_date, 'yyyy-MM') >= '1998-01'") for n, df in tables.items()}
        want = factors.enrich_factors(factors.daily_factors(plain["bars"]), plain["daily_basic"], plain["stock_limits"], plain["suspend_daily"], factors.moneyflow_factors(plain["moneyflow"]))
        digest = lambda df: rows(df.select("trade_date", "code", F.round("close", 6), F.round("turnover_rate", 6), F.round("up_limit", 6), "is_suspended", F.round("moneyflow_score", 6)).na.fill(-1.0))
        assert digest(joined) == digest(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
