"""Exact order statistics, positions in chunks, and periods, against plain code."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import ledger
from tapeloom.operators.orderstats import exact_quantiles, placed, with_medians


@pytest.fixture
def parts(spark):
    """As many shuffle partitions as a larger table would have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_of_groups(spark):
    rng = random.Random(6)
    groups = {"a": [rng.gauss(0, 5) for _ in range(1001)], "b": [1.0], "c": [2.0, 4.0], None: [float(rng.randint(0, 3)) for _ in range(300)], "d": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("d", None), ("a", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    ps = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", ps).collect()}
    assert got.keys() == {"a", "b", "c", None}
    for g, r in got.items():
        assert r["n"] == len(groups[g])
        assert np.allclose(r["q"], np.quantile(groups[g], ps), rtol=0, atol=1e-12)
    assert exact_quantiles(df.where("g = 'd'"), ["g"], "v", ps).collect() == []


def test_one_group_with_one_value_is_spread(spark, parts):
    df = spark.range(200_000).select(F.lit("x").alias("g"), F.when(F.col("id") % 10 < 9, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    df = df.repartition(8)
    rows = placed(df, ["g", "v"])
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 0.6 * sum(sizes)
    values = sorted([0.0] * 180_000 + [float(i) for i in range(200_000) if i % 10 == 9])
    (r,) = exact_quantiles(df, ["g"], "v", [0.5, 0.95, 0.99]).collect()
    assert np.allclose(r["q"], np.quantile(values, [0.5, 0.95, 0.99]))


def test_medians_beside_aggregates(spark):
    rows = [(k, i, None if i % 4 == 0 else float((i * 37) % 11)) for k in ("p", None) for i in range(41)] + [("empty", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    out = with_medians(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), df, ["k"], {"m": F.col("v"), "double": F.col("v") * 2})
    got = {r["k"]: (r["n"], r["m"], r["double"]) for r in out.collect()}
    m = float(np.median([v for k, _, v in rows if k == "p" and v is not None]))
    assert got == {"p": (41, m, 2 * m), None: (41, m, 2 * m), "empty": (1, None, None)}


def folded(trades):
    h = cost = 0.0
    for _, _, side, v, a in sorted(trades):
        if side == "buy":
            h, cost = h + v, cost + a
        elif v > 0:
            left = h - v
            h, cost = (left, cost * left / h) if left > 1e-9 else (0.0, 0.0)
    return h, cost


def test_positions_in_chunks(spark, monkeypatch, parts):
    monkeypatch.setattr(ledger, "CHUNK", 7)
    rng = random.Random(2)
    codes = {"hot": 900, "few": 3, "sells": 20, "one": 1}
    day, rows = datetime.date(2024, 1, 1), {}
    for code, n in codes.items():
        rows[code] = []
        for i in range(n):
            side = "sell" if code == "sells" or rng.random() < 0.45 else "buy"
            v = float(rng.choice([0, 1, 2, 5, 100]))
            rows[code].append((day + datetime.timedelta(i // 3), f"{i % 3:02d}:00:00", side, v, v * rng.randint(1, 9)))
    data = [(code, *t[:3], 1.0, t[3], t[4]) for code, ts in rows.items() for t in ts]
    df = spark.createDataFrame(data, "code string, trade_date date, trade_time string, side string, price double, volume double, amount double").repartition(5)
    got = {r["code"]: (r["h"], r["cost"]) for r in ledger._folded(df).collect()}
    for code, ts in rows.items():
        h, cost = folded(ts)
        if code in got:
            assert abs(got[code][0] - h) < 1e-9 and abs(got[code][1] - cost) < 1e-6 * max(1, cost)
        else:
            assert (h, cost) == (0, 0)
    chunks = placed(df, ["code", "trade_date", "trade_time"]).where("code = 'hot'").select("_part").distinct().count()
    assert chunks > 1


def test_periods_meet_dates(spark):
    rng = random.Random(9)
    start = datetime.date(2020, 1, 1)
    dates = [start + datetime.timedelta(rng.randint(0, 800)) for _ in range(300)]
    periods = [(f"p{i}", a, a + datetime.timedelta(rng.choice([-1, 0, 1, 5, 28, 31, 59, 366, 700]))) for i, a in enumerate(start + datetime.timedelta(rng.randint(-40, 700)) for _ in range(120))]
    periods += [("month", datetime.date(2020, 2, 1), datetime.date(2020, 2, 29)), ("null", None, start)]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(dates)] + [(None, -1)], "trade_date date, i int")
    table = spark.createDataFrame(periods, "period string, start_date date, end_date date")
    joined = ledger.in_periods(df, table)
    got = sorted((r["period"], r["i"]) for r in joined.collect())
    assert got == sorted((p, i) for p, a, b in periods if a for i, d in enumerate(dates) if a <= d <= b)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
