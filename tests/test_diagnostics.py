"""Diagnostics against values worked out by hand or by one pass over small series."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.frames import Series
from quantspark.functions import kernels
from quantspark.operators import diagnostics as dg
from quantspark.operators import models

S = Series(("asset",), ("ts",))


def series(spark, values, kind="double", name="x"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"asset string, ts long, {name} {kind}")


def test_range_volatility_of_known_bars(spark):
    bars = spark.createDataFrame([("a", i, 10.0, 12.0, 9.0, 11.0) for i in range(3)] + [("a", 3, None, None, None, None)], "asset string, ts long, open double, high double, low double, close double")
    rows = sorted(dg.range_volatility(bars, S, n=2, periods=1).collect(), key=lambda r: r["ts"])
    wide, body = math.log(12 / 9) ** 2, math.log(11 / 10) ** 2
    assert rows[0]["parkinson"] is None and rows[3]["parkinson"] is None
    assert rows[1]["parkinson"] == pytest.approx(math.sqrt(wide / (4 * math.log(2))))
    assert rows[2]["garman_klass"] == pytest.approx(math.sqrt(0.5 * wide - (2 * math.log(2) - 1) * body))


def test_runs_of_alternating_and_one_sided_series(spark):
    got = dg.runs_test(series(spark, [1.0, -1.0] * 10 + [None]), S, "x").first()
    both = 2 * 10 * 10
    z = (20 - (both / 20 + 1)) / math.sqrt(both * (both - 20) / (400 * 19))
    assert (got["n"], got["wins"], got["runs"]) == (20, 10, 20) and got["z"] == pytest.approx(z)
    assert got["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)
    assert dg.runs_test(series(spark, [1.0, 2.0]), S, "x").first()["p"] == 1.0
    assert dg.runs_test(series(spark, []), S, "x").collect() == []


def test_co_moments_of_a_levered_market(spark):
    rng = np.random.default_rng(3)
    b = rng.normal(0, 0.01, 60)
    a = np.where(b < 0, 2 * b, 0.5 * b)
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(a, b, strict=True)] + [("a", None, 1.0), ("none", 0.1, 0.2)], "asset string, x double, m double")
    got = {r["asset"]: r for r in dg.co_moments(df, ["asset"], "x", "m").collect()}
    row = got["a"]
    assert row["down_beta"] == pytest.approx(2) and row["up_beta"] == pytest.approx(0.5) and row["n"] == 60
    x, y, scale = a - a.mean(), b - b.mean(), a.std(ddof=1) * b.std(ddof=1) ** 2
    assert row["coskewness"] == pytest.approx((x * y**2).mean() / scale, rel=1e-6)
    assert row["cokurtosis"] == pytest.approx((x * y**3).mean() / (scale * b.std(ddof=1)), rel=1e-6)
    assert row["up_capture"] == pytest.approx(100 * (np.prod(1 + a[b > 0]) - 1) / (np.prod(1 + b[b > 0]) - 1))
    assert got["none"]["down_beta"] is None and got["none"]["coskewness"] is None and got["none"]["down_capture"] == 100.0


def test_breaches_that_cluster(spark):
    breaches = [False] * 20 + [True] * 5 + [False] * 20
    df = spark.createDataFrame([("a", i, 0.1, b) for i, b in enumerate(breaches)], "asset string, ts long, var double, breach boolean")
    got = dg.breach_independence(df, S).first()
    assert (got["n00"], got["n01"], got["n10"], got["n11"]) == (38, 1, 1, 4)
    free = 38 * math.log(38 / 39) + math.log(1 / 39) + math.log(1 / 5) + 4 * math.log(4 / 5)
    one = 39 * math.log(39 / 44) + 5 * math.log(5 / 44)
    assert got["lr_independence"] == pytest.approx(-2 * (one - free)) and got["p_independence"] < 0.001


def test_persistence_of_short_and_long_signals(spark):
    rows = [("a", i, v) for i, v in enumerate([1, 1, -1, -1, -1, 1])] + [("b", 0, 1)]
    got = {r["asset"]: r for r in dg.signal_persistence(spark.createDataFrame(rows, "asset string, ts long, signal int"), S, n=3).collect()}
    a = got["a"]
    assert (a["runs"], a["longest_run"], a["shortest_run"], a["mean_run"], a["flip_rate"]) == (3, 3, 1, 2.0, 0.4)
    # Stretches of three: 1 1 -1, 1 -1 -1, -1 -1 -1, -1 -1 1.
    assert (a["mean_rate"], a["highest_rate"], a["lowest_rate"]) == (0.375, 0.5, 0.0)
    assert (got["b"]["runs"], got["b"]["flip_rate"], got["b"]["mean_rate"]) == (1, 0.0, 0.0)


def test_habits_of_a_hasty_trader(spark):
    pnl = [-1.0, 2.0, -3.0, 1.0, 1.0, None]
    at = ["01 10:00", "01 12:00", "03 09:00", "05 09:00", "05 09:30", "05 09:40"]
    df = spark.createDataFrame([("a", f"2024-01-{t}:00", p) for t, p in zip(at, pnl, strict=True)], "asset string, t string, pnl double").select("asset", F.to_timestamp("t").alias("ts"), "pnl")
    rows = sorted(dg.trade_habits(df, S, times=1.5).collect(), key=lambda r: r["ts"])
    assert [r["revenge"] for r in rows] == [False, True, False, False, False, False]
    assert [r["recent"] for r in rows] == [1, 2, 1, 1, 2, 3]
    assert [r["overtrading"] for r in rows] == [False, False, False, False, False, True]


def test_scales_at_their_ends(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.1, 0.2, 0.3, None)], "x double")
    rows = df.select(*[c.alias(n) for n, c in dg.drawdown_scales(F.col("x")).items()]).collect()
    assert [tuple(r) for r in rows[:5]] == [
        (1.0, 1.0, 1.0, 1.0), pytest.approx((0.8125, 0.671875, 0.953125, 0.8)), pytest.approx((0.625, 0.4375, 0.8125, 0.5)), (0.25, 0.25, 0.25, 0.1), (0.25, 0.25, 0.25, 0.0),
    ]
    assert tuple(rows[5]) == (None,) * 4


def test_network_of_a_triangle_and_a_loner(spark):
    rng = np.random.default_rng(4)
    base, lone = rng.normal(size=50), rng.normal(size=50)
    moves = {"a": base, "b": base + 0.1 * rng.normal(size=50), "c": -base, "d": lone}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in moves.items() for i, v in enumerate(vs)] + [("e", 0, None)], "asset string, ts long, x double")
    got = {r["asset"]: (r["degree"], r["triangles"], r["clustering"]) for r in dg.correlation_network(df, "asset", "ts", "x", 0.8).collect()}
    assert got == {"a": (2, 1, 1.0), "b": (2, 1, 1.0), "c": (2, 1, 1.0), "d": (0, 0, None)}


def test_thresholds_earn_what_they_trade(spark):
    df = spark.createDataFrame([(0.55, -1.0), (0.65, 2.0), (0.35, -0.5), (0.2, 1.0), (None, 9.0)], "p double, y double")
    got = {r["threshold"]: (r["pnl"], r["best"]) for r in dg.threshold_grid(df, "p", "y").collect()}
    assert got == {0.5: (0.5, False), 0.6: (1.5, True), 0.7: (-1.0, False)}


def test_policy_learns_after_five_errors(spark):
    rows = [("a", i, 0.9, -1.0) for i in range(5)] + [("a", 5, 0.52, 1.0), ("a", 6, None, 1.0)]
    got = sorted(kernels.threshold_policy(spark.createDataFrame(rows, "asset string, ts long, prob_up double, ret double"), S).collect(), key=lambda r: r["ts"])
    assert [r["signal"] for r in got] == [1] * 5 + [0, 0]
    assert got[4]["threshold"] == 0.5 and got[5]["threshold"] == pytest.approx(0.1 * 0.9 + 0.9 * 0.5)


def test_contributions_sum_to_the_whole(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3)) * [1, 2, 3]
    df = spark.createDataFrame([(f"{j}", i, float(x[i, j])) for i in range(40) for j in range(3)] + [("0", 99, 5.0)], "asset string, ts long, ret double")
    got = {r["asset"]: r for r in dg.risk_contributions(df).collect()}
    cov, w = np.cov(x.T), np.full(3, 1 / 3)
    sigma = math.sqrt(w @ cov @ w)
    for j in range(3):
        assert got[str(j)]["marginal"] == pytest.approx((cov @ w)[j] / sigma)
    assert sum(r["share"] for r in got.values()) == pytest.approx(1.0)


def test_search_by_windows_scores_as_the_callback(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(v)) for k, n in (("long", 120), ("short", 6)) for i, v in enumerate(100 + rng.normal(size=n).cumsum())]
    df = spark.createDataFrame(rows, "asset string, ts long, price double")
    want = {(r["asset"], r["fast"], r["slow"]): r["score"] for r in models.parameter_search(df, S, {"fast": (2, 5), "slow": (8, 20)}).collect()}
    got = {(r["asset"], r["fast"], r["slow"]): r["score"] for r in models.crossover_search(df, S, (2, 5), (8, 20)).collect()}
    assert got.keys() == want.keys() == set(itertools.product(("long", "short"), (2, 5), (8, 20)))
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
