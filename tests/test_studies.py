"""Event studies and reports against values worked out by hand."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.frames import Series
from quantspark.operators import studies as st

S = Series(("asset",), ("ts",))


def test_event_study_finds_the_jump(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(0, 0.01, 40)
    x = 0.002 + 1.5 * m
    x[30] += 0.1
    df = spark.createDataFrame([("a", i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, m, strict=True))], "asset string, ts long, ret double, market double")
    events = df.where("ts in (0, 30)")
    row = st.event_study(df, events, S, estimate=20).collect()
    assert len(row) == 1 and row[0]["ts"] == 30 and row[0]["n"] == 3
    assert row[0]["beta"] == pytest.approx(1.5) and row[0]["car"] == pytest.approx(0.1) and row[0]["highest"] == pytest.approx(0.1)
    assert row[0]["t_stat"] == pytest.approx(0.1 / (x[11:29].std(ddof=1) * 3**0.5))


def test_filters_by_rule(spark):
    df = spark.createDataFrame([(1, True, True, None), (2, True, False, False), (3, True, True, True), (4, None, None, None)], "id int, a boolean, b boolean, c boolean")
    tests = [F.col(c) for c in "abc"]
    ids = lambda rule: sorted(r["id"] for r in st.filtered(df, tests, rule).collect())
    assert (ids("all"), ids("any"), ids("majority")) == ([3], [1, 2, 3], [1, 3])
    with pytest.raises(ValueError):
        st.filtered(df, tests, "most")


def test_turnover_splits_into_drift_and_trading(spark):
    side = lambda rows: spark.createDataFrame(rows, "k string, weight double")
    moves = spark.createDataFrame([("A", 0.5), ("B", None)], "k string, ret double")
    got = st.turnover_parts(side([("A", 0.5), ("B", 0.5)]), side([("A", 0.6), ("C", 0.4)]), moves, "k").first()
    # Drift moves A to .75 / 1.25 = .6 and B to .4.
    assert tuple(got)[:3] == pytest.approx((0.5, 0.1, 0.4))
    assert tuple(got)[3:] == (1, 1, 1, 0)
    assert tuple(st.turnover_parts(side([]), side([]), moves, "k").first()) == (0.0, 0.0, 0.0, 0, 0, 0, 0)


def test_rebalance_on_the_first_day_of_a_month(spark):
    d = datetime.date
    df = spark.createDataFrame([(d(2024, 1, 3), "A", 60.0), (d(2024, 1, 3), "B", 40.0), (d(2024, 1, 9), "A", 1.0), (d(2024, 2, 1), "A", 10.0), (d(2024, 3, 1), "A", 0.0)], "day date, asset string, value double")
    targets = spark.createDataFrame([("A", 0.5), ("C", 0.5)], "asset string, weight double")
    got = {(r["day"], r["asset"]): (r["current"], r["adjustment"]) for r in st.calendar_rebalance(df, targets, "day", "asset", "value").collect()}
    assert got == {(d(2024, 1, 3), "A"): (0.6, pytest.approx(-10.0)), (d(2024, 1, 3), "C"): (0.0, 50.0), (d(2024, 2, 1), "A"): (1.0, -5.0), (d(2024, 2, 1), "C"): (0.0, 5.0)}


def test_reports_by_size_and_hold(spark):
    df = spark.createDataFrame([(float(i), 1.0 if i % 2 else -2.0, h) for i, h in zip(range(10), [0.0, 4.0, 5.0, 12.0, 13.0, 24.0, 30.0, 100.0, 200.0, None], strict=True)], "size double, pnl double, hours double")
    sizes = {r["bucket"]: (r["n"], r["profit_factor"]) for r in st.profit_by_size(df, "size", "pnl").collect()}
    assert sizes == dict.fromkeys(range(1, 6), (2, 0.5))
    holds = {r["bucket"]: (r["n"], r["win_rate"], r["profit_factor"]) for r in st.profit_by_hold(df, "hours", "pnl").collect()}
    assert holds == {"<4h": (1, 1.0, None), "4-12h": (2, 0.5, 0.5), "12-24h": (2, 0.5, 0.5), "1-2d": (1, 0.0, 0.0), "2-7d": (1, 1.0, None), ">7d": (1, 0.0, 0.0)}


def test_phases_and_growth(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([100.0, 97.0, 94.0, 90.0, 101.0])], "asset string, ts long, price double")
    rows = sorted(st.equity_phases(df, S).collect(), key=lambda r: r["ts"])
    assert [(r["phase"], r["lasted"]) for r in rows] == [("growth", 1), ("growth", 2), ("drawdown", 1), ("drawdown", 2), ("growth", 1)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([None, 0.1, 0.1, -1.0])], "asset string, ts long, ret double")
    rows = sorted(st.rolling_growth(df, S, n=2, periods=4).collect(), key=lambda r: r["ts"])
    assert [r["growth"] for r in rows] == [None, None, pytest.approx(1.1**4 - 1), 0.0]


def test_spikes_and_thresholds(spark):
    df = spark.createDataFrame([("a", i, v, 0.4) for i, v in enumerate([10.0, 10.0, 50.0, None, 10.0])], "asset string, ts long, volume double, signal double")
    rows = sorted(st.volume_spikes(df, S, lookback=2).collect(), key=lambda r: r["ts"])
    assert [r["spike"] for r in rows] == [False, False, True, False, False] and rows[0]["volume_ratio"] == 0.0
    rows = sorted(st.adaptive_threshold(df.na.fill(10.0, ["volume"]), S, "signal", "volume", n=3).collect(), key=lambda r: r["ts"])
    assert rows[0]["threshold"] == 0.3 and rows[0]["above"]
    assert rows[2]["threshold"] == pytest.approx(0.3 + (50 - 70 / 3) / np.std([10, 10, 50], ddof=1) * 0.15) and not rows[2]["above"]


def test_clusters_of_days(spark):
    days = ["2024-01-01", "2024-01-01", "2024-01-04", "2024-01-09", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_timestamp("d").alias("at"))
    got = [tuple(r) for r in st.event_clusters(df, "at", 3).collect()]
    assert got == [(datetime.date(2024, 1, 1), datetime.date(2024, 1, 4), 3)]
    assert st.event_clusters(df.limit(0), "at").collect() == []
