"""Hand-computed values, degenerate inputs, order independence and isolation of series."""

from __future__ import annotations

import math

import pytest

from quantspark.frames import TICKS, Series
from quantspark.functions import kernels
from quantspark.operators import indicators as ind
from quantspark.operators import joins, quality, risk, text, windows
from quantspark.operators import market as mk

BARS = "asset string, ts int, tie int, open double, high double, low double, close double, volume long"


def series(spark, values, asset="a", name="price"):
    return spark.createDataFrame([(asset, i, 0, None if v is None else float(v)) for i, v in enumerate(values)], f"asset string, ts int, tie int, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("asset", "ts").collect()]


def test_trailing_stop_ratchets(spark):
    rows = spark.createDataFrame([("a", i, 0, float(c), 2.0) for i, c in enumerate([100, 105, 103, 110, 106])], "asset string, ts int, tie int, close double, atr double")
    assert column(ind.trailing_stop_atr(rows), "stop") == [96, 101, 101, 106, 106]
    rows = spark.createDataFrame([("a", i, 0, float(c), 2.0) for i, c in enumerate([100, 95, 97, 90, 94])], "asset string, ts int, tie int, close double, atr double")
    assert column(ind.trailing_stop_atr(rows, long=False), "stop") == [104, 99, 99, 94, 94]


def test_flat_bars_are_neutral(spark):
    flat = spark.createDataFrame([("a", i, 0, 100.0, 100.0, 100.0, 100.0, 1000) for i in range(20)], BARS)
    assert column(ind.stochastic(flat), "k")[-1] == 50
    assert column(ind.williams_r(flat), "williams_r")[-1] == -50
    assert column(ind.cci(flat), "cci")[-1] == 0
    assert column(kernels.adx(flat, n=3), "adx")[-1] == 0
    prices = flat.selectExpr("asset", "ts", "tie", "close AS price")
    assert column(ind.rsi_simple(prices, n=5), "rsi")[-1] == 50
    assert column(kernels.rsi_wilder(prices, n=5), "rsi")[-1] == 50
    bands = ind.bollinger(prices, n=5).orderBy("ts").collect()[-1]
    assert bands.bandwidth == 0 and bands.percent_b == 0.5


def test_warm_up_rows_are_null(spark):
    out = column(windows.rolling_stats(series(spark, range(10)), n=4), "roll_mean")
    assert out[:3] == [None] * 3 and out[3] == 1.5


def test_trade_metrics(spark):
    rows = spark.createDataFrame([("s", i, float(p)) for i, p in enumerate([100, -50, 150, -30, 200])], "symbol string, ts int, pnl double")
    r = risk.trade_report(rows, ["symbol"]).first()
    assert r.win_rate == pytest.approx(0.6) and r.profit_factor == pytest.approx(450 / 80) and r.expectancy == pytest.approx(74)
    runs = risk.streaks(rows, Series(key=("symbol",), order=("ts",))).first()
    assert runs.longest_win == 1 and runs.longest_loss == 1


def test_drawdown_by_hand(spark):
    out = risk.drawdown_episodes(series(spark, [100, 110, 99, 104.5, 111, 105]))
    rows = sorted((r.length, round(r.depth, 6), r.recovered) for r in out.collect())
    assert rows == [(1, round(105 / 111 - 1, 6), False), (2, -0.1, True)]


def test_zero_price_gives_no_return(spark):
    assert column(risk.with_returns(series(spark, [100, 0, 105, 110])), "ret") == [None, -1.0, None, pytest.approx(110 / 105 - 1)]


def test_weight_drift_keeps_one_sided_keys(spark):
    a = spark.createDataFrame([("AAPL", 0.6), ("NVDA", 0.4)], "symbol string, weight double")
    b = spark.createDataFrame([("AAPL", 0.5), ("MSFT", 0.5)], "symbol string, weight double")
    got = {r.symbol: (round(r.drift, 6), r.relative_drift) for r in joins.weight_drift(a, b, "symbol").collect()}
    assert got["MSFT"] == (-0.5, 1.0) and got["NVDA"] == (0.4, None) and got["AAPL"][0] == 0.1


def test_weighted_sentiment(spark):
    posts = spark.createDataFrame([("d", "x", 1, 1.0), ("d", "x", 2, -1.0), ("d", "x", None, 0.0)], "date string, asset_id string, author_id long, polarity double")
    weights = spark.createDataFrame([(1, 2.0)], "author_id long, weight double")
    assert text.weighted_sentiment(posts.where("author_id is not null"), weights, ["date", "asset_id"]).first().sentiment_index == pytest.approx(1 / 3)
    assert text.weighted_sentiment(posts, weights, ["date", "asset_id"]).first().post_count == 3


def test_beta_is_recovered(spark):
    rows = spark.createDataFrame([("a", i, 0, 2.0 * m + 0.001, m) for i, m in enumerate([0.01, -0.02, 0.03, 0.005, -0.01])], "asset string, ts int, tie int, ret double, market double")
    r = joins.benchmark_report(rows, ["asset"], "ret", "market").first()
    assert r.beta == pytest.approx(2) and r.alpha == pytest.approx(0.001)


def test_as_of_takes_ties_and_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "asset string, ts int")
    right = spark.createDataFrame([("a", 2, 1, 10.0), ("a", 5, 1, 20.0), ("a", 5, 2, 30.0)], "asset string, ts int, tie int, v double")
    got = {(r.asset, r.ts): r.asof_v for r in joins.as_of(left, right, ["asset"], "ts", ["v"], ["tie"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 30.0, ("b", 5): None}


def test_interpolation_and_fills(spark):
    rows = series(spark, [None, 1, None, None, 4, None])
    assert column(windows.interpolate(rows, TICKS, "price"), "price") == [None, 1, 2, 3, 4, None]
    assert column(windows.interpolate(rows, TICKS, "price", 1), "price") == [None, 1, None, None, 4, None]
    assert column(windows.fill_both_ways(rows, TICKS, "price"), "price") == [1, 1, 1, 1, 4, 4]


def test_scaling(spark):
    rows = series(spark, [1, 2, 3, 4, 5])
    assert column(quality.scaled(rows, "price", "minmax"), "price_minmax") == [0, 0.25, 0.5, 0.75, 1]
    assert column(quality.scaled(rows, "price", "robust"), "price_robust") == [-1, -0.5, 0, 0.5, 1]
    assert column(quality.scaled(series(spark, [7, 7]), "price", "standard"), "price_standard") == [0, 0]


def test_gaps_skip_weekends(spark):
    rows = spark.sql("SELECT 'a' AS asset, explode(array(date'2024-01-05', date'2024-01-08', date'2024-01-10')) AS ts, 0 AS tie")
    got = quality.day_gaps(rows, TICKS).collect()
    assert [(str(r.gap_start), str(r.gap_end), r.missing) for r in got] == [("2024-01-09", "2024-01-09", 1)]


def test_triple_barrier(spark):
    rows = series(spark, [100, 105, 111, 80, 90, 100]).withColumn("volatility", text.F.lit(0.1))
    out = mk.triple_barrier(rows, TICKS, "price", 1.0, 1.0, 3)
    assert column(out, "label") == [1, -1, -1, 1, 1] and column(out, "touch") == [2, 2, 1, 1, 1]


def test_order_of_rows_does_not_matter_and_assets_are_apart(spark):
    a, b = series(spark, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8], "a"), series(spark, [2, 7, 1, 8, 2, 8, 1, 8, 2, 8, 4, 5], "b")
    for f, name in ((lambda d: ind.momentum(d, n=2), "momentum"), (lambda d: kernels.macd(d), "macd_hist"), (lambda d: ind.bollinger(d, n=3), "percent_b"), (lambda d: windows.expanding_stats(d), "exp_std")):
        alone = column(f(a), name) + column(f(b), name)
        both = column(f(a.union(b).orderBy("price").repartition(3)), name)
        assert all((x is None and y is None) or math.isclose(x, y, rel_tol=1e-12) for x, y in zip(alone, both, strict=True))


def test_text_helpers(spark):
    rows = spark.createDataFrame([(1, "Buy $TSLA and $aapl  now https://x.y/z "), (2, None)], "id long, text string")
    got = rows.select(text.cashtags(text.F.col("text")).alias("tags"), text.normalized(text.F.col("text")).alias("clean")).collect()
    assert sorted(got[0].tags) == ["AAPL", "TSLA"] and got[0].clean == "Buy $TSLA and $AAPL now [URL]" and got[1].clean is None


def test_empty_frames_keep_their_schema(spark):
    empty = series(spark, [])
    assert ind.crossover_backtest(empty).count() == 0
    assert kernels.ema(empty).columns == ["asset", "ts", "tie", "price", "ema"]
    assert risk.drawdown_report(empty).count() == 0
