from __future__ import annotations

import math

import numpy as np
import pytest

from quantspark.frames import Series
from quantspark.operators import lagged

S = Series(("asset",), ("ts",))


def adf(x, k):
    """The regression written out row by row."""
    d = np.diff(x)
    rows = range(k, len(d))
    design = np.array([[1.0, x[t], *[d[t - i] for i in range(1, k + 1)]] for t in rows])
    y = d[k:]
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    rest = ((y - design @ beta) ** 2).sum() / (len(y) - len(beta))
    inverse = np.linalg.inv(np.linalg.qr(design)[1])
    return beta[1] / math.sqrt(rest * (inverse[1] ** 2).sum())


def walks(rng, assets, moments):
    return {f"a{j}": 100 + np.cumsum(rng.normal(size=moments)) for j in range(assets)}


def long(spark, series, name="price"):
    return spark.createDataFrame([(a, t, float(v)) for a, xs in series.items() for t, v in enumerate(xs)], f"asset string, ts long, {name} double")


@pytest.mark.parametrize("lags", [0, 1, 2, 6, None])
def test_unit_root_statistic_equals_least_squares(spark, lags):
    rng = np.random.default_rng(4)
    series = walks(rng, 3, 140) | {"back": np.array(rng.normal(size=60)), "long": np.cumsum(rng.normal(size=400)) * 0.01 + 5000}
    got = {r.asset: r for r in lagged.augmented_dickey_fuller(long(spark, series), S, lags=lags).collect()}
    for a, x in series.items():
        k = lagged.default_lags(len(x)) if lags is None else lags
        want = adf(x, k)
        assert got[a].lags == k and got[a].n == len(x) and abs(got[a].adf_stat - want) < 1e-8 * max(abs(want), 1)
    if lags == 1:
        assert got["back"].p_value == 0.005 and got["a0"].p_value > 0.05


def test_unit_root_of_awkward_series(spark):
    rows = long(spark, {"flat": [3.0] * 30, "short": [1.0, 2.0], "line": list(range(30))}).unionByName(spark.createDataFrame([("null", 1, None)], "asset string, ts long, price double"))
    got = {r.asset: (r.adf_stat, r.p_value) for r in lagged.augmented_dickey_fuller(rows, S, lags=1).collect()}
    assert got == {"flat": (None, None), "short": (None, None), "line": (None, None)}
    assert lagged.augmented_dickey_fuller(rows.limit(0), S).count() == 0


def half_life(spread):
    d, before = np.diff(spread), spread[:-1]
    phi = 1 + before @ d / (before @ before)
    return max(1.0, -math.log(2) / math.log(phi)) if 0 < phi < 1 else None


@pytest.mark.parametrize("lags", [0, 2, None])
def test_pairs_from_merged_sums_equal_regressions_of_their_spreads(spark, lags):
    rng = np.random.default_rng(6)
    series = walks(rng, 7, 130)
    series["b0"] = 3 + 0.7 * series["a0"] + rng.normal(size=130) * 0.4
    series["b3"] = -2 * series["a3"] + rng.normal(size=130) * 0.6
    got = {(r.asset_y, r.asset_x): r for r in lagged.cointegration(long(spark, series), lags, side=40, depth=32).collect()}
    assert len(got) == 9 * 8 // 2 and all(a < b for a, b in got)
    for (a, b), r in got.items():
        y, x = series[a], series[b]
        h = np.polyfit(x, y, 1)[0]
        spread = y - h * x
        want = adf(spread, lagged.default_lags(130) if lags is None else lags)
        assert abs(r.hedge_ratio - h) < 1e-9 * max(abs(h), 1) and abs(r.adf_stat - want) < 1e-7 * max(abs(want), 1)
        assert abs(r.spread_mean - spread.mean()) < 1e-8 and abs(r.spread_std - spread.std(ddof=1)) < 1e-8
        assert abs(r.correlation - np.corrcoef(x, y)[0, 1]) < 1e-10
        life = half_life(spread)
        assert (r.half_life is None) == (life is None) and (life is None or abs(r.half_life - life) < 1e-5 * life)


def test_planted_pairs_are_found_and_uncorrelated_ones_are_not_regressed(spark):
    rng = np.random.default_rng(7)
    series = walks(rng, 6, 300)
    noise = np.zeros(300)
    for t in range(1, 300):
        noise[t] = 0.8 * noise[t - 1] + rng.normal() * 0.3
    # The spread of these levels is around zero, as the half-life without an intercept asks for.
    series["z"] = 1.5 * series["a2"] + noise
    found = [(r.asset_y, r.asset_x) for r in lagged.cointegrated_pairs(long(spark, series), lags=1, max_half_life=1e9).collect()]
    assert ("a2", "z") in found and len(found) <= 4
    near = lagged.cointegration(long(spark, series), 1, min_correlation=0.9).collect()
    assert ("a2", "z") in {(r.asset_y, r.asset_x) for r in near} and all(abs(r.correlation) >= 0.9 for r in near)


def granger(x, y, lag):
    n = len(y) - lag
    back = lambda v: [v[lag - i : len(v) - i] for i in range(1, lag + 1)]
    left = lambda columns: ((y[lag:] - (d := np.column_stack([np.ones(n), *columns])) @ np.linalg.lstsq(d, y[lag:], rcond=None)[0]) ** 2).sum()
    short, long_ = left(back(y)), left(back(y) + back(x))
    return (short - long_) / lag / (long_ / (n - 2 * lag - 1))


def f_tail(f, a, b, steps=200_000):
    """Upper tail of an F distribution by the midpoint rule over its beta form."""
    x = b / (b + a * f)
    u = (np.arange(steps) + 0.5) / steps * x
    return (u ** (b / 2 - 1) * (1 - u) ** (a / 2 - 1)).sum() * x / steps * math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2))


def test_causes_of_all_directed_pairs_and_lags(spark):
    rng = np.random.default_rng(8)
    x = {f"a{j}": rng.normal(size=90) for j in range(4)}
    x["a3"][2:] += 0.9 * x["a0"][:-2]
    got = {(r.cause, r.effect, r.lag): r for r in lagged.granger_pairs(long(spark, x, "ret"), 5, side=18, depth=16).collect()}
    assert len(got) == 4 * 3 * 5
    for (cause, effect, lag), r in got.items():
        want = granger(x[cause], x[effect], lag)
        assert abs(r.f_stat - want) < 1e-8 * max(want, 1) and r.n == 90 - lag
        if want > 0.2:
            assert abs(r.p_value - f_tail(want, lag, 90 - 3 * lag - 1)) < 1e-4
    links = {(r.one, r.other): r for r in lagged.granger_links(lagged.granger_pairs(long(spark, x, "ret"), 5)).collect()}
    assert links["a0", "a3"].direction in ("forward", "both") and links["a0", "a3"].p_forward < 1e-8 and links["a0", "a3"].best_lag == 2


def test_causes_of_awkward_panels(spark):
    flat = lagged.granger_pairs(long(spark, {"a": [1.0] * 20, "b": list(np.random.default_rng(1).normal(size=20))}, "ret"), 2).collect()
    assert {(r.f_stat, r.p_value) for r in flat} == {(0.0, 1.0)} and len(flat) == 4
    same = np.random.default_rng(2).normal(size=30)
    twins = lagged.granger_pairs(long(spark, {"a": same, "b": same}, "ret"), 2).collect()
    assert all(r.f_stat < 1e-6 for r in twins)
    short = lagged.granger_pairs(long(spark, {"a": [1.0, 2.0, 4.0], "b": [0.0, 1.0, 0.5]}, "ret"), 2).collect()
    assert {(r.f_stat, r.p_value) for r in short} == {(0.0, 1.0)}
