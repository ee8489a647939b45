from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.operators import optimise


def long(spark, groups):
    rows = [(g, f"a{j}", t, float(x[t, j])) for g, x in groups.items() for t in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "g string, asset string, ts long, ret double")


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(2)
    return {f"g{n}{k}": rng.normal(0.01, 0.05, (60, n)) @ (np.eye(n) + 0.3 * rng.normal(size=(n, n))) for n in (2, 3, 7) for k in range(3)}


def test_moments_of_groups(spark, groups):
    got = {r.g: r for r in optimise.group_moments(long(spark, groups), ["g"]).collect()}
    for g, x in groups.items():
        n = x.shape[1]
        assert got[g].assets == [f"a{j}" for j in range(n)] and got[g].n == 60
        assert np.allclose(got[g].means, x.mean(axis=0), atol=1e-14) and np.allclose(np.array(got[g].cov).reshape(n, n), np.cov(x, rowvar=False), atol=1e-14)


def conditions(w, mu, cov, aversion, high=1.0):
    """The largest violation of: equal slopes where weights are free, lower ones at zero, higher ones at the top."""
    slope = mu - aversion * cov @ w
    free = (w > 1e-9) & (w < high - 1e-9)
    level = slope[free].mean() if free.any() else None
    if level is None:
        return max(0.0, float(slope[w <= 1e-9].max(initial=-np.inf) - slope[w >= high - 1e-9].min()))
    return float(max(np.abs(slope[free] - level).max(), (slope[w <= 1e-9] - level).max(initial=0), (level - slope[w >= high - 1e-9]).max(initial=0)))


def test_every_point_of_the_frontier_meets_the_conditions(spark, groups):
    rows = optimise.efficient_frontier(optimise.group_moments(long(spark, groups), ["g"]), [0.5, 2, 10, 100, 1e4], high=0.8).collect()
    assert len(rows) == 9 * 5 and max(r.residual for r in rows) < 1e-6
    for r in rows:
        x, w = groups[r.g], np.array(r.weights)
        mu, cov = x.mean(axis=0), np.cov(x, rowvar=False)
        assert abs(w.sum() - 1) < 1e-9 and w.min() > -1e-12 and w.max() < 0.8 + 1e-12
        assert conditions(w, mu, cov, r.aversion, 0.8) < 1e-6 * max(1, r.aversion * 0.01)
        assert abs(r.expected_return - w @ mu) < 1e-12 and abs(r.volatility - np.sqrt(w @ cov @ w)) < 1e-12
    for g in groups:
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.aversion)
        assert all(a.volatility >= b.volatility - 1e-9 and a.expected_return >= b.expected_return - 1e-9 for a, b in zip(mine, mine[1:], strict=False))


def test_cases_by_hand(spark):
    one = spark.createDataFrame([("one", ["a"], [0.1], [0.04], 3.0), ("same", ["a", "b"], [0.1, 0.1], [0.04, 0.0, 0.0, 0.04], 3.0), ("mix", ["a", "b"], [0.0, 0.0], [0.01, 0.0, 0.0, 0.03], 3.0), ("best", ["a", "b"], [0.5, 0.1], [0.01, 0.0, 0.0, 0.01], 1.0), ("zero", ["a", "b"], [0.0, 0.0], [0.0] * 4, 1.0)], "g string, assets array<string>, means array<double>, cov array<double>, aversion double")
    got = {r.g: r for r in optimise.mean_variance(one, "aversion").collect()}
    assert got["one"].weights == [1.0] and np.allclose(got["same"].weights, [0.5, 0.5]) and np.allclose(got["mix"].weights, [0.75, 0.25]) and np.allclose(got["best"].weights, [1.0, 0.0])
    assert np.allclose(got["zero"].weights, [0.5, 0.5]) and got["zero"].sharpe == 0.0 and abs(got["same"].effective_n - 2) < 1e-9
    least = {r.g: r for r in optimise.mean_variance(one).collect()}
    assert np.allclose(least["mix"].weights, [0.75, 0.25]) and max(r.residual for r in least.values()) < 1e-9


def test_a_benchmark_made_of_the_assets_is_tracked_without_error(spark, groups):
    df = long(spark, {"g": groups["g30"]})
    weights = {"a0": 0.2, "a1": 0.5, "a2": 0.3}
    share = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[F.col("asset")]
    bench = df.groupBy("g", "ts").agg(F.sum(F.col("ret") * share).alias("bench"))
    got = optimise.tracking_portfolios(df.join(bench, ["g", "ts"]), F.col("bench"), ["g"]).first()
    assert np.allclose(got.weights, [0.2, 0.5, 0.3], atol=1e-6) and got.volatility < 1e-6 and got.residual < 1e-6


def test_views_move_the_posterior(spark, groups):
    x = groups["g31"]
    cov, caps = np.cov(x, rowvar=False), np.array([3.0, 2.0, 1.0])
    views = [([1.0, 0.0, 0.0], 0.4, 0.8), ([0.0, 1.0, -1.0], 0.02, 0.5)]
    base = optimise.group_moments(long(spark, {"g": x}), ["g"]).withColumn("caps", F.array(*[F.lit(c) for c in caps]))
    kind = "array<struct<weights:array<double>,ret:double,confidence:double>>"
    view = F.from_json(F.lit(str([{"weights": w, "ret": r, "confidence": c} for w, r, c in views]).replace("'", '"')), kind)
    got = optimise.black_litterman(base.withColumn("views", view), "caps", "views").first()
    p, q, omega = np.array([v[0] for v in views]), np.array([v[1] for v in views]), np.diag([(1 - v[2]) * 0.1 + 1e-10 for v in views])
    pi = 2.5 * cov @ (caps / 6)
    back = np.linalg.inv(0.05 * cov)
    post = np.linalg.solve(back + p.T @ np.linalg.inv(omega) @ p, back @ pi + p.T @ np.linalg.inv(omega) @ q)
    want = np.clip(np.linalg.solve(2.5 * cov, post), 0, 1)
    assert np.allclose(got.weights, want / want.sum(), atol=1e-8) and abs(got.expected_return - post @ (want / want.sum())) < 1e-8
    none = optimise.black_litterman(base.withColumn("views", F.lit(None).cast(kind)), "caps", "views").first()
    assert np.allclose(none.weights, caps / 6, atol=1e-8)


def test_panels_of_more_assets_than_moments_equal_their_matrices(spark):
    rng = np.random.default_rng(5)
    wide = {"w": rng.normal(0.01, 0.05, (6, 40)), "tall": rng.normal(0.01, 0.05, (60, 4))}
    df = long(spark, wide)
    panels = optimise.group_panels(df, ["g"])
    assert {r.g: len(r.deviations) for r in panels.collect()} == {"w": 240, "tall": 240}
    dense = optimise.group_moments(df, ["g"])
    mine = {(r.g, r.point): r for r in optimise.efficient_frontier(panels, [1.0, 20.0, 500.0]).collect()}
    for r in optimise.efficient_frontier(dense, [1.0, 20.0, 500.0]).collect():
        m = mine[r.g, r.point]
        assert m.assets == r.assets and m.residual < 1e-6 and r.residual < 1e-6
        value = lambda q: q.expected_return - r.aversion * q.volatility**2 / 2  # noqa: B023, E731
        assert abs(value(m) - value(r)) < 1e-7
    caps = lambda p: p.withColumn("caps", F.transform("assets", lambda a: F.length(a).cast("double"))).withColumn("views", F.array(F.struct(F.transform("assets", lambda a, i: F.when(i == 0, 1.0).otherwise(0.0)).alias("weights"), F.lit(0.01).alias("ret"), F.lit(0.6).alias("confidence"))))
    a, b = ({r.g: r for r in optimise.black_litterman(caps(p), "caps", "views").collect()} for p in (panels, dense))
    for g in wide:
        assert np.allclose(a[g].weights, b[g].weights, atol=1e-7) and abs(a[g].expected_return - b[g].expected_return) < 1e-9


def test_a_group_of_many_assets_needs_no_square_of_them(spark):
    rng = np.random.default_rng(6)
    row = optimise.efficient_frontier(optimise.group_panels(long(spark, {"g": rng.normal(0.01, 0.05, (5, 3000))}), ["g"]), [50.0]).first()
    assert len(row.weights) == 3000 and abs(sum(row.weights) - 1) < 1e-9 and row.residual < 1e-6
