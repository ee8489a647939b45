"""Constrained portfolios as batches of small problems: one row is one group, date or aversion to risk.

Spark gathers each group's moments by sums of products; a problem is a row with its assets, means and covariances. Rows
are solved in Arrow batches, all problems of one size at once, so a million groups are as many rows, not a loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.operators.lagged import gram


def group_moments(df: DataFrame, by: Sequence[str] = (), asset: str = "asset", at: str = "ts", x: str = "ret") -> DataFrame:
    """(by, assets, n, means, cov): means and covariances (by rows, over n - 1) of each group's assets, over the moments
    at which all of them have a value. Groups with fewer than two such moments are left out.

    A group's matrix is one row: right for groups of some hundreds of assets; blocks.covariance has no such bound.
    """
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).withColumn("__all", F.lit(1))
    keys = list(by) or ["__all"]
    rows = rows.groupBy(*keys, F.col(asset).alias("__a"), F.col(at).alias("__t")).agg(F.avg(x).alias("__x"))
    centres = rows.groupBy(*keys, "__a").agg(F.avg("__x").alias("__c"))
    rows = rows.join(centres, [*keys, "__a"])
    packed = F.sort_array(F.collect_list(F.struct("__a", "__x", "__c")))
    whole = rows.groupBy(*keys, "__t").agg(packed.alias("p"))
    sizes = centres.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__a", "__c"))).alias("all"))
    whole = whole.join(sizes, keys).where(F.size("p") == F.size("all"))
    z = F.concat(F.array(F.lit(1.0)), F.transform("p", lambda v: v["__x"] - v["__c"]))
    sums = gram(whole.select(*keys, z.alias("z")), keys, "z").join(sizes, keys)
    n, width = F.col("gram")[0], F.size("all") + 1
    total = lambda i: F.col("gram")[i]
    means = F.transform("all", lambda v, i: v["__c"] + total(i + 1) / n)
    cells = F.transform(F.sequence(F.lit(0), F.size("all") * F.size("all") - 1), lambda k: (total((F.floor(k / F.size("all")).cast("int") + 1) * width + k % F.size("all") + 1) - total(F.floor(k / F.size("all")).cast("int") + 1) * total(k % F.size("all") + 1) / n) / (n - 1))
    return sums.where(n >= 2).select(*by, F.transform("all", lambda v: v["__a"]).alias("assets"), n.cast("long").alias("n"), means.alias("means"), cells.alias("cov"))


def group_panels(df: DataFrame, by: Sequence[str] = (), asset: str = "asset", at: str = "ts", x: str = "ret") -> DataFrame:
    """(by, assets, n, means, deviations): the same moments as factors: the values less their means, moment by moment in
    one array. A group costs its values and not its assets squared. Groups with fewer than two moments are left out."""
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).withColumn("__all", F.lit(1))
    keys = list(by) or ["__all"]
    rows = rows.groupBy(*keys, F.col(asset).alias("__a"), F.col(at).alias("__t")).agg(F.avg(x).alias("__x"))
    sizes = rows.select(*keys, "__a").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    whole = rows.groupBy(*keys, "__t").agg(F.count(F.lit(1)).alias("__here")).join(sizes, keys).where("__here = __size").select(*keys, "__t")
    rows = rows.join(whole, [*keys, "__t"])
    means = rows.groupBy(*keys, "__a").agg(F.avg("__x").alias("__c"), F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    packed = F.sort_array(F.collect_list(F.struct("__a", (F.col("__x") - F.col("__c")).alias("z"))))
    lines = rows.join(means, [*keys, "__a"]).groupBy(*keys, "__t").agg(F.transform(packed, lambda v: v["z"]).alias("z"))
    factors = lines.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__t", "z"))), lambda v: v["z"])).alias("deviations"))
    told = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__a", "__c"))).alias("all"), F.max("__n").alias("n"))
    out = told.join(factors, keys).select(*by, F.transform("all", lambda v: v["__a"]).alias("assets"), "n", F.transform("all", lambda v: v["__c"]).alias("means"), "deviations")
    return _spread(out, *by)


def _spread(problems: DataFrame, *by: str) -> DataFrame:
    """problems dealt to all tasks: few rows may hold much work, so small partitions are not joined."""
    parts = int(problems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return problems.repartition(parts, *by) if by else problems


class Dense:
    """Covariances of problems of one size, as matrices."""

    def __init__(self, q: np.ndarray):
        self.q, self.diagonal = q, np.einsum("pii->pi", q)
        self.size = np.linalg.norm(q, axis=(1, 2))

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.einsum("pij,pj->pi", self.q, v)

    def stationary(self, p: int, free: np.ndarray, slope: np.ndarray, left: float) -> np.ndarray:
        """The free weights of sum left at which the matrix among them times weights differs from slope by a constant."""
        return _saddle(self.q[p][np.ix_(free, free)], np.ones(int(free.sum())), slope, left)

    def solved(self, p: int, right: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(self.q[p], right, rcond=None)[0]

    def one(self, p: int) -> Dense:
        return Dense(self.q[p : p + 1])


class Factors:
    """Covariances of problems with fewer moments than assets, as the moments' deviations over the root of n - 1."""

    def __init__(self, x: np.ndarray):
        self.x, self.diagonal = x, (x * x).sum(axis=1)
        self.size = np.linalg.norm(x @ x.transpose(0, 2, 1), axis=(1, 2))

    def times(self, v: np.ndarray) -> np.ndarray:
        return ((self.x @ v[:, :, None]).transpose(0, 2, 1) @ self.x)[:, 0]

    def stationary(self, p: int, free: np.ndarray, slope: np.ndarray, left: float) -> np.ndarray:
        # All that the conditions name lies in the span of the moments, the slope and equal weights.
        x, ones = self.x[p][:, free], np.ones(int(free.sum()))
        if len(ones) <= len(x) + 2:
            return _saddle(x.T @ x, ones, slope, left)
        basis = np.linalg.qr(np.column_stack([x.T, ones, slope]))[0]
        y = x @ basis
        return basis @ _saddle(y.T @ y, basis.T @ ones, basis.T @ slope, left)

    def solved(self, p: int, right: np.ndarray) -> np.ndarray:
        _, values, rows = np.linalg.svd(self.x[p], full_matrices=False)
        squares = values * values
        kept = squares > np.finfo(float).eps * self.x.shape[2] * squares.max(initial=0.0)
        return rows[kept].T @ ((rows[kept] @ right) / squares[kept])

    def one(self, p: int) -> Factors:
        return Factors(self.x[p : p + 1])


def _saddle(q: np.ndarray, ones: np.ndarray, slope: np.ndarray, left: float) -> np.ndarray:
    n = len(q)
    side = np.zeros((n + 1, n + 1))
    side[:n, :n], side[:n, n], side[n, :n] = q, ones, ones
    return np.linalg.lstsq(side, np.append(slope, left), rcond=None)[0][:n]


def project(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of v moved to the nearest points with low <= w <= high that sum to one, by halving the common shift."""
    a, b = (v - high).min(axis=1) - 1, (v - low).max(axis=1) + 1
    for _ in range(100):
        mid = (a + b) / 2
        much = np.clip(v - mid[:, None], low, high).sum(axis=1) > 1
        a, b = np.where(much, mid, a), np.where(much, b, mid)
    return np.clip(v - ((a + b) / 2)[:, None], low, high)


def residual(w: np.ndarray, q: Dense | Factors, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far one gradient step and a projection move each row: zero exactly where the conditions of an optimum hold."""
    slope = q.times(w) - c
    return np.abs(w - project(w - slope, low, high)).max(axis=1)


def solve(q: Dense | Factors, c: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 4000, tolerance: float = 1e-9) -> np.ndarray:
    """Rows w that make w'qw / 2 - c'w least, with low <= w <= high and a sum of one.

    Accelerated projected gradients for all problems at once, restarted where they overshoot; then each problem's free
    weights are solved exactly and kept where that leaves a smaller residual.
    """
    size = np.maximum(q.size, 1e-300)[:, None]
    w = project(np.full(c.shape, 1.0 / c.shape[1]), low, high)
    ahead, speed = w.copy(), np.ones((len(w), 1))
    for k in range(rounds):
        slope = q.times(ahead) - c
        new = project(ahead - slope / size, low, high)
        over = ((ahead - new) * (new - w)).sum(axis=1, keepdims=True) > 0
        speed = np.where(over, 1.0, speed)
        later = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = np.where(over, new, new + (speed - 1) / later * (new - w))
        w, speed = new, later
        if k % 50 == 49 and residual(w, q, c, low, high).max() < tolerance:
            break
    left = residual(w, q, c, low, high)
    for p in np.flatnonzero(left > 1e-12):
        free = (w[p] > low[p] + 1e-7) & (w[p] < high[p] - 1e-7)
        if not free.any():
            continue
        fixed = np.where(free, 0.0, np.where(w[p] <= low[p] + 1e-7, low[p], high[p]))
        one = q.one(p)
        exact = fixed.copy()
        exact[free] = q.stationary(p, free, (c[p] - one.times(fixed[None])[0])[free], 1.0 - fixed.sum())
        exact = np.clip(exact, low[p], high[p])[None]
        if abs(exact.sum() - 1) < 1e-12 and residual(exact, one, c[p : p + 1], low[p : p + 1], high[p : p + 1])[0] < left[p]:
            w[p] = exact[0]
    return w


RESULT = "weights array<double>, expected_return double, volatility double, sharpe double, diversification double, effective_n double, residual double"


def _report(w: np.ndarray, mu: np.ndarray, cov: Dense | Factors, left: np.ndarray) -> pd.DataFrame:
    ret, var = (w * mu).sum(axis=1), (w * cov.times(w)).sum(axis=1)
    vol = np.sqrt(np.maximum(var, 0))
    spread = (w * np.sqrt(np.maximum(cov.diagonal, 0))).sum(axis=1)
    safe = lambda top, other: np.where(vol > 0, top / np.where(vol > 0, vol, 1), other)
    return pd.DataFrame({"weights": list(w), "expected_return": ret, "volatility": vol, "sharpe": safe(ret, 0.0), "diversification": safe(spread, 1.0), "effective_n": 1 / (w * w).sum(axis=1), "residual": left})


#: Values of the problems that are solved at once, about.
AT_ONCE = 4_000_000


def _batched(problems: DataFrame, run: Callable[[pd.DataFrame, np.ndarray, Dense | Factors], pd.DataFrame]) -> DataFrame:
    """problems with the result of run, which gets rows of one number of assets with their means and covariances: from
    cov, or from deviations (of group_panels)."""
    keep = [c for c in problems.columns if c not in ("means", "cov", "deviations")]
    fields = [f"`{c}` {t}" for c, t in problems.dtypes if c in keep]

    def forms(part: pd.DataFrame, n: int) -> Dense | Factors:
        if "cov" in part:
            return Dense(np.stack(part["cov"]).astype(float).reshape(-1, n, n))
        x = np.stack(part["deviations"]).astype(float).reshape(len(part), -1, n)
        x = x / np.sqrt(x.shape[1] - 1)
        return Factors(x) if x.shape[1] < n else Dense(x.transpose(0, 2, 1) @ x)

    source = "cov" if "cov" in problems.columns else "deviations"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (n, values), same in frame.groupby([frame["assets"].map(len), frame[source].map(len)]):
                step = max(1, AT_ONCE // max(values, 1))
                for i in range(0, len(same), step):
                    part = same.iloc[i : i + step]
                    yield pd.concat([part[keep].reset_index(drop=True), run(part, np.stack(part["means"]).astype(float), forms(part, n))], axis=1)

    return problems.mapInPandas(batches, ", ".join([*fields, RESULT]))


def mean_variance(problems: DataFrame, aversion: str | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Each row's weights that make expected return less half of its aversion times the variance largest; without a column
    of aversions the variance alone is made least. Bounds hold for every weight; where they leave no sum of one, they are
    widened to equal weights. residual tells how far the conditions of an optimum are from holding."""

    def run(part: pd.DataFrame, mu: np.ndarray, cov: Dense | Factors) -> pd.DataFrame:
        n = mu.shape[1]
        floor, top = np.full(mu.shape, min(low, 1 / n)), np.full(mu.shape, max(high, 1 / n))
        # Divided by the aversion, so that problems have the scale of their covariances.
        c = mu / part[aversion].to_numpy(float)[:, None] if aversion else np.zeros_like(mu)
        w = solve(cov, c, floor, top)
        return _report(w, mu, cov, residual(w, cov, c, floor, top))

    return _batched(problems, run)


def efficient_frontier(problems: DataFrame, aversions: Sequence[float], **bounds: float) -> DataFrame:
    """Every group's best portfolio at each aversion to risk: a row per group and point, spread over all tasks."""
    points = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(float(a)).alias("aversion")) for i, a in enumerate(aversions)])
    keys = [c for c in problems.columns]
    rows = problems.select(*keys, F.explode(points).alias("__p")).select(*keys, "__p.point", "__p.aversion")
    rows = _spread(rows, "point", *[c for c in keys if c not in ("assets", "means", "cov", "deviations")])
    return mean_variance(rows, "aversion", **bounds)


def tracking_portfolios(df: DataFrame, benchmark: Column, by: Sequence[str] = (), asset: str = "asset", at: str = "ts", x: str = "ret") -> DataFrame:
    """Each group's weights that make the variance of returns beyond the benchmark's least; volatility is the tracking
    error. benchmark is a column of df: the benchmark's return at the row's moment."""
    active = df.withColumn("__active", F.col(x) - benchmark)
    return mean_variance(group_panels(active, by, asset, at, "__active"))


def black_litterman(problems: DataFrame, caps: str, views: str, tau: float = 0.05, aversion: float = 2.5) -> DataFrame:
    """Posterior portfolios: caps is an array of market weights in the order of assets, views an array of structs
    (weights array in that order, ret, confidence). Weights are clipped to [0, 1] and scaled to one; equal ones where
    nothing is left. expected_return is by the posterior means."""

    def run(part: pd.DataFrame, mu: np.ndarray, cov: Dense | Factors) -> pd.DataFrame:
        weights, means = [], []
        for k, (cap, seen) in enumerate(zip(part[caps], part[views], strict=True)):
            one, n = cov.one(k), mu.shape[1]
            times = lambda v: one.times(v[None])[0]  # noqa: B023, E731
            cap = np.array(cap, float)
            even = aversion * times(cap / cap.sum())
            seen = [] if seen is None else list(seen)
            post = even
            if len(seen):
                p = np.array([np.array(v["weights"], float) for v in seen])
                want = np.array([v["ret"] for v in seen], float)
                # A tenth of what confidence leaves is a view's variance, with a least one.
                doubt = np.diag([(1 - v["confidence"]) * 0.1 + 1e-10 for v in seen])
                wide = tau * np.stack([times(v) for v in p])
                post = even + wide.T @ np.linalg.lstsq(wide @ p.T + doubt, want - p @ even, rcond=None)[0]
            w = np.clip(one.solved(0, post / aversion), 0, 1)
            weights.append(w / w.sum() if w.sum() > 0 else np.full(n, 1 / n))
            means.append(post)
        return _report(np.array(weights), np.array(means), cov, np.zeros(len(part)))

    return _batched(problems, run)
