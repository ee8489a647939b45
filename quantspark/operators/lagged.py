"""Regressions on lags from sums of products: unit roots, cointegrated pairs, Granger causes.

A regression needs its rows only through their Gram matrix. For single series the products of lagged values are summed
per series; for all pairs of a panel they come from block products, once, and every pair's spread or pair of models is
a linear map of them: no spread and no lag of a pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, settled
from quantspark.operators.blocks import Panel, block_products, dealt, numbered
from quantspark.operators.reports import f_p_value

# Critical values at 1, 5 and 10 per cent, one bound beyond, and the p value told below each.
CRITICAL = ((-3.43, 0.005), (-2.86, 0.03), (-2.57, 0.07), (-1.94, 0.15))


def default_lags(n: int) -> int:
    """Lags for a series of n values: 12 for a hundred, growing with the fourth root."""
    return int(12 * (n / 100) ** 0.25)


def unit_root_p(stat: Column) -> Column:
    """An approximate p value by the table of critical values."""
    out = F.least(F.lit(1.0), 0.5 + 0.5 * (1 - F.exp(-0.5 * (stat + 1.94))))
    for bound, p in reversed(CRITICAL):
        out = F.when(stat < bound, p).otherwise(out)
    return F.when(stat.isNotNull(), out)


def gram(rows: DataFrame, by: Sequence[str], z: str) -> DataFrame:
    """(by, gram): the sums of all products of the entries of the array z, by rows, per key. Arrays of a key have one
    length. Each batch is summed as it is read, so a key is never in one task."""
    kinds = dict(rows.dtypes)
    told = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, part in frame.groupby(list(by), dropna=False, sort=False):
                x = np.stack(part[z].to_numpy())
                out.append((*key, (x.T @ x).ravel()))
            yield pd.DataFrame(out, columns=[*by, "__g"])

    sums = rows.select(*by, z).mapInPandas(run, f"{told}, __g array<double>").select(*by, F.posexplode("__g").alias("__k", "__x"))
    sums = sums.groupBy(*by, "__k").agg(F.sum("__x").alias("__x"))
    return sums.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "__x"))), lambda s: s["__x"]).alias("gram"))


def t_of_first(g: np.ndarray, free: int) -> float | None:
    """The t statistic of the first variable in the regression of the last one on the others; None where they are not
    independent or nothing is left over."""
    if free < 1:
        return None
    size = np.sqrt(np.diag(g))
    if not (size[:-1] > 0).all():
        return None
    a, b = g[:-1, :-1] / np.outer(size[:-1], size[:-1]), g[:-1, -1] / size[:-1]
    if np.linalg.cond(a) > 1e13:
        return None
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    rest = max(float(g[-1, -1] - b @ beta), 0.0)
    error = math.sqrt(rest / free * inverse[0, 0])
    return float(beta[0] / error) if error > 0 else None


def augmented_dickey_fuller(df: DataFrame, s: Series = TICKS, x: str = "price", lags: int | None = None) -> DataFrame:
    """(key, n, lags, adf_stat, p_value): the t statistic of the level before in explaining a change beside an intercept
    and so many earlier changes, as many as default_lags says unless given.

    Null values are left out beforehand. The statistic is null where fewer rows than coefficients remain, or where the
    level or the changes do not vary.
    """
    known = df.where(F.col(x).isNotNull()).withColumn("__n", F.count(F.lit(1)).over(s.whole()))
    if lags is None:
        most = known.agg(F.max("__n")).first()[0] or 0
        widest, k = default_lags(most), (F.pow(F.col("__n") / 100.0, F.lit(0.25)) * 12).cast("int")
    else:
        widest, k = lags, F.lit(lags)
    past = F.collect_list(F.col(x).cast("double") - F.col("__mean")).over(s.last(widest + 2))
    rows = known.withColumn("__mean", F.avg(x).over(s.whole())).withColumn("__past", past).withColumn("__k", k)
    back = lambda i: F.get("__past", F.size("__past") - 1 - i)
    change = lambda i: back(i) - back(i + 1)
    earlier = [F.when(F.col("__k") >= i, change(i)).otherwise(0.0) for i in range(1, widest + 1)]
    whole = rows.where(F.size("__past") >= F.col("__k") + 2).select(*s.key, F.array(back(1), *earlier, F.lit(1.0), change(0)).alias("__z"))
    told = rows.groupBy(*s.key).agg(F.max("__n").alias("n"), F.max("__k").alias("lags"))

    @F.pandas_udf("double")
    def statistic(grams: pd.Series, used: pd.Series) -> pd.Series:
        out = []
        for g, m in zip(grams, used, strict=True):
            if g is None:
                out.append(None)
                continue
            full = np.array(g).reshape(widest + 3, -1)
            pick = [0, *range(1, m + 1), widest + 1, widest + 2]
            part = full[np.ix_(pick, pick)]
            out.append(t_of_first(part, round(part[-2, -2]) - m - 2))
        return pd.Series(out, dtype="float64")

    sums = told.join(gram(whole, s.key, "__z"), list(s.key), "left")
    out = sums.select(*s.key, "n", "lags", F.when(F.col("gram").isNotNull(), statistic("gram", "lags")).alias("adf_stat"))
    return out.withColumn("p_value", unit_root_p(F.col("adf_stat")))


@dataclass
class LagPanel:
    """Sums of products of values and their lags 0 to depth for all asset pairs.

    blocks (i, j, rows, columns, xy): sums over moments from depth on, an asset taking depth + 1 places. assets (i, names,
    means, sums, early, own): per block of assets, their names, means, sums of lags, values before depth, own products.
    """

    blocks: DataFrame
    assets: DataFrame
    n_moments: int
    lags: int
    kind: str


def lag_panel(df: DataFrame, lags: int | None, asset: str = "asset", at: str = "ts", x: str = "ret", extra: int = 0, side: int = 128, depth: int = 512) -> LagPanel:
    """Products of lags of all pairs, over the moments that every asset has, in their order. lags is counted in those
    moments, default_lags of their number if None, and extra is added to it. A moment sends each value lags + 1 times."""
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(F.col(asset).alias("asset"), F.col(at).alias("at")).agg(F.avg(x).alias("x"))
    rows = settled(rows)
    assets = rows.select("asset").distinct()
    n = assets.count()
    moments = settled(numbered(rows.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("at"), ["at"], "pos"))
    t = moments.count()
    m = (default_lags(t) if lags is None else lags) + extra
    width = m + 1
    names = settled(dealt(assets, "asset", max(1, -(-n * width // side)), "block", "place"))
    kept = rows.join(moments, "at").join(names, "asset")
    means = kept.groupBy("asset").agg(F.avg("x").alias("mean"))
    kept = settled(kept.join(means, "asset").withColumn("x", F.col("x") - F.col("mean")))
    spread = kept.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(m)))).withColumn("t", F.col("pos") + F.col("lag")).where((F.col("t") >= m) & (F.col("t") < t))
    cells = spread.select(F.floor(F.col("t") / depth).cast("int").alias("tile"), "block", (F.col("t") % depth).cast("int").alias("row"), (F.col("place") * width + F.col("lag")).alias("place"), "x")
    blocks = settled(block_products(Panel(cells, names, n, t, side, depth, dict(df.dtypes)[asset])))
    sums = cells.groupBy("block", "place").agg(F.sum("x").alias("x"))
    sums = sums.select("block", F.floor(F.col("place") / width).cast("int").alias("place"), F.struct((F.col("place") % width).alias("lag"), "x").alias("s"))
    sums = sums.groupBy("block", "place").agg(F.transform(F.sort_array(F.collect_list("s")), lambda v: v["x"]).alias("sums"))
    early = kept.where(F.col("pos") < m).groupBy("asset").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("early"))
    told = names.join(means, "asset").join(early, "asset", "left").join(sums, ["block", "place"])
    packed = F.sort_array(F.collect_list(F.struct("place", "asset", "mean", "sums", F.coalesce("early", F.array().cast("array<double>")).alias("early"))))
    told = told.groupBy(F.col("block").alias("i")).agg(packed.alias("p"))
    at_block = lambda c: F.transform("p", lambda v: v[c]).alias(c + "s")
    told = told.select("i", at_block("asset"), at_block("mean"), F.transform("p", lambda v: v["sums"]).alias("sums"), F.transform("p", lambda v: v["early"]).alias("early"))
    own = blocks.where("i = j").select("i", F.col("rows").alias("size"), "xy")

    def diagonal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = np.array(row["xy"]).reshape(row["size"], -1)
                parts = [g[k : k + width, k : k + width].ravel().tolist() for k in range(0, row["size"], width)]
                yield pa.RecordBatch.from_pylist([{"i": row["i"], "own": parts}], schema=pa.schema([("i", pa.int32()), ("own", pa.list_(pa.list_(pa.float64())))]))

    told = told.join(own.mapInArrow(diagonal, "i int, own array<array<double>>"), "i")
    return LagPanel(blocks, settled(told), t, m, dict(df.dtypes)[asset])


@dataclass
class Pairs:
    """Some pairs (y, x) of a block: names, means, sums, early values and products of both, as stacked arrays."""

    y: list
    x: list
    y_mean: np.ndarray
    x_mean: np.ndarray
    y_sums: np.ndarray
    x_sums: np.ndarray
    y_early: np.ndarray
    x_early: np.ndarray
    yy: np.ndarray
    xx: np.ndarray
    yx: np.ndarray

    def turned(self) -> Pairs:
        return Pairs(self.x, self.y, self.x_mean, self.y_mean, self.x_sums, self.y_sums, self.x_early, self.y_early, self.xx, self.yy, self.yx.transpose(0, 2, 1))

    def take(self, keep: np.ndarray) -> Pairs:
        pick = lambda v: [v[k] for k in keep] if isinstance(v, list) else v[keep]
        return Pairs(*(pick(v) for v in vars(self).values()))


def _each_pair(p: LagPanel, score: Callable[[Pairs], dict[str, Sequence]], columns: Sequence[tuple[str, pa.DataType]], told: str, chunk: int = 4096) -> DataFrame:
    """(y, x, what score gives) for pairs y < x; blocks meet the assets of both their sides by joins."""
    one = p.assets.select("i", *[F.col(c).alias(f"y_{c}") for c in ("assets", "means", "sums", "early", "own")])
    two = p.assets.select(F.col("i").alias("j"), *[F.col(c).alias(f"x_{c}") for c in ("assets", "means", "sums", "early", "own")])
    # Few bytes, much work: a stated number of partitions keeps them from being put together.
    tasks = 2 * p.blocks.sparkSession.sparkContext.defaultParallelism
    rows = p.blocks.join(one, "i").join(two, "j").repartition(tasks, "i", "j")
    width = p.lags + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                ny, nx = len(row["y_assets"]), len(row["x_assets"])
                cross = np.array(row["xy"]).reshape(ny, width, nx, width).transpose(0, 2, 1, 3)
                a, b = np.meshgrid(np.arange(ny), np.arange(nx), indexing="ij")
                keep = (a < b) if row["i"] == row["j"] else np.ones_like(a, bool)
                a, b = a[keep], b[keep]
                stacked = {k: np.array(row[k], float) for k in ("y_means", "x_means", "y_sums", "x_sums", "y_early", "x_early")}
                own = {k: np.array(row[k], float).reshape(-1, width, width) for k in ("y_own", "x_own")}
                for at in range(0, len(a), chunk):
                    u, v = a[at : at + chunk], b[at : at + chunk]
                    pairs = Pairs([row["y_assets"][k] for k in u], [row["x_assets"][k] for k in v], stacked["y_means"][u], stacked["x_means"][v], stacked["y_sums"][u], stacked["x_sums"][v], stacked["y_early"][u], stacked["x_early"][v], own["y_own"][u], own["x_own"][v], cross[u, v])
                    # Assets of different blocks stand in the order of their names, like those of one.
                    swap = np.array([y > x for y, x in zip(pairs.y, pairs.x, strict=True)])
                    for part, turn in ((np.flatnonzero(~swap), False), (np.flatnonzero(swap), True)):
                        if len(part):
                            some = pairs.take(part)
                            out = score(some.turned() if turn else some)
                            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in columns], schema=pa.schema(list(columns)))

    return rows.mapInArrow(run, told)


def _arrow_kind(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def cointegration(df: DataFrame, lags: int | None = None, min_correlation: float = 0.0, asset: str = "asset", at: str = "ts", x: str = "price", side: int = 128, depth: int = 512) -> DataFrame:
    """(asset_y, asset_x, n, correlation, hedge_ratio, adf_stat, p_value, half_life, spread_mean, spread_std) for every two
    assets, y before x in order: y is regressed on x, and the spread y - hedge_ratio * x is tested for a unit root.

    Pairs correlated less than min_correlation in absolute value are dropped before any regression. The half-life comes
    from the slope of changes on the level before, is one at least, and null where the spread does not return. Moments
    that lack an asset do not count. A statistic is null where the spread does not vary or moments are too few.
    """
    p = lag_panel(df, lags, asset, at, x, extra=1, side=side, depth=depth)
    t, k = p.n_moments, p.lags - 1
    rows, size = t - p.lags, p.lags + 1
    # From lags of the level to: level before, earlier changes, change.
    to = np.zeros((size, size))
    to[0, 1] = 1
    for i in range(1, k + 1):
        to[i, i], to[i, i + 1] = 1, -1
    to[-1, 0], to[-1, 1] = 1, -1

    def score(q: Pairs) -> dict[str, Sequence]:
        xx = q.xx[:, 0, 0] + (q.x_early**2).sum(axis=1)
        yy = q.yy[:, 0, 0] + (q.y_early**2).sum(axis=1)
        yx = q.yx[:, 0, 0] + (q.y_early * q.x_early).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = np.where((xx > 0) & (yy > 0), yx / np.sqrt(xx * yy), 0.0)
        keep = np.flatnonzero(np.abs(corr) >= min_correlation)
        q, xx, yy, yx, corr = q.take(keep), xx[keep], yy[keep], yx[keep], corr[keep]
        h = np.divide(yx, xx, out=np.zeros_like(yx), where=xx > 0)
        b = h[:, None, None]
        g = q.yy + b * b * q.xx - b * (q.yx + q.yx.transpose(0, 2, 1))
        sums, early = q.y_sums - h[:, None] * q.x_sums, q.y_early - h[:, None] * q.x_early
        inner = g - sums[:, :, None] * sums[:, None, :] / max(rows, 1)
        z = to @ inner @ to.T
        stats = [t_of_first(m, rows - k - 2) for m in z]
        mean = q.y_mean - h * q.x_mean
        # Level before and change from the second moment on: the lag sums, and the moments before them.
        before = early[:, :-1] if early.shape[1] else early
        change = np.diff(early, axis=1)
        level2 = g[:, 1, 1] + (before**2).sum(axis=1)
        product = g[:, 0, 1] - g[:, 1, 1] + (before * change).sum(axis=1)
        level, moved = sums[:, 1] + before.sum(axis=1), sums[:, 0] - sums[:, 1] + change.sum(axis=1)
        raw2, raw = level2 + 2 * mean * level + (t - 1) * mean**2, product + mean * moved
        phi = 1 + np.divide(raw, raw2, out=np.zeros_like(raw), where=raw2 > 0)
        half = [max(1.0, -math.log(2) / math.log(f)) if 0 < f < 1 else None for f in phi.tolist()]
        spread = yy - h * yx
        std = np.sqrt(np.maximum(spread, 0) / max(t - 1, 1))
        return {"asset_y": q.y, "asset_x": q.x, "n": [t] * len(h), "correlation": corr, "hedge_ratio": h, "adf_stat": stats, "half_life": half, "spread_mean": mean, "spread_std": std}

    kind = _arrow_kind(p.kind)
    doubles = ("correlation", "hedge_ratio", "adf_stat", "half_life", "spread_mean", "spread_std")
    columns = [("asset_y", kind), ("asset_x", kind), ("n", pa.int64()), *[(c, pa.float64()) for c in doubles]]
    out = _each_pair(p, score, columns, f"asset_y {p.kind}, asset_x {p.kind}, n long, " + ", ".join(f"{c} double" for c in doubles))
    return out.withColumn("p_value", unit_root_p(F.col("adf_stat")))


def cointegrated_pairs(df: DataFrame, significance: float = 0.05, min_half_life: float = 1.0, max_half_life: float = 60.0, **options) -> DataFrame:
    """The pairs whose spread has no unit root and returns within the half-lives."""
    return cointegration(df, **options).where((F.col("p_value") < significance) & F.col("half_life").between(min_half_life, max_half_life))


def _rests(g: np.ndarray, first: int) -> tuple[float, float]:
    """What is left of the last variable's squares beside the first variables, and beside all others, from one
    factorisation; variables that depend on others change nothing."""
    size = np.sqrt(np.maximum(np.diag(g), 0))
    size[size == 0] = 1.0
    c = g / np.outer(size, size)
    try:
        last = np.linalg.cholesky(c[:-1, :-1])
        if np.diag(last).min() < 1e-6:
            raise np.linalg.LinAlgError
        part = np.linalg.solve(last, c[:-1, -1]) ** 2
        short, long = c[-1, -1] - part[:first].sum(), c[-1, -1] - part.sum()
    except np.linalg.LinAlgError:
        left = lambda n: c[-1, -1] - c[:n, -1] @ np.linalg.pinv(c[:n, :n], rcond=1e-12, hermitian=True) @ c[:n, -1]
        short, long = left(first), left(len(c) - 1)
    scale = size[-1] ** 2
    return float(short * scale), float(long * scale)


def granger_pairs(df: DataFrame, max_lag: int = 5, asset: str = "asset", at: str = "ts", x: str = "ret", side: int = 128, depth: int = 512) -> DataFrame:
    """(cause, effect, lag, n, f_stat, p_value) for both directions of every two assets and each lag up to max_lag: do so
    many earlier values of the cause help those of the effect to explain it?

    A statistic is 0 and its p value 1 where rows are too few, a series does not vary, or nothing is explained.
    """
    p = lag_panel(df, max_lag, asset, at, x, side=side, depth=depth)
    t, m = p.n_moments, p.lags

    def moments(one: np.ndarray, two: np.ndarray, both: np.ndarray, s1: np.ndarray, s2: np.ndarray, e1: np.ndarray, e2: np.ndarray, lag: int) -> np.ndarray:
        """Centred products of effect lags 1..lag, cause lags 1..lag and the effect, rows from lag on."""
        u, v = [*range(1, lag + 1)], [0]
        late = np.block([[one[np.ix_(u, u)], both[np.ix_(u, u)], one[np.ix_(u, v)]], [both[np.ix_(u, u)].T, two[np.ix_(u, u)], both[np.ix_(v, u)].T], [one[np.ix_(v, u)], both[np.ix_(v, u)], one[np.ix_(v, v)]]])
        sums = np.concatenate([s1[u], s2[u], s1[v]])
        for r in range(lag, m):
            row = np.concatenate([e1[r - lag : r][::-1], e2[r - lag : r][::-1], e1[r : r + 1]])
            late, sums = late + np.outer(row, row), sums + row
        return late - np.outer(sums, sums) / max(t - lag, 1)

    def score(q: Pairs) -> dict[str, Sequence]:
        out: dict[str, list] = {c: [] for c in ("cause", "effect", "lag", "n", "f_stat", "p_value")}
        for k in range(len(q.y)):
            sides = ((q.x[k], q.y[k], q.yy[k], q.xx[k], q.yx[k], q.y_sums[k], q.x_sums[k], q.y_early[k], q.x_early[k]), (q.y[k], q.x[k], q.xx[k], q.yy[k], q.yx[k].T, q.x_sums[k], q.y_sums[k], q.x_early[k], q.y_early[k]))
            flat = min(q.yy[k, 0, 0] + (q.y_early[k] ** 2).sum(), q.xx[k, 0, 0] + (q.x_early[k] ** 2).sum()) < 1e-20 * max(t, 1)
            for cause, effect, one, two, both, s1, s2, e1, e2 in sides:
                for lag in range(1, m + 1):
                    n, f, value = t - lag, 0.0, 1.0
                    if t >= m + 2 and n >= 2 * lag + 2 and not flat:
                        short, long = _rests(moments(one, two, both, s1, s2, e1, e2, lag), lag)
                        if 0 < long < short:
                            f = (short - long) / lag / (long / (n - 2 * lag - 1))
                            value = f_p_value(f, lag, n - 2 * lag - 1)
                    for c, what in zip(out, (cause, effect, lag, n, f, value), strict=True):
                        out[c].append(what)
        return out

    kind = _arrow_kind(p.kind)
    columns = [("cause", kind), ("effect", kind), ("lag", pa.int32()), ("n", pa.int64()), ("f_stat", pa.float64()), ("p_value", pa.float64())]
    return _each_pair(p, score, columns, f"cause {p.kind}, effect {p.kind}, lag int, n long, f_stat double, p_value double")


def granger_links(tests: DataFrame, significance: float = 0.05) -> DataFrame:
    """(one, other, direction, best_lag, p_forward, p_back) from granger_pairs: the lag of the smallest p value each way,
    and which way is significant: forward, back, both or none."""
    forward = F.col("cause") < F.col("effect")
    rows = tests.select(F.least("cause", "effect").alias("one"), F.greatest("cause", "effect").alias("other"), forward.alias("forward"), "lag", "p_value")
    best = lambda way: F.min(F.when(F.col("forward") == way, F.struct("p_value", "lag")))
    out = rows.groupBy("one", "other").agg(best(True).alias("f"), best(False).alias("b"))
    f, b = F.col("f.p_value") < significance, F.col("b.p_value") < significance
    way = F.when(f & b, "both").when(f, "forward").when(b, "back").otherwise("none")
    nearer = F.when(F.col("b.p_value") < F.col("f.p_value"), F.col("b.lag")).otherwise(F.col("f.lag"))
    return out.select("one", "other", way.alias("direction"), nearer.alias("best_lag"), F.col("f.p_value").alias("p_forward"), F.col("b.p_value").alias("p_back"))
