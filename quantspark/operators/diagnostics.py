"""Diagnostics of volatility, co-movement, breaches, signals and trading habits: aggregates and windows by series.

Null values do not count, an empty table gives an empty result, and rows of one key and order come in any order among
themselves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, lag, ratio, rolling_mean, rolling_std
from quantspark.operators import quantiles
from quantspark.operators.joins import pair_correlation
from quantspark.operators.risk import var_backtest
from quantspark.operators.statistics import normal_cdf
from quantspark.pieces import dealt

#: Drawdowns from which a position is cut to a share, and the one that closes it: fixed values.
TIERS = ((0.05, 0.80), (0.10, 0.50), (0.15, 0.30), (0.20, 0.10))
KILL = 0.30


def range_volatility(df: DataFrame, s: Series = TICKS, n: int = 21, periods: int = 252) -> DataFrame:
    """df with parkinson and garman_klass: yearly volatility of the last n bars from their ranges, null before that and
    where one of them has a price of zero."""
    wide, body = F.pow(F.ln(ratio(F.col("high"), F.col("low"))), 2), F.pow(F.ln(ratio(F.col("close"), F.col("open"))), 2)
    yearly = lambda v: F.when(v >= 0, F.sqrt(v) * math.sqrt(periods))
    rows = df.withColumns({"__p": wide / (4 * math.log(2)), "__g": 0.5 * wide - (2 * math.log(2) - 1) * body})
    return rows.withColumns({"parkinson": yearly(rolling_mean(F.col("__p"), s, n)), "garman_klass": yearly(rolling_mean(F.col("__g"), s, n))}).drop("__p", "__g")


def volatility_cone(df: DataFrame, s: Series = TICKS, x: str = "ret", windows: Sequence[int] = (5, 10, 21), periods: int = 252) -> DataFrame:
    """(key, window, current, lowest, q25, median, q75, highest) of the rolling yearly volatility; lengths that a series
    does not reach have no row. All lengths share one sort."""
    vols = [F.struct(F.lit(n).alias("window"), (rolling_std(F.col(x), s, n) * math.sqrt(periods)).alias("vol")) for n in windows]
    rows = df.select(*s.key, *s.order, F.array(*vols).alias("__v")).select(*s.key, F.struct(*s.order).alias("__at"), F.inline("__v")).where("vol is not null")
    by = [*s.key, "window"]
    ends = rows.groupBy(*by).agg(F.max_by("vol", "__at").alias("current"), F.min("vol").alias("lowest"), F.max("vol").alias("highest"))
    return ends.join(quantiles.exact(rows, "vol", {"q25": 0.25, "median": 0.5, "q75": 0.75}, by), by)


def runs_test(df: DataFrame, s: Series, x: str, threshold: float = 0.0) -> DataFrame:
    """(key, n, wins, runs, z, p): whether wins and losses alternate as by chance; p is 1 where only one of them occurs."""
    win = (F.col(x) > threshold).cast("int")
    rows = dealt(df.where(F.col(x).isNotNull()).select(*s.key, *s.order, win.alias("__w")), s).lag(__b="__w").rows
    rows = rows.withColumn("__new", F.coalesce((F.col("__w") != F.col("__b")).cast("int"), F.lit(1)))
    out = rows.groupBy(*s.key).agg(F.count(F.lit(1)).alias("n"), F.sum("__w").alias("wins"), F.sum("__new").alias("runs"))
    n, a = F.col("n").cast("double"), F.col("wins").cast("double")
    both = 2 * a * (n - a)
    spread = F.when(n > 1, both * (both - n) / (n * n * (n - 1)))
    out = out.withColumn("z", F.when(spread > 0, (F.col("runs") - (both / n + 1)) / F.sqrt(F.when(spread > 0, spread))).otherwise(0.0))
    return out.withColumn("p", F.when(spread > 0, 2 * (1 - normal_cdf(F.abs("z")))).otherwise(1.0))


def co_moments(df: DataFrame, by: Sequence[str], x: str, market: str, least: int = 10) -> DataFrame:
    """Downside and upside beta (null below so many rows of that side), coskewness and cokurtosis with the market, and
    the shares in per cent of its compounded gains and losses (100 where it has none)."""
    a, b = F.col(x), F.col(market)
    rows = df.where(a.isNotNull() & b.isNotNull())
    sides = {"down": b < 0, "up": b > 0}
    parts = []
    for name, test in sides.items():
        own, its = F.when(test, a), F.when(test, b)
        parts += [F.count(its).alias(f"__n_{name}"), F.covar_samp(own, its).alias(f"__c_{name}"), F.var_samp(its).alias(f"__v_{name}")]
        parts += [F.product(1 + own).alias(f"__a_{name}"), F.product(1 + its).alias(f"__b_{name}")]
    means = {"a": a, "b": b, "b2": b * b, "b3": b * b * b, "ab": a * b, "ab2": a * b * b, "ab3": a * b * b * b}
    parts += [F.avg(c).alias(f"__{n}") for n, c in means.items()]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(a).alias("__sa"), F.stddev_samp(b).alias("__sb"), *parts)
    m = {n: F.col(f"__{n}") for n in means}
    third = m["ab2"] - 2 * m["b"] * m["ab"] - m["a"] * m["b2"] + 2 * m["a"] * m["b"] * m["b"]
    fourth = m["ab3"] - 3 * m["b"] * m["ab2"] + 3 * m["b"] * m["b"] * m["ab"] - m["a"] * m["b3"] + 3 * m["a"] * m["b"] * m["b2"] - 3 * m["a"] * m["b"] * m["b"] * m["b"]
    varies = (F.col("__sa") >= 1e-12) & (F.col("__sb") >= 1e-12)

    def beta(side: str) -> Column:
        return F.when((F.col(f"__n_{side}") >= least) & (F.col(f"__v_{side}") >= 1e-18), F.col(f"__c_{side}") / F.when(F.col(f"__v_{side}") > 0, F.col(f"__v_{side}")))

    def capture(side: str) -> Column:
        share = ratio(F.col(f"__a_{side}") - 1, F.col(f"__b_{side}") - 1)
        return F.when(F.col(f"__n_{side}") > 0, F.coalesce(100 * share, F.lit(100.0))).otherwise(100.0)

    return out.select(
        *by, "n", beta("down").alias("down_beta"), beta("up").alias("up_beta"),
        F.when(varies, third / (F.col("__sa") * F.col("__sb") * F.col("__sb"))).alias("coskewness"),
        F.when(varies, fourth / (F.col("__sa") * F.col("__sb") * F.col("__sb") * F.col("__sb"))).alias("cokurtosis"),
        capture("up").alias("up_capture"), capture("down").alias("down_capture"),
    )


def breach_independence(df: DataFrame, s: Series, tail: float = 0.05) -> DataFrame:
    """Whether breaches of rolling_var follow each other: counts of the four steps, likelihood ratios of independence and
    of independence and coverage together, with their p values (one and two degrees of freedom). A breach that is null is
    unknown: the steps to and from it do not count."""
    rows = df.where(F.col("var").isNotNull()).select(*s.key, *s.order, "var", "breach").withColumn("__b", lag("breach", s))
    n = lambda before, now: F.count_if((F.col("__b") == F.lit(before)) & (F.col("breach") == F.lit(now)))
    steps = rows.where(F.col("__b").isNotNull()).groupBy(*s.key).agg(n(False, False).alias("n00"), n(False, True).alias("n01"), n(True, False).alias("n10"), n(True, True).alias("n11"))
    n00, n01, n10, n11 = (F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11"))

    def likelihood(stay: Column, go: Column, p: Column) -> Column:
        inside = F.when((p > 0) & (p < 1), p)
        return F.when(inside.isNotNull(), stay * F.ln(1 - inside) + go * F.ln(inside)).otherwise(0.0)

    p = ratio(n01 + n11, n00 + n01 + n10 + n11, 0.0)
    free = likelihood(n00, n01, ratio(n01, n00 + n01, 0.0)) + likelihood(n10, n11, ratio(n11, n10 + n11, 0.0))
    one = likelihood(n00, n01, p) + likelihood(n10, n11, p)
    out = steps.withColumn("lr_independence", F.greatest(-2 * (one - free), F.lit(0.0)))
    out = out.join(var_backtest(df, s.key, tail).select(*s.key, "kupiec"), list(s.key)).withColumn("lr_coverage", F.col("kupiec") + F.col("lr_independence")).drop("kupiec")
    return out.withColumns({"p_independence": 2 * (1 - normal_cdf(F.sqrt("lr_independence"))), "p_coverage": F.least(F.exp(-F.col("lr_coverage") / 2), F.lit(1.0))})


def signal_persistence(df: DataFrame, s: Series = TICKS, signal: str = "signal", n: int = 10) -> DataFrame:
    """Runs of equal signals: number, mean, longest and shortest; share of rows that change the signal, over all rows and
    over n rows (mean, highest, lowest; a shorter series counts as one stretch)."""
    rows = df.where(F.col(signal).isNotNull()).select(*s.key, *s.order, signal)
    rows = rows.withColumn("__flip", (F.col(signal) != lag(signal, s)).cast("int"))
    rows = rows.withColumn("__run", F.sum(F.coalesce("__flip", F.lit(1))).over(s.so_far()))
    rows = rows.withColumn("__rate", F.when(F.count(F.lit(1)).over(s.last(n)) == n, F.sum("__flip").over(s.last(n - 1)) / (n - 1)))
    runs = rows.groupBy(*s.key, "__run").agg(F.count(F.lit(1)).alias("__n"), F.sum("__flip").alias("__f"), F.sum("__rate").alias("__s"), F.count("__rate").alias("__c"), F.max("__rate").alias("__h"), F.min("__rate").alias("__l"))
    out = runs.groupBy(*s.key).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("__n").alias("mean_run"), F.max("__n").alias("longest_run"), F.min("__n").alias("shortest_run"),
        ratio(F.coalesce(F.sum("__f"), F.lit(0)).cast("double"), (F.sum("__n") - 1).cast("double"), 0.0).alias("flip_rate"),
        (F.sum("__s") / F.sum("__c")).alias("mean_rate"), F.max("__h").alias("highest_rate"), F.min("__l").alias("lowest_rate"),
    )
    return out.withColumns({c: F.coalesce(c, "flip_rate") for c in ("mean_rate", "highest_rate", "lowest_rate")})


def trade_habits(df: DataFrame, s: Series, ts: str = "ts", pnl: str = "pnl", seconds: int = 86_400, times: float = 2.0) -> DataFrame:
    """df with revenge (less than so many seconds behind a losing trade), recent (trades of these last seconds, those of
    the same moment included) and overtrading (more than so many times the series' mean of them).

    Moments are counted by periods of that many seconds; a period's window sees it and the one before. Trades take the
    counts of their moment."""
    at, span = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    rows = df.withColumn("__at", at)
    moments = rows.groupBy(*s.key, "__at").agg(F.count(F.lit(1)).alias("__n")).withColumn("__own", F.floor(F.col("__at") / span))
    near = moments.withColumn("__period", F.explode(F.when(F.col("__own").isNull(), F.array(F.col("__own"))).otherwise(F.array(F.col("__own"), F.col("__own") + 1))))
    frame = Window.partitionBy(*s.key, "__period").orderBy("__at").rangeBetween(-(span - 1), 0)
    near = near.withColumn("recent", F.sum("__n").over(frame)).where(F.col("__own").eqNullSafe(F.col("__period")))
    mean = near.groupBy(*s.key).agg((F.sum(F.col("recent") * F.col("__n")) / F.sum("__n")).alias("__mean"))
    told = _same(near.select(*s.key, "__at", "recent"), mean, s.key).select(*s.key, "__at", "recent", (F.col("recent") > times * F.col("__mean")).alias("overtrading"))
    d = dealt(rows, s).lag(__before="__at", __pnl=pnl)
    revenge = (F.col("__pnl") < 0) & (F.col("__at") - F.col("__before") < span)
    rows = d.columns(revenge=F.coalesce(revenge, F.lit(False))).rows.drop("__before", "__pnl", "__piece")
    return _same(rows, told, [*s.key, "__at"]).select(*df.columns, "recent", "revenge", "overtrading")


def _same(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    named = right.select(*[F.col(k).alias(f"{k}__r") for k in keys], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    return df.join(named, match).drop(*[f"{k}__r" for k in keys])


def drawdown_scales(drawdown: Column, most: float = 0.2, floor: float = 0.25, power: float = 2.0, tiers: Sequence[tuple[float, float]] = TIERS, kill: float = KILL) -> dict[str, Column]:
    """Shares of a full position by the loss from the peak (0 or more): falling evenly, early, late, or in steps."""
    t = drawdown / most

    def within(value: Column) -> Column:
        return F.when(drawdown <= 0, 1.0).when(drawdown >= most, floor).when(drawdown.isNotNull(), value)

    steps = F.when(drawdown >= kill, 0.0)
    for level, share in sorted(tiers, reverse=True):
        steps = steps.when(drawdown >= level, share)
    return {
        "linear": within(1 - t * (1 - floor)),
        "convex": within(1 - (1 - F.pow(1 - t, F.lit(power))) * (1 - floor)),
        "concave": within(1 - F.pow(t, F.lit(power)) * (1 - floor)),
        "stepped": steps.when(drawdown.isNotNull(), 1.0),
    }


def correlation_network(df: DataFrame, asset: str, at: str, x: str, threshold: float = 0.5) -> DataFrame:
    """(asset, degree, triangles, clustering): links join assets whose correlation is at least the threshold either way.
    Clustering is the share of an asset's pairs of neighbours that are linked, null below two neighbours. Each triangle
    is found once, from its smallest asset."""
    pairs = pair_correlation(df.where(F.col(x).isNotNull()), asset, at, x)
    links = pairs.where(F.abs("corr") >= threshold).select("a", "b")
    ends = links.select(F.explode(F.array("a", "b")).alias("asset")).groupBy("asset").agg(F.count(F.lit(1)).alias("degree"))
    second, third = links.select(F.col("a").alias("b"), F.col("b").alias("c")), links.select("a", F.col("b").alias("c"))
    found = links.join(second, "b").join(third, ["a", "c"]).select(F.explode(F.array("a", "b", "c")).alias("asset")).groupBy("asset").agg(F.count(F.lit(1)).alias("triangles"))
    nodes = df.where(F.col(x).isNotNull()).select(F.col(asset).alias("asset")).where("asset is not null").distinct()
    out = nodes.join(ends, "asset", "left").join(found, "asset", "left").na.fill(0, ["degree", "triangles"])
    return out.withColumn("clustering", F.when(F.col("degree") > 1, F.col("triangles") / (F.col("degree") * (F.col("degree") - 1) / 2)))


def threshold_grid(df: DataFrame, prob: str, ret: str, thresholds: Sequence[float] = (0.5, 0.6, 0.7), by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, pnl, best): what trading above a threshold and against below its complement earned; the best is
    the first of the largest. The returns that judge it are those it trades: for looking back only."""
    grid = F.posexplode(F.array(*[F.lit(float(t)) for t in thresholds]))
    rows = df.where(F.col(prob).isNotNull() & F.col(ret).isNotNull()).select(*by, prob, ret, grid.alias("__n", "threshold"))
    earned = F.when(F.col(prob) > F.col("threshold"), F.col(ret)).when(F.col(prob) < 1 - F.col("threshold"), -F.col(ret)).otherwise(0.0)
    sums = rows.groupBy(*by, "__n", "threshold").agg(F.sum(earned).alias("pnl"))
    best = F.max(F.struct("pnl", (-F.col("__n")).alias("back")))
    top = sums.groupBy(*by).agg(best.alias("__b")).select(*[F.col(b).alias(f"__{b}") for b in by], (-F.col("__b.back")).alias("__best"))
    match = F.lit(True)
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return sums.join(top, match).select(*by, "threshold", "pnl", (F.col("__n") == F.col("__best")).alias("best"))


def risk_contributions(df: DataFrame, asset: str = "asset", at: str = "ts", x: str = "ret", weight: str | None = None) -> DataFrame:
    """(asset, weight, marginal, component, share): what each asset adds to the deviation of the portfolio of these
    weights (equal ones if none are named), over the moments that have every asset. The covariance with the portfolio
    says it, so no matrix of assets is made."""
    rows = df.where(F.col(x).isNotNull())
    names = rows.select(asset).distinct().agg(F.count(F.lit(1)).alias("__all"))
    w = F.col(weight) if weight else 1 / F.col("__all")
    rows = rows.crossJoin(F.broadcast(names)).select(F.col(asset).alias("asset"), F.col(at).alias("__at"), F.col(x).alias("__x"), w.alias("weight"), "__all")  # names is one row
    whole = rows.groupBy("__at").agg(F.sum(F.col("weight") * F.col("__x")).alias("__p"), F.count(F.lit(1)).alias("__n"), F.max("__all").alias("__all")).where("__n = __all")
    out = rows.drop("__all").join(whole.select("__at", "__p"), "__at").groupBy("asset").agg(F.max("weight").alias("weight"), F.covar_samp("__x", "__p").alias("__c"), F.stddev_samp("__p").alias("__s"))
    out = out.withColumn("marginal", ratio(F.col("__c"), F.col("__s"), 0.0)).withColumn("component", F.col("weight") * F.col("marginal"))
    return out.withColumn("share", ratio(F.col("component"), F.col("__s"), 0.0)).drop("__c", "__s")
