"""Event studies, filters, rebalancing calendars, and reports by size, holding time and phase of the equity.

Null values do not count, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, lag, ratio, rolling_mean, rolling_std
from quantspark.operators.features import quantile_edges
from quantspark.operators.joins import weight_drift
from quantspark.operators.risk import drawdowns

#: Formats of the calendar periods, and upper ends of holding times in hours with their names: fixed values.
PERIODS = {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "quarterly": "yyyy-'Q'q", "yearly": "yyyy"}
HOLDS = ((4, "<4h"), (12, "4-12h"), (24, "12-24h"), (48, "1-2d"), (168, "2-7d"), (float("inf"), ">7d"))


def event_study(df: DataFrame, events: DataFrame, s: Series, x: str = "ret", market: str = "market", estimate: int = 120, before: int = 1, after: int = 1) -> DataFrame:
    """One row per event: return beyond what the market model of the rows before it says, summed over the rows around it
    (car), its t statistic, mean, highest and lowest, and the model. Events with fewer than two rows to fit, or a market
    that stands still there, have none."""
    past = s.window().rowsBetween(-(estimate - before), -(before + 1))
    rows = df.where(F.col(x).isNotNull() & F.col(market).isNotNull())
    place = rows.withColumns({
        "__p": F.row_number().over(s.window()), "alpha": F.regr_intercept(x, market).over(past), "beta": F.regr_slope(x, market).over(past), "__s": F.stddev_samp(x).over(past), "__v": F.var_samp(market).over(past),
    })
    at = place.join(events.select(*s.key, *s.order).distinct(), [*s.key, *s.order], "left_semi").where("__v > 0")
    at = at.select(*s.key, *s.order, "alpha", "beta", "__s", F.explode(F.sequence(F.col("__p") - before, F.col("__p") + after)).alias("__p"))
    beyond = F.col("__x") - (F.col("alpha") + F.col("beta") * F.col("__m"))
    near = at.join(place.select(*s.key, "__p", F.col(x).alias("__x"), F.col(market).alias("__m")), [*s.key, "__p"]).withColumn("__a", beyond)
    out = near.groupBy(*s.key, *s.order, "alpha", "beta", "__s").agg(F.count("__a").alias("n"), F.sum("__a").alias("car"), F.avg("__a").alias("mean"), F.max("__a").alias("highest"), F.min("__a").alias("lowest"))
    return out.withColumn("t_stat", ratio(F.col("car"), F.col("__s") * F.sqrt("n"))).drop("__s")


def volume_spikes(df: DataFrame, s: Series, volume: str = "volume", lookback: int = 20, times: float = 2.0) -> DataFrame:
    """df with usual (mean volume of the rows before, as many as there are up to lookback), volume_ratio (0 without one)
    and spike."""
    rows = df.withColumn("usual", F.avg(volume).over(s.past(lookback)))
    rows = rows.withColumn("volume_ratio", F.when(F.col("usual") > 0, F.col(volume) / F.when(F.col("usual") > 0, F.col("usual"))).otherwise(0.0))
    return rows.withColumn("spike", F.coalesce(F.col("volume_ratio") > times, F.lit(False)))


def adaptive_threshold(df: DataFrame, s: Series, signal: str, volatility: str, base: float = 0.3, scaling: float = 0.5, n: int = 20) -> DataFrame:
    """df with a threshold that rises with the volatility's distance from its rolling mean in deviations (base until n rows
    are known, or where nothing varies), the signal's size over it, and whether it is above."""
    v = F.col(volatility)
    z = ratio(v - rolling_mean(v, s, n), rolling_std(v, s, n))
    rows = df.withColumn("threshold", F.coalesce(base + z * scaling * base, F.lit(base)))
    return rows.withColumns({"strength": ratio(F.abs(signal), F.col("threshold")), "above": F.coalesce(F.abs(signal) > F.col("threshold"), F.lit(False))})


def filtered(df: DataFrame, tests: Sequence[Column], rule: str = "all") -> DataFrame:
    """Rows that pass all tests, any of them, or more than half; a test that is null is not passed."""
    passed = [F.coalesce(t, F.lit(False)) for t in tests]
    if rule == "majority":
        return df.where(functools.reduce(operator.add, (t.cast("int") for t in passed), F.lit(0)) > len(passed) // 2)
    if rule not in ("all", "any"):
        raise ValueError(f"unknown rule {rule}")
    return df.where(functools.reduce(operator.and_ if rule == "all" else operator.or_, passed, F.lit(rule == "all")))


def turnover_parts(before: DataFrame, after: DataFrame, returns: DataFrame, key: str) -> DataFrame:
    """One row: half the sum of weight changes in all, by drift with the returns, and by trading beyond drift; how many
    positions were opened, closed, raised and cut. Sides are (key, weight) and (key, ret); missing ones are 0."""
    rows = weight_drift(before, after, key).select(key, F.col("current").alias("__b"), F.col("target").alias("__a"))
    rows = rows.join(returns.select(key, F.col("ret").alias("__r")), key, "left").fillna(0.0, ["__r"])
    whole = rows.agg((1 + F.sum(F.col("__b") * F.col("__r"))).alias("__w"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    moved = F.when(F.col("__w") != 0, F.col("__b") * (1 + F.col("__r")) / F.when(F.col("__w") != 0, F.col("__w"))).otherwise(F.col("__b"))
    half = lambda x, y: F.coalesce(F.sum(F.abs(x - y)) / 2, F.lit(0.0))
    number = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    b, a = F.col("__b"), F.col("__a")
    return rows.agg(
        half(a, b).alias("total"), half(moved, b).alias("drift"), half(a, moved).alias("rebalance"), number((b == 0) & (a > 0)).alias("opened"), number((b > 0) & (a == 0)).alias("closed"),
        number((b != 0) & (a > b)).alias("raised"), number((a != 0) & (a < b)).alias("cut"),
    )


def calendar_rebalance(df: DataFrame, targets: DataFrame, day: str, asset: str, value: str, every: str = "monthly") -> DataFrame:
    """(day, asset, current, target, adjustment) on the first day of each period that has rows: what each target asset
    must gain or lose. targets: (asset, weight), broadcast only if Spark finds them small. Days of no value are left out."""
    label = F.date_format(day, PERIODS[every])
    sums = df.groupBy(F.col(day).alias("day"), F.col(asset).alias("asset")).agg(F.sum(value).alias("__v"))
    days = df.groupBy(label.alias("__l")).agg(F.min(day).alias("day")).select("day")
    sums = sums.join(days, "day", "left_semi")
    whole = sums.groupBy("day").agg(F.sum("__v").alias("__w")).where("__w <> 0")
    grid = whole.join(targets.select(F.col("asset"), F.col("weight").alias("target")), F.lit(True))  # the asked-for grid of days and targets
    out = grid.join(sums, ["day", "asset"], "left").withColumn("current", F.coalesce(F.col("__v") / F.col("__w"), F.lit(0.0)))
    return out.select("day", "asset", "current", "target", ((F.col("target") - F.col("current")) * F.col("__w")).alias("adjustment"))


def _gain_over_loss(pnl: str) -> Column:
    return ratio(F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0)), F.sum(F.when(F.col(pnl) < 0, -F.col(pnl)).otherwise(0.0)))


def profit_by_size(df: DataFrame, size: str, pnl: str, by: Sequence[str] = (), n: int = 5) -> DataFrame:
    """(by, bucket from 1, n, profit_factor) of buckets between quantiles of the size; null without a loss."""
    rows = quantile_edges(df.where(F.col(size).isNotNull() & F.col(pnl).isNotNull()), size, n, by)
    return rows.groupBy(*by, (F.col("bucket") + 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), _gain_over_loss(pnl).alias("profit_factor"))


def profit_by_hold(df: DataFrame, hours: str, pnl: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, bucket, n, mean, win_rate, profit_factor) by holding time, upper ends included; times of 0 or less have none."""
    bucket = F.when(F.col(hours) <= 0, None)
    for top, name in HOLDS:
        bucket = bucket.when(F.col(hours) <= top, name)
    rows = df.where(F.col(pnl).isNotNull()).withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    return rows.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(pnl).alias("mean"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"), _gain_over_loss(pnl).alias("profit_factor"))


def equity_phases(df: DataFrame, s: Series = TICKS, equity: str = "price", threshold: float = -0.05) -> DataFrame:
    """df with its drawdown, phase (drawdown at the threshold or below, else growth) and the rows that the phase has lasted."""
    rows = drawdowns(df, s, equity).withColumn("phase", F.when(F.col("drawdown") <= threshold, "drawdown").otherwise("growth"))
    rows = rows.withColumn("__run", F.sum(F.coalesce((F.col("phase") != lag("phase", s)).cast("int"), F.lit(1))).over(s.so_far()))
    lasted = F.row_number().over(Window.partitionBy(*s.key, "__run").orderBy(*s.order))
    return rows.withColumn("lasted", lasted).drop("__run")


def rolling_growth(df: DataFrame, s: Series = TICKS, x: str = "ret", n: int = 20, periods: int = 252) -> DataFrame:
    """df with growth: yearly compound return of the last n rows, 0 after a whole loss, null until n are known."""
    known = F.count(x).over(s.last(n)) == n
    whole = F.product(1 + F.col(x)).over(s.last(n))
    return df.withColumn("growth", F.when(known, F.when(whole > 0, F.pow(whole, F.lit(periods / n)) - 1).otherwise(0.0)))


def event_clusters(df: DataFrame, day: str, days: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """(by, start, end, events) of events that follow each other within so many days, two at least. Events are counted by
    day first, so that the window sees days, not events."""
    at = F.to_date(day)
    sums = df.where(at.isNotNull()).groupBy(*by, at.alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__d")
    sums = sums.withColumn("__new", F.coalesce((F.date_diff(F.col("__d"), F.lag("__d").over(w)) > days).cast("int"), F.lit(1)))
    sums = sums.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = sums.groupBy(*by, "__run").agg(F.min("__d").alias("start"), F.max("__d").alias("end"), F.sum("__n").alias("events"))
    return out.where("events > 1").drop("__run")
