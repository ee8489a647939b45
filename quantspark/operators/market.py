"""Resampling, seasonality, regimes, liquidity, order flow and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, full, lag, ratio, rolling_mean, rolling_std, simple_return
from quantspark.pieces import Dealt, dealt


def resample_bars(df: DataFrame, every: str, by: Sequence[str] = ("asset",), ts: str = "ts", price: str = "price", tie: str = "tie") -> DataFrame:
    """Open, high, low, close, count and time-weighted mean in tumbling windows of event time.

    A price weighs the seconds since the tick before it, the very first one nothing; the mean is null where no time
    passed. The tick before a window's first one is the last of the window before, so only one row a window meets the
    whole series.
    """
    at = F.struct(ts, tie)
    rows = df.withColumn("__w", F.window(ts, every)).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    inside = Window.partitionBy(*by, "__w").orderBy(ts, tie)
    rows = rows.withColumn("__d", (F.col("__us") - F.lag("__us").over(inside)) / 1e6)
    bars = rows.groupBy(*by, "__w").agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.count(price).alias("n"),
        F.coalesce(F.sum(F.col(price) * F.col("__d")), F.lit(0.0)).alias("__sum"),
        F.coalesce(F.sum(F.when(F.col(price).isNotNull(), F.col("__d"))), F.lit(0.0)).alias("__time"),
        F.min("__us").alias("__first"),
        F.max("__us").alias("__last"),
    )
    gap = F.coalesce((F.col("__first") - F.lag("__last").over(Window.partitionBy(*by).orderBy("__w.start"))) / 1e6, F.lit(0.0))
    twap = ratio(F.col("__sum") + F.coalesce(F.col("open") * gap, F.lit(0.0)), F.col("__time") + F.when(F.col("open").isNotNull(), gap).otherwise(0.0))
    return bars.select(*by, F.col("__w.start").alias("start"), "open", "high", "low", "close", "n", twap.alias("twap"))


def vwap_bars(df: DataFrame, every: str, by: Sequence[str], ts: str, price: str, volume: str) -> DataFrame:
    return df.groupBy(*by, F.window(ts, every).alias("w")).agg(ratio(F.sum(F.col(price) * F.col(volume)), F.sum(volume)).alias("vwap"), F.sum(volume).alias("volume")).select(*by, F.col("w.start").alias("start"), "vwap", "volume")


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Date parts (Monday is 1), month and quarter ends, and sine and cosine of weekday and month."""
    t = F.col(ts)
    turn = lambda x, n: 2 * 3.141592653589793 * x / n
    return df.withColumns(
        {
            "year": F.year(t),
            "quarter": F.quarter(t),
            "month": F.month(t),
            "iso_week": F.weekofyear(t),
            "day": F.dayofmonth(t),
            "year_day": F.dayofyear(t),
            "weekday": F.weekday(t) + 1,
            "weekend": F.weekday(t) >= 5,
            "month_end": F.to_date(t) == F.last_day(t),
            "month_sin": F.sin(turn(F.month(t), 12)),
            "month_cos": F.cos(turn(F.month(t), 12)),
            "weekday_sin": F.sin(turn(F.weekday(t) + 1, 7)),
            "weekday_cos": F.cos(turn(F.weekday(t) + 1, 7)),
        }
    )


def seasonality(df: DataFrame, part: Column, by: Sequence[str] = (), x: str = "ret") -> DataFrame:
    """Mean, deviation, win share and t statistic of x by a part of the calendar."""
    c = F.col(x)
    out = df.where(c.isNotNull()).groupBy(*by, part.alias("part")).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.avg((c > 0).cast("double")).alias("win_rate"))
    return out.withColumn("t_stat", ratio(F.col("mean") * F.sqrt("n"), F.col("std")))


def seasonal_factors(df: DataFrame, part: Column, x: str) -> DataFrame:
    """Mean of each part over the mean of all."""
    means = df.groupBy(part.alias("part")).agg(F.avg(x).alias("mean"))
    overall = df.agg(F.avg(x).alias("overall"))
    return means.crossJoin(F.broadcast(overall)).select("part", ratio(F.col("mean"), F.col("overall")).alias("factor"))  # one row


def volatility_regimes(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 10, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """low, normal or high: rolling volatility more than so many deviations below or above its mean over the series.
    Rows without a volatility are normal. Mean and deviation are plain aggregates, which merge."""
    rows = df.withColumn("__r", simple_return(price, s))
    rows = rows.withColumn("vol", rolling_std(F.col("__r"), s, n))
    stats = rows.groupBy(*s.key).agg(F.avg("vol").alias("__m"), F.stddev_samp("vol").alias("__s"), F.count("vol").alias("__n"))
    spread = F.when(F.col("__n") > 1, F.col("__s")).otherwise(0.5 * F.col("__m"))
    rows = rows.join(stats.select(*s.key, (F.col("__m") - low * spread).alias("__a"), (F.col("__m") + high * spread).alias("__b")), list(s.key))
    regime = F.when(F.col("vol") < F.col("__a"), "low").when(F.col("vol") > F.col("__b"), "high").otherwise("normal")
    return rows.withColumn("regime", regime).drop("__r", "__a", "__b")


def trend_regimes(df: DataFrame, s: Series = TICKS, price: str = "price", fast: int = 5, slow: int = 20, band: float = 0.02) -> DataFrame:
    rows = df.withColumn("__f", rolling_mean(F.col(price), s, fast)).withColumn("__s", rolling_mean(F.col(price), s, slow))
    gap = ratio(F.col("__f") - F.col("__s"), F.col("__s"))
    return rows.withColumn("trend", F.when(gap.isNull(), None).when(gap > band, "up").when(gap < -band, "down").otherwise("flat")).drop("__f", "__s")


def transitions(df: DataFrame, s: Series, state: str) -> DataFrame:
    """Counts and shares of moves between states of neighbouring rows."""
    rows = df.withColumn("from", lag(state, s)).where(F.col("from").isNotNull() & F.col(state).isNotNull())
    counts = rows.groupBy("from", F.col(state).alias("to")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def spells(df: DataFrame, s: Series, state: str) -> DataFrame:
    """Number, mean and longest length of the runs of each state."""
    rows = df.where(F.col(state).isNotNull())
    rows = rows.withColumn("__c", F.coalesce((F.col(state) != lag(state, s)).cast("int"), F.lit(1))).withColumn("__run", F.sum("__c").over(s.so_far()))
    runs = rows.groupBy(*s.key, "__run").agg(F.max(state).alias(state), F.count(F.lit(1)).alias("n"))
    return runs.groupBy(state).agg(F.count(F.lit(1)).alias("spells"), F.avg("n").alias("mean_length"), F.max("n").alias("longest"))


def amihud(df: DataFrame, by: Sequence[str], ret: str, value: str) -> DataFrame:
    """Mean of absolute return per million of traded value."""
    return df.groupBy(*by).agg(F.avg(1e6 * ratio(F.abs(F.col(ret)), F.col(value))).alias("illiquidity"), F.count(ret).alias("n"))


def roll_spread(df: DataFrame, s: Series, price: str) -> DataFrame:
    """Twice the root of the negative covariance of neighbouring price changes; 0 where it is not negative."""
    rows = df.withColumn("__d", F.col(price) - lag(price, s))
    rows = rows.withColumn("__e", lag("__d", s)).where(F.col("__e").isNotNull())
    out = rows.groupBy(*s.key).agg(F.covar_samp("__d", "__e").alias("cov"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("spread", F.when(F.col("cov") < 0, 2 * F.sqrt(F.abs("cov"))).otherwise(0.0))


def order_imbalance(df: DataFrame, s: Series, price: str, volume: str, n: int) -> DataFrame:
    """Volume signed by the tick rule (a zero change keeps the last sign) over all volume of n rows."""
    d = sides(df, s, price).past(n - 1)
    last = d.s.last(n)
    top, bottom = F.sum(F.col("side") * F.col(volume)).over(last), F.sum(volume).over(last)
    rows = d.rows.withColumn("imbalance", full(ratio(top, bottom, 0.0), F.col(volume), last, n))
    return rows.where("NOT __past").drop("__p", "__piece", "__past")


def sides(df: DataFrame, s: Series, price: str) -> Dealt:
    """df in pieces with __p, the price before, and side by the tick rule: 0 until the first change."""
    d = dealt(df, s).lag(__p=price)
    sign = F.signum(F.col(price) - F.col("__p"))
    d = d.columns(__g=F.when(sign != 0, sign)).last_known("side", "__g")
    return d.using(d.rows.withColumn("side", F.coalesce("side", F.lit(0.0))).drop("__g"))


def vpin(df: DataFrame, s: Series, price: str, volume: str, bucket: float, n: int) -> DataFrame:
    """One row for each bucket of the running volume: the mean, over up to n buckets, of their one-sided shares of the
    volume that has a side. Buckets without such volume say nothing; 0 where none of them does."""
    rows = sides(df, s, price).total("__t", volume).rows.withColumn("__b", F.floor(F.col("__t") / bucket))
    signed = F.col("side") * F.col(volume)
    sums = rows.groupBy(*s.key, F.col("__b").alias("bucket")).agg(F.abs(F.sum(signed)).alias("gap"), F.sum(F.abs(signed)).alias("volume"))
    w = Window.partitionBy(*s.key).orderBy("bucket").rowsBetween(-(n - 1), 0)
    return sums.withColumn("vpin", F.coalesce(F.avg(ratio(F.col("gap"), F.col("volume"))).over(w), F.lit(0.0)))


def kyle_lambda(df: DataFrame, s: Series, price: str, volume: str) -> DataFrame:
    """Slope of price change on signed volume."""
    rows = sides(df, s, price).rows.withColumn("__d", F.col(price) - F.col("__p")).withColumn("__v", F.col("side") * F.col(volume))
    return rows.where(F.col("__d").isNotNull()).groupBy(*s.key).agg(F.regr_slope("__d", "__v").alias("kyle_lambda"), F.regr_r2("__d", "__v").alias("r2"))


def volume_profile(df: DataFrame, by: Sequence[str], price: str, volume: str, width: float, value_area: float = 0.7) -> DataFrame:
    """Volume by price bucket, the fullest bucket, and the buckets that hold most of the volume."""
    sums = df.groupBy(*by, (F.floor(F.col(price) / width) * width).alias("bucket")).agg(F.sum(volume).alias("volume"))
    w = Window.partitionBy(*by)
    order = w.orderBy(F.col("volume").desc(), "bucket")
    share = F.coalesce(F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("volume").over(w)
    return sums.withColumn("poc", F.row_number().over(order) == 1).withColumn("in_value_area", share < value_area)


def concentration(df: DataFrame, by: Sequence[str], key: str, x: str, top: int = 3) -> DataFrame:
    """Herfindahl index, effective number, natural entropy, Gini coefficient and share of the largest."""
    sums = df.groupBy(*by, key).agg(F.sum(x).alias("x")).where("x > 0")
    w = Window.partitionBy(*by)
    rows = sums.withColumn("p", F.col("x") / F.sum("x").over(w)).withColumn("up", F.row_number().over(w.orderBy("x", key))).withColumn("down", F.row_number().over(w.orderBy(F.col("x").desc(), key)))
    n = F.count(F.lit(1))
    out = rows.groupBy(*by).agg(
        n.alias("n"),
        F.sum(F.col("p") * F.col("p")).alias("hhi"),
        (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"),
        (2 * F.sum(F.col("up") * F.col("p")) / n - (n + 1) / n).alias("gini"),
        F.sum(F.when(F.col("down") <= top, F.col("p"))).alias("top_share"),
    )
    return out.withColumn("effective_n", 1 / F.col("hhi"))


def sessions(df: DataFrame, by: Sequence[str], gap: str, ts: str = "ts") -> DataFrame:
    """Bursts of rows with no gap as long as the given one: start, length in seconds, rows."""
    out = df.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    return out.select(*by, F.col("w.start").alias("start"), (F.unix_seconds(F.col("last").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))).alias("seconds"), "n")


def triple_barrier(df: DataFrame, s: Series, price: str, up: float = 2.0, down: float = 2.0, horizon: int = 10, volatility: str = "volatility") -> DataFrame:
    """Rows with a volatility above 0 and a row behind them, with label, touch (rows ahead) and touch_return.

    Barriers lie so many volatilities above and below the price: 1 where the upper one is touched first within the
    horizon, -1 for the lower one, 0 where neither is. Near the end the horizon is what is left. A frame holds horizon
    prices at most. From a price of zero there is no return.
    """
    p, vol = F.col(price), F.col(volatility)
    path = F.collect_list(price).over(s.after(horizon))
    first = lambda test: F.array_position(F.transform(F.col("__path"), test), F.lit(True))
    rows = df.withColumn("__path", path).where((F.size("__path") > 0) & (vol > 0))
    rows = rows.withColumns({"upper": p * (1 + up * vol), "lower": p * (1 - down * vol)})
    rows = rows.withColumn("__u", first(lambda x: x >= F.col("upper"))).withColumn("__d", first(lambda x: x <= F.col("lower")))
    label = F.when((F.col("__u") > 0) & ((F.col("__d") == 0) | (F.col("__u") <= F.col("__d"))), 1).when(F.col("__d") > 0, -1).otherwise(0)
    rows = rows.withColumn("label", label)
    rows = rows.withColumn("touch", F.when(F.col("label") == 1, F.col("__u")).when(F.col("label") == -1, F.col("__d")).otherwise(F.size("__path")).cast("int"))
    return rows.withColumn("touch_return", ratio(F.element_at("__path", F.col("touch")), p) - 1).drop("__path", "__u", "__d")


def last_rows(df: DataFrame, s: Series, n: int) -> DataFrame:
    """The n latest rows of each series, newest first by place. Spark keeps n rows a task before the shuffle."""
    newest = Window.partitionBy(*s.key).orderBy(*[F.col(c).desc() for c in s.order])
    return df.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def relative_strength(df: DataFrame, at: str, momentum: str, mood: str, share: float = 0.6) -> DataFrame:
    """share x z score of momentum and the rest of mood among the assets of one moment, and the rank, best first."""
    w = Window.partitionBy(at)
    z = lambda c: ratio(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w), 0.0)
    rows = df.where(F.col(momentum).isNotNull() & F.col(mood).isNotNull()).withColumn("strength", share * z(momentum) + (1 - share) * z(mood))
    return rows.withColumn("rank", F.rank().over(w.orderBy(F.round("strength", 9).desc())))


def missing_keys(required: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    """Required keys without any row."""
    return required.select(*key).distinct().join(present.select(*key), list(key), "left_anti")


def group_rollup(df: DataFrame, groups: DataFrame, key: str, group: str, value: str, weight: str) -> DataFrame:
    """Members, weight and weighted mean of a value by group and over all, in one pass. groups: (key, group)."""
    rows = df.join(groups, key)
    total = F.sum(weight)
    out = rows.rollup(group).agg(F.count(F.lit(1)).alias("members"), total.alias("weight"), (F.sum(F.col(value) * F.col(weight)) / total).alias("mean"), F.grouping(group).alias("__all"))
    return out.withColumn(group, F.when(F.col("__all") == 1, "all").otherwise(F.col(group))).drop("__all")


def equity_report(df: DataFrame, s: Series, equity: str, periods: int = 252) -> DataFrame:
    """Total return, compound annual growth, volatility, deepest loss (negative) and growth over it."""
    rows = df.withColumn("__r", ratio(F.col(equity), lag(equity, s)) - 1).withColumn("__d", ratio(F.col(equity), F.max(equity).over(s.so_far())) - 1)
    at = F.struct(*s.order)
    out = rows.groupBy(*s.key).agg(
        F.min_by(equity, at).alias("first"), F.max_by(equity, at).alias("last"), F.count("__r").alias("n"), F.stddev_samp("__r").alias("__s"), F.min("__d").alias("max_drawdown")
    )
    growth = ratio(F.col("last"), F.col("first"))
    out = out.withColumn("total_return", growth - 1).withColumn("cagr", F.when((growth > 0) & (F.col("n") > 0), F.pow(growth, F.lit(float(periods)) / F.col("n")) - 1))
    out = out.withColumn("volatility", F.col("__s") * F.sqrt(F.lit(float(periods))))
    return out.withColumn("calmar", ratio(F.col("cagr"), F.abs("max_drawdown"))).drop("first", "last", "__s")


def rolling_correlation(df: DataFrame, s: Series, x: str, y: str, n: int) -> DataFrame:
    """Correlation over n rows of the pairs that are known, where at least half of them are."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return df.withColumn("corr", F.when(F.count(a).over(s.last(n)) >= max(2, n // 2), F.corr(a, b).over(s.last(n))))


def histogram(df: DataFrame, x: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows and share by bucket of fixed width."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, (F.floor(F.col(x) / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def two_factor_exposures(df: DataFrame, by: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    """Exposures and explained share of a regression on two factors, from sums of squares and products."""
    c = F.covar_samp
    known = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    out = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), c(a, a).alias("aa"), c(b, b).alias("bb"), c(a, b).alias("ab"), c(y, a).alias("ya"), c(y, b).alias("yb"), c(y, y).alias("yy"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb")
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    out = out.withColumn("beta_a", ratio(F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab"), det)).withColumn("beta_b", ratio(F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab"), det))
    explained = F.col("beta_a") * F.col("ya") + F.col("beta_b") * F.col("yb")
    return out.select(*by, "n", "beta_a", "beta_b", (F.col("my") - F.col("beta_a") * F.col("ma") - F.col("beta_b") * F.col("mb")).alias("alpha"), ratio(explained, F.col("yy")).alias("r2"))


def wide_matrix(df: DataFrame, row: str, column: str, names: Sequence[str], x: str) -> DataFrame:
    """One column for each of the given names. Naming them spares the pass that would look for them."""
    return df.groupBy(row).pivot(column, list(names)).agg(F.avg(x))


def long_table(df: DataFrame, row: str, names: Sequence[str], column: str, x: str) -> DataFrame:
    """The matrix as rows again, without its holes."""
    return df.unpivot([row], list(names), column, x).where(F.col(x).isNotNull())
