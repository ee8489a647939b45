"""Technical indicators and rule signals from built-in functions over one window specification per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, full, lag, ratio, rolling_max, rolling_mean, rolling_min, rolling_std, simple_return


def three_way(up: Column, down: Column) -> Column:
    """1, -1 or 0."""
    return F.when(up, 1).when(down, -1).otherwise(0)


def crossover_backtest(df: DataFrame, s: Series = TICKS, price: str = "price", fast: int = 3, slow: int = 8, cost: float = 0.001) -> DataFrame:
    """Per key: trades, days, pnl, mean over standard deviation of pnl. The position is the sign of fast minus slow
    average, held from the next row; a change of position pays cost for each unit."""
    rows = df.withColumn("ret", simple_return(price, s))
    gap = rolling_mean(F.col(price), s, fast) - rolling_mean(F.col(price), s, slow)
    rows = rows.withColumn("signal", F.coalesce(F.signum(gap), F.lit(0.0)))
    rows = rows.withColumn("position", F.coalesce(lag("signal", s), F.lit(0.0)))
    turn = F.abs(F.col("position") - F.coalesce(lag("position", s), F.lit(0.0)))
    rows = rows.withColumn("turn", turn).withColumn("pnl", F.col("position") * F.coalesce("ret", F.lit(0.0)) - F.lit(cost) * F.col("turn"))
    return rows.groupBy(*s.key).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum((F.col("turn") > 0).cast("long")).alias("trades"),
        F.sum("pnl").alias("total_pnl"),
        ratio(F.avg("pnl"), F.stddev_samp("pnl")).alias("sharpe"),
    )


def momentum(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 5, threshold: float = 0.1) -> DataFrame:
    change = simple_return(price, s, n)
    return df.withColumn("momentum", change).withColumn("signal", three_way(F.col("momentum") > threshold, F.col("momentum") < -threshold))


def rate_of_change(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 3) -> DataFrame:
    return df.withColumn("roc", simple_return(price, s, n) * 100)


def rsi_simple(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 14) -> DataFrame:
    """RSI of simple means; 50 where nothing moves, 100 where nothing falls."""
    rows = df.withColumn("__d", F.col(price) - lag(price, s))
    gain = rolling_mean(F.greatest(F.col("__d"), F.lit(0.0)), s, n)
    loss = rolling_mean(F.greatest(-F.col("__d"), F.lit(0.0)), s, n)
    known = F.count("__d").over(s.last(n)) == n
    rows = rows.withColumn("__g", F.when(known, gain)).withColumn("__l", F.when(known, loss))
    value = F.when((F.col("__g") == 0) & (F.col("__l") == 0), 50.0).when(F.col("__l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("__g") / F.when(F.col("__l") != 0, F.col("__l"))))
    return rows.withColumn("rsi", F.when(F.col("__g").isNotNull(), value)).drop("__d", "__g", "__l")


def bollinger(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 10, width: float = 2.0) -> DataFrame:
    """Bands, width over the middle, and place within the bands (0.5 in bands without width)."""
    middle, spread = rolling_mean(F.col(price), s, n), rolling_std(F.col(price), s, n)
    rows = df.withColumn("middle", middle).withColumn("__s", spread)
    rows = rows.withColumn("upper", F.col("middle") + width * F.col("__s")).withColumn("lower", F.col("middle") - width * F.col("__s"))
    rows = rows.withColumn("bandwidth", ratio(F.col("upper") - F.col("lower"), F.col("middle"), 0.0))
    return rows.withColumn("percent_b", ratio(F.col(price) - F.col("lower"), F.col("upper") - F.col("lower"), 0.5)).drop("__s")


def bollinger_place_signal(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 10, low: float = 0.05, high: float = 0.95) -> DataFrame:
    rows = bollinger(df, s, price, n)
    return rows.withColumn("signal", three_way(F.col("percent_b") < low, F.col("percent_b") > high))


def bollinger_touch_signal(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 10) -> DataFrame:
    rows = bollinger(df, s, price, n)
    return rows.withColumn("signal", three_way(F.col(price) <= F.col("lower"), F.col(price) >= F.col("upper")))


def stochastic(df: DataFrame, s: Series = TICKS, n: int = 5, smooth: int = 3, low: float = 20.0, high: float = 80.0) -> DataFrame:
    """%K, its mean %D, and a signal where %K crosses %D outside the middle zone."""
    floor, top = rolling_min(F.col("low"), s, n), rolling_max(F.col("high"), s, n)
    rows = df.withColumn("k", ratio(100 * (F.col("close") - floor), top - floor, 50.0))
    rows = rows.withColumn("d", rolling_mean(F.col("k"), s, smooth))
    rows = rows.withColumn("__gap", F.col("k") - F.col("d"))
    before = lag("__gap", s)
    up = (F.col("__gap") > 0) & (before <= 0) & (F.col("k") < low)
    down = (F.col("__gap") < 0) & (before >= 0) & (F.col("k") > high)
    return rows.withColumn("signal", three_way(up, down)).drop("__gap")


def donchian_breakout(df: DataFrame, s: Series = TICKS, n: int = 5) -> DataFrame:
    """Close beyond the highest high or the lowest low of the n bars before."""
    rows = df.withColumn("__h", rolling_max(F.col("high"), s, n)).withColumn("__l", rolling_min(F.col("low"), s, n))
    rows = rows.withColumn("channel_high", lag("__h", s)).withColumn("channel_low", lag("__l", s)).drop("__h", "__l")
    return rows.withColumn("signal", three_way(F.col("close") > F.col("channel_high"), F.col("close") < F.col("channel_low")))


def williams_r(df: DataFrame, s: Series = TICKS, n: int = 5) -> DataFrame:
    floor, top = rolling_min(F.col("low"), s, n), rolling_max(F.col("high"), s, n)
    return df.withColumn("williams_r", ratio(-100 * (top - F.col("close")), top - floor, -50.0))


def cci(df: DataFrame, s: Series = TICKS, n: int = 5, scale: float = 0.015) -> DataFrame:
    """Typical price less its mean over scale times its standard deviation."""
    rows = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return rows.withColumn("cci", ratio(F.col("__tp") - rolling_mean(F.col("__tp"), s, n), scale * rolling_std(F.col("__tp"), s, n), 0.0)).drop("__tp")


def on_balance_volume(df: DataFrame, s: Series = TICKS) -> DataFrame:
    rows = df.withColumn("__v", F.coalesce(F.signum(F.col("close") - lag("close", s)), F.lit(0.0)) * F.col("volume"))
    return rows.withColumn("obv", F.sum("__v").over(s.so_far())).drop("__v")


def running_vwap(df: DataFrame, s: Series = TICKS) -> DataFrame:
    """Volume-weighted typical price since the start of the series."""
    rows = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    top, bottom = F.sum(F.col("__tp") * F.col("volume")).over(s.so_far()), F.sum("volume").over(s.so_far())
    return rows.withColumn("vwap", ratio(top, bottom)).drop("__tp")


def money_flow_index(df: DataFrame, s: Series = TICKS, n: int = 5) -> DataFrame:
    rows = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    rows = rows.withColumn("__up", F.col("__tp") - lag("__tp", s)).withColumn("__flow", F.col("__tp") * F.col("volume"))
    up = full(F.sum(F.when(F.col("__up") > 0, F.col("__flow")).otherwise(0.0)).over(s.last(n)), F.col("__up"), s.last(n), n)
    down = full(F.sum(F.when(F.col("__up") < 0, F.col("__flow")).otherwise(0.0)).over(s.last(n)), F.col("__up"), s.last(n), n)
    rows = rows.withColumn("__a", up).withColumn("__b", down)
    return rows.withColumn("mfi", ratio(100 * F.col("__a"), F.col("__a") + F.col("__b"), 50.0)).drop("__tp", "__up", "__flow", "__a", "__b")


def keltner_simple(df: DataFrame, s: Series = TICKS, n: int = 5, width: float = 1.5) -> DataFrame:
    """Mean close plus and minus width times the mean true range."""
    before = lag("close", s)
    rows = df.withColumn("__tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    middle, spread = rolling_mean(F.col("close"), s, n), rolling_mean(F.col("__tr"), s, n)
    return rows.withColumn("middle", middle).withColumn("upper", middle + width * spread).withColumn("lower", middle - width * spread).drop("__tr")


def volatility_filter(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 5, long: int = 20, most: float = 1.5) -> DataFrame:
    """True where the short volatility of returns is at most most times its own long mean."""
    rows = df.withColumn("__r", simple_return(price, s))
    rows = rows.withColumn("vol", rolling_std(F.col("__r"), s, n))
    rows = rows.withColumn("vol_mean", rolling_mean(F.col("vol"), s, long))
    return rows.withColumn("calm", F.coalesce(F.col("vol") <= most * F.col("vol_mean"), F.lit(False))).drop("__r")


def composite_signal(df: DataFrame, s: Series = TICKS, price: str = "price", weights: tuple[float, float, float] = (0.5, 0.3, 0.2), threshold: float = 0.3) -> DataFrame:
    """Weighted sum of momentum, crossover and band-place signals, cut at the threshold."""
    rows = bollinger(df, s, price, 10)
    change = simple_return(price, s, 5)
    gap = rolling_mean(F.col(price), s, 3) - rolling_mean(F.col(price), s, 8)
    parts = (F.coalesce(F.signum(change), F.lit(0.0)), F.coalesce(F.signum(gap), F.lit(0.0)), three_way(F.col("percent_b") < 0.2, F.col("percent_b") > 0.8).cast("double"))
    rows = rows.withColumn("score", weights[0] * parts[0] + weights[1] * parts[1] + weights[2] * parts[2])
    return rows.withColumn("signal", three_way(F.col("score") > threshold, F.col("score") < -threshold)).drop("middle", "upper", "lower", "bandwidth", "percent_b")


def trailing_stop(df: DataFrame, s: Series = TICKS, price: str = "price", fraction: float = 0.1) -> DataFrame:
    """A long stop that only rises, and whether the price is at or below the stop of the row before."""
    rows = df.withColumn("stop", F.max(F.col(price) * (1 - fraction)).over(s.so_far()))
    return rows.withColumn("hit", F.coalesce(F.col(price) <= lag("stop", s), F.lit(False)))


def trailing_stop_atr(df: DataFrame, s: Series = TICKS, price: str = "close", atr: str = "atr", width: float = 2.0, long: bool = True) -> DataFrame:
    """The ratchet at width times the range: highest of price - width * atr, or lowest of price + width * atr."""
    level = F.max(F.col(price) - width * F.col(atr)) if long else F.min(F.col(price) + width * F.col(atr))
    return df.withColumn("stop", level.over(s.so_far()))


def divergence(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 10, rsi: int = 5) -> DataFrame:
    """1 where price makes a new low of n rows and RSI does not, -1 for highs."""
    rows = rsi_simple(df, s, price, rsi)
    rows = rows.withColumn("__pl", rolling_min(F.col(price), s, n)).withColumn("__ph", rolling_max(F.col(price), s, n))
    rows = rows.withColumn("__rl", rolling_min(F.col("rsi"), s, n)).withColumn("__rh", rolling_max(F.col("rsi"), s, n))
    low = (F.col(price) <= F.col("__pl")) & (F.col("rsi") > F.col("__rl"))
    high = (F.col(price) >= F.col("__ph")) & (F.col("rsi") < F.col("__rh"))
    return rows.withColumn("divergence", three_way(low, high)).drop("__pl", "__ph", "__rl", "__rh")


def mean_reversion(df: DataFrame, s: Series = TICKS, price: str = "price", n: int = 10, entry: float = 1.0) -> DataFrame:
    rows = df.withColumn("zscore", ratio(F.col(price) - rolling_mean(F.col(price), s, n), rolling_std(F.col(price), s, n), 0.0))
    return rows.withColumn("signal", three_way(F.col("zscore") < -entry, F.col("zscore") > entry))


def pivot_points(df: DataFrame, s: Series = TICKS) -> DataFrame:
    """Classic support and resistance from the bar before."""
    h, low, c = lag("high", s), lag("low", s), lag("close", s)
    rows = df.withColumn("pivot", (h + low + c) / 3)
    return rows.withColumn("r1", 2 * F.col("pivot") - low).withColumn("s1", 2 * F.col("pivot") - h).withColumn("r2", F.col("pivot") + h - low).withColumn("s2", F.col("pivot") - h + low)
