"""Trading costs, execution schedules, sizing, rebalancing and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.frames import Series, full, lag, ratio, rolling_mean, rolling_std
from quantspark.operators.blocks import numbered


def transaction_costs(orders: DataFrame, commission_bps: float = 1.0, impact: float = 0.1) -> DataFrame:
    """Commission, half spread and square-root impact in basis points and in value; unknown volatility has no impact.

    orders: order_size, avg_daily_volume, spread_bps, volatility.
    """
    part = ratio(F.abs("order_size"), F.col("avg_daily_volume"), 0.0)
    rows = orders.withColumn("participation", part)
    rows = rows.withColumn("impact_bps", F.coalesce(1e4 * impact * F.col("volatility") * F.sqrt("participation"), F.lit(0.0)))
    rows = rows.withColumn("total_bps", F.lit(commission_bps) + F.col("spread_bps") / 2 + F.col("impact_bps"))
    return rows.withColumn("cost", F.abs("order_size") * F.col("total_bps") / 1e4)


def execution_schedule(orders: DataFrame, key: str, size: str, slices: int, front: float = 1.0) -> DataFrame:
    """Each order as so many slices with shares proportional to front ** step; sizes add up to the order."""
    shares = [front**k for k in range(slices)]
    total = sum(shares)
    parts = F.array(*[F.struct(F.lit(k).alias("slice"), F.lit(x / total).alias("share")) for k, x in enumerate(shares)])
    return orders.select(key, size, F.explode(parts).alias("p")).select(key, "p.slice", "p.share", (F.col(size) * F.col("p.share")).alias("slice_size"))


def pyramid_levels(positions: DataFrame, key: str, price: str, size: str, levels: int = 3, step: float = 0.02, shrink: float = 0.5) -> DataFrame:
    """Add-on orders at rising prices and shrinking sizes, with the average entry after each."""
    k = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    rows = positions.select(key, F.col(price).alias("p"), F.col(size).alias("q"), k.alias("level"))
    rows = rows.select(key, "level", (F.col("p") * (1 + step * F.col("level"))).alias("level_price"), (F.col("q") * F.pow(F.lit(shrink), F.col("level"))).alias("level_size"))
    w = Window.partitionBy(key).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("average_entry", F.sum(F.col("level_price") * F.col("level_size")).over(w) / F.sum("level_size").over(w))


def target_volatility_size(df: DataFrame, s: Series, ret: str, n: int, target: float, most: float = 2.0) -> DataFrame:
    """Target over realised volatility of n rows, at most most; known before the row it is used for."""
    rows = df.withColumn("__v", rolling_std(F.col(ret), s, n))
    return rows.withColumn("size", F.least(F.lit(most), ratio(F.lit(target), lag("__v", s)))).withColumn("size", F.when(lag("__v", s).isNotNull(), F.col("size"))).drop("__v")


def kelly_fraction(win_rate: Column, payoff: Column, share: float = 0.5) -> Column:
    """A share of the growth-optimal bet, never negative."""
    return F.greatest(F.lit(0.0), share * (win_rate - ratio(1 - win_rate, payoff)))


def rebalance_trades(current: DataFrame, target: DataFrame, key: str, value: float, threshold: float = 0.0) -> DataFrame:
    """Trades that bring current weights to the targets, where the drift exceeds the threshold; largest first by rank."""
    rows = current.select(key, F.col("weight").alias("current")).join(target.select(key, F.col("weight").alias("target")), key, "full").fillna(0.0, ["current", "target"])
    rows = rows.withColumn("trade", (F.col("target") - F.col("current")) * value).where(F.abs(F.col("target") - F.col("current")) > threshold)
    rows = rows.withColumn("side", F.when(F.col("trade") > 0, "buy").otherwise("sell"))
    ranked = numbered(rows.withColumn("__size", -F.round(F.abs("trade"), 9)), ["__size", key], "__place")
    return ranked.withColumn("rank", (F.col("__place") + 1).cast("int")).drop("__size", "__place")


def turnover(weights: DataFrame, at: str, key: str) -> DataFrame:
    """Half the sum of absolute weight changes at each moment; keys that come or go count from or to zero.

    weights: (at, key, weight), all keys at each moment; a missing key at a later moment is a weight of zero.
    """
    moments = weights.select(at).distinct()
    ordered = moments.withColumn("__k", F.row_number().over(Window.orderBy(at)))  # one row per rebalancing date
    rows = weights.join(ordered, at).select("__k", key, "weight")
    after = rows.select((F.col("__k") + 1).alias("__k"), key, F.col("weight").alias("before"))
    both = rows.join(after, ["__k", key], "full").fillna(0.0, ["weight", "before"])
    sums = both.groupBy("__k").agg((F.sum(F.abs(F.col("weight") - F.col("before"))) / 2).alias("turnover"))
    return ordered.join(sums, "__k").where("__k > 1").select(at, "turnover")


def hedge_ratio(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope, intercept and correlation of y on x, the spread's mean and deviation."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("hedge"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("corr"))
    spread = df.join(fit, list(by)).withColumn("__s", F.col(y) - F.col("hedge") * F.col(x) - F.col("intercept"))
    return spread.groupBy(*by).agg(F.max("hedge").alias("hedge"), F.max("intercept").alias("intercept"), F.max("corr").alias("corr"), F.stddev_samp("__s").alias("spread_std"))


def pair_signal(df: DataFrame, s: Series, y: str, x: str, n: int, entry: float = 1.5) -> DataFrame:
    """z score of the spread by the rolling hedge ratio; -1 sells the spread, 1 buys it."""
    both = F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)
    slope = F.when(F.count(both).over(s.last(n)) == n, F.regr_slope(y, x).over(s.last(n)))
    rows = df.withColumn("hedge", slope).withColumn("spread", F.col(y) - F.col("hedge") * F.col(x))
    rows = rows.withColumn("zscore", ratio(F.col("spread") - rolling_mean(F.col("spread"), s, n), rolling_std(F.col("spread"), s, n), 0.0))
    return rows.withColumn("signal", F.when(F.col("zscore") > entry, -1).when(F.col("zscore") < -entry, 1).otherwise(0))


def signal_backtest(df: DataFrame, s: Series, signal: str, price: str, cost: float = 0.0005) -> DataFrame:
    """Equity of holding the last row's signal: position, net return and compounded equity."""
    rows = df.withColumn("position", F.coalesce(lag(signal, s), F.lit(0)).cast("double"))
    rows = rows.withColumn("__r", ratio(F.col(price), lag(price, s)) - 1)
    net = F.col("position") * F.coalesce("__r", F.lit(0.0)) - cost * F.abs(F.col("position") - F.coalesce(lag("position", s), F.lit(0.0)))
    rows = rows.withColumn("net", net).drop("__r")
    return rows.withColumn("equity", F.product(1 + F.col("net")).over(s.so_far()))


def signal_quality(df: DataFrame, by: Sequence[str], signal: str, outcome: str) -> DataFrame:
    """Hits, accuracy, precision and recall of directional signals, and the mean outcome in their direction."""
    s, o = F.col(signal), F.col(outcome)
    known = df.where(s.isNotNull() & o.isNotNull())
    up = F.sum(((s > 0) & (o > 0)).cast("long"))
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((s != 0).cast("long")).alias("signals"),
        ratio(F.sum(((s != 0) & (F.signum(s) == F.signum(o))).cast("double")), F.sum((s != 0).cast("double"))).alias("accuracy"),
        ratio(up.cast("double"), F.sum((s > 0).cast("double"))).alias("precision_up"),
        ratio(up.cast("double"), F.sum((o > 0).cast("double"))).alias("recall_up"),
        F.avg(F.when(s != 0, F.signum(s) * o)).alias("mean_edge"),
    )


def signal_decay(df: DataFrame, s: Series, signal: str, ret: str, horizons: Sequence[int]) -> DataFrame:
    """Correlation of the signal with the sum of the returns of the rows after it, over each horizon; rows with fewer
    known returns ahead are left out."""
    ahead = lambda h: F.when(F.count(ret).over(s.after(h)) == h, F.sum(ret).over(s.after(h)))
    sums = df.select(F.col(signal).cast("double").alias("__s"), *[ahead(h).alias(f"__h{h}") for h in horizons])
    rows = sums.select("__s", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"__h{h}").alias("r")) for h in horizons])).alias("x")).select("__s", "x.*")
    return rows.where(F.col("r").isNotNull() & F.col("__s").isNotNull()).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.corr("__s", "r").alias("ic"))


def confirmed_signal(df: DataFrame, s: Series, signal: str, rows_needed: int = 2) -> DataFrame:
    """The signal where it has held for so many rows, else 0."""
    frame = s.last(rows_needed)
    same = (F.min(signal).over(frame) == F.max(signal).over(frame)) & (F.count(signal).over(frame) == rows_needed)
    return df.withColumn("confirmed", F.when(same, F.col(signal)).otherwise(0))


def cooldown(df: DataFrame, s: Series, signal: str, n: int) -> DataFrame:
    """Signals with no other signal among the n rows before; others become 0."""
    recent = F.coalesce(F.sum((F.col(signal) != 0).cast("int")).over(s.past(n)), F.lit(0))
    return df.withColumn("cooled", F.when(recent == 0, F.col(signal)).otherwise(0))


def rolling_hit_rate(df: DataFrame, s: Series, signal: str, outcome: str, n: int) -> DataFrame:
    hit = F.when(F.col(signal).isNotNull() & F.col(outcome).isNotNull(), (F.signum(F.col(signal)) == F.signum(F.col(outcome))).cast("double"))
    rows = df.withColumn("__h", hit)
    return rows.withColumn("hit_rate", full(F.avg("__h").over(s.last(n)), F.col("__h"), s.last(n), n)).drop("__h")
