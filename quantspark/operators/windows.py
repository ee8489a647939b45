"""Rolling, expanding, lagged and cross-sectional features, fills, and splits in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, full, lag, quotient, ratio, rolling_max, rolling_mean, rolling_min, rolling_quantile, rolling_std


def rolling_stats(df: DataFrame, s: Series = TICKS, x: str = "price", n: int = 7) -> DataFrame:
    """Mean, std, min, max, median, skewness and kurtosis of the n rows; null until n rows are known.

    Kurtosis is the mean fourth power of each row's distance to its own rolling mean, over the row's deviation, less 3,
    and 0 until it is known.
    """
    c, frame = F.col(x), s.last(n)
    df = df.withColumn("__q", F.pow(c - rolling_mean(c, s, n), 4))
    deviation = rolling_std(c, s, n)
    return df.withColumns(
        {
            "roll_mean": rolling_mean(c, s, n),
            "roll_std": rolling_std(c, s, n),
            "roll_min": rolling_min(c, s, n),
            "roll_max": rolling_max(c, s, n),
            "roll_median": rolling_quantile(c, s, n, 0.5),
            "roll_skew": full(F.skewness(c).over(frame), c, frame, n),
            "roll_kurt": F.coalesce(ratio(rolling_mean(F.col("__q"), s, n), F.pow(deviation, 4)) - 3, F.lit(0.0)),
        }
    ).drop("__q")


def expanding_stats(df: DataFrame, s: Series = TICKS, x: str = "price", least: int = 5) -> DataFrame:
    known = F.count(x).over(s.so_far()) >= least
    return df.withColumns(
        {name: F.when(known, f(x).over(s.so_far())) for name, f in (("exp_mean", F.avg), ("exp_std", F.stddev_samp), ("exp_min", F.min), ("exp_max", F.max))}
    )


def lag_features(df: DataFrame, s: Series = TICKS, x: str = "price", lags: Sequence[int] = (1, 2, 5)) -> DataFrame:
    """Earlier values, differences to them and relative changes; those from zero are infinite or NaN."""
    out = {}
    for n in lags:
        out[f"lag_{n}"] = lag(x, s, n)
        out[f"diff_{n}"] = F.col(x) - lag(x, s, n)
        out[f"change_{n}"] = quotient(F.col(x), lag(x, s, n)) - 1
    return df.withColumns(out)


def rolling_zscore(df: DataFrame, s: Series = TICKS, x: str = "price", n: int = 10) -> DataFrame:
    return df.withColumn("zscore", ratio(F.col(x) - rolling_mean(F.col(x), s, n), rolling_std(F.col(x), s, n), 0.0))


def cross_rank(df: DataFrame, at: str, x: str) -> DataFrame:
    """Average rank of x among the rows of one moment, scaled to [-1, 1]; a lone row has 0."""
    w = Window.partitionBy(at)
    order = w.orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(at, x))
    rank = F.rank().over(order) + (ties - 1) / 2
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("cross_rank", F.when(n > 1, 2 * (rank - 1) / F.when(n > 1, n - 1) - 1).otherwise(0.0))


def quantile_buckets(df: DataFrame, by: Sequence[str], x: str, tie: Sequence[str], n: int = 5) -> DataFrame:
    return df.withColumn("bucket", F.ntile(n).over(Window.partitionBy(*by).orderBy(x, *tie)))


def fill_both_ways(df: DataFrame, s: Series, x: str) -> DataFrame:
    """The last known value, or the next one at the start."""
    onward = s.window().rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(x, F.coalesce(F.last(x, True).over(s.so_far()), F.first(x, True).over(onward)))


def interpolate(df: DataFrame, s: Series, x: str, most: int | None = None) -> DataFrame:
    """Linear by row position between known neighbours; gaps longer than most stay, and so do open ends."""
    place = F.row_number().over(s.window())
    onward = s.window().rowsBetween(0, Window.unboundedFollowing)
    rows = df.withColumn("__p", place).withColumn("__k", F.when(F.col(x).isNotNull(), F.struct(F.col("__p").alias("p"), F.col(x).alias("v"))))
    rows = rows.withColumn("__a", F.last("__k", True).over(s.so_far())).withColumn("__b", F.first("__k", True).over(onward))
    gap = F.col("__b.p") - F.col("__a.p")
    value = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("__p") - F.col("__a.p")) / F.when(gap > 0, gap)
    inside = F.lit(True) if most is None else gap - 1 <= most
    return rows.withColumn(x, F.coalesce(F.col(x), F.when(inside, value))).drop("__p", "__k", "__a", "__b")


def time_split(df: DataFrame, s: Series, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Each series cut in order into train, valid and test."""
    place = (F.row_number().over(s.window()) - 1) / F.count(F.lit(1)).over(s.whole())
    return df.withColumn("part", F.when(place < train, "train").when(place < train + valid, "valid").otherwise("test"))


def walk_forward_folds(df: DataFrame, s: Series, train: int, test: int, step: int) -> DataFrame:
    """Rows with every fold they belong to and whether they train or test there; incomplete folds are left out."""
    place = F.row_number().over(s.window()) - 1
    total = F.count(F.lit(1)).over(s.whole())
    rows = df.withColumn("__p", place).withColumn("__folds", F.floor((total - train - test) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("__p") - (train + test) + 1) / step))
    last = F.least(F.col("__folds"), F.floor(F.col("__p") / step))
    rows = rows.where(first <= last).withColumn("fold", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return rows.withColumn("role", F.when(F.col("__p") < F.col("fold") * step + train, "train").otherwise("test")).drop("__p", "__folds")


def embargo(df: DataFrame, events: DataFrame, s: Series, ts: str = "ts", hours: int = 2) -> DataFrame:
    """Rows without an event of their key less than so many hours before them or at the same time.

    Each side is cut into periods of the embargo's length, so that the range condition becomes an equality on
    the period or its predecessor.
    """
    span = hours * 3600
    keyed = [F.col(k) for k in s.key]
    marks = events.select(*keyed, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")).withColumn("__period", F.explode(F.array(F.floor(F.col("__at") / (span * 1_000_000)), F.floor(F.col("__at") / (span * 1_000_000)) + 1)))
    rows = df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__period", F.floor(F.col("__us") / (span * 1_000_000)))
    near = [rows[k].eqNullSafe(marks[k]) for k in s.key]
    on = near + [rows["__period"] == marks["__period"], marks["__at"] <= rows["__us"], rows["__us"] - marks["__at"] < span * 1_000_000]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return rows.join(marks, condition, "left_anti").drop("__us", "__period")


def forward_return(df: DataFrame, s: Series, price: str = "price", n: int = 3) -> DataFrame:
    """Return from the row to n rows later, for judging signals; never a feature. From zero it is infinite or NaN."""
    return df.withColumn("forward", quotient(F.lead(price, n).over(s.window()), F.col(price)) - 1)


def fractional_difference(df: DataFrame, s: Series, x: str, d: float = 0.4, n: int = 6) -> DataFrame:
    """Fixed-width fractional difference: weights 1, then each the one before times (k - 1 - d) / k."""
    weight, total = 1.0, F.col(x)
    for k in range(1, n):
        weight *= (k - 1 - d) / k
        total = total + F.lit(weight) * lag(x, s, k)
    return df.withColumn("frac_diff", total)
