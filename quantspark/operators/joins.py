"""As-of, outer, pair and attribution joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark import pieces
from quantspark.frames import Series, ratio, settled
from quantspark.pieces import beside, dealt

#: Rows from which a value is broadcast with its rank.
COMMON = 10_000


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], tie: Sequence[str] = (), prefix: str = "asof_") -> DataFrame:
    """left with the latest values of right at or before its time, within the key.

    Both sides go through one window: one shuffle by the key, nothing multiplies. Rows of right at the same moment
    count, the last by tie winning.
    """
    picked = F.struct(*[F.col(v) for v in values])
    marks = right.select(*by, ts, *tie, picked.alias("__v"), F.lit(0).alias("__side"))
    sides = left.select("*", F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__side"))
    both = sides.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(ts, "__side", *tie).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__v", True).over(w)).where("__side = 1")
    return out.select(*left.columns, *[F.col(f"__last.{v}").alias(f"{prefix}{v}") for v in values])


def weight_drift(current: DataFrame, target: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """Every key of either side with both weights (0 where missing), drift, and drift relative to the target."""
    c = current.select(key, F.col(weight).alias("current"))
    t = target.select(key, F.col(weight).alias("target"))
    rows = c.join(t, key, "full").fillna(0.0, ["current", "target"])
    rows = rows.withColumn("drift", F.col("current") - F.col("target"))
    return rows.withColumn("relative_drift", ratio(F.abs("drift"), F.col("target")))


def brinson(portfolio: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """Allocation, selection and interaction by sector from (key, weight, ret) of both sides."""
    p = portfolio.select(key, F.col("weight").alias("wp"), F.col("ret").alias("rp"))
    b = benchmark.select(key, F.col("weight").alias("wb"), F.col("ret").alias("rb"))
    rows = p.join(b, key, "full").fillna(0.0)
    total = rows.agg(F.sum(F.col("wb") * F.col("rb")).alias("total"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    return rows.select(
        key,
        ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("total"))).alias("allocation"),
        (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"),
        ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"),
    )


def pair_correlation(df: DataFrame, asset: str, at: str, x: str, least: int = 3) -> DataFrame:
    """Pearson correlation, beta and covariance of every two assets over the moments that both have.

    The join is on the moment, so a moment costs its assets squared: the result of that size is asked for.
    """
    a = df.select(F.col(at).alias("at"), F.col(asset).alias("a"), F.col(x).alias("x"))
    b = df.select(F.col(at).alias("at"), F.col(asset).alias("b"), F.col(x).alias("y"))
    pairs = a.join(b, "at").where("a < b").groupBy("a", "b")
    out = pairs.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov"), F.regr_slope("y", "x").alias("beta"))
    return out.where(F.col("n") >= least)


def average_rank(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return df.withColumn(out, F.rank().over(w.orderBy(x)) + (ties - 1) / 2)


def _value_rank(df: DataFrame, rows: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """rows with what average_rank gives them among those of df, for keys of any number of rows. Values are counted, the
    counts added up in pieces, and rows take the rank of their value; values of very many rows are broadcast."""
    counts = dealt(settled(df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("__n"))), Series(tuple(by), (x,))).total("__e", "__n").rows
    ranks = counts.select(*by, x, "__n", (F.col("__e") - (F.col("__n") - 1) / 2).alias("__rank"))
    often = F.col("__n") > COMMON
    rows = beside(rows, ranks.where(often).select(*by, x, F.col("__rank").alias("__often")), [*by, x])
    # Rows that have their rank are spread by a number that no other value goes by.
    rows = rows.withColumn("__salt", F.when(F.col("__often").isNotNull(), F.monotonically_increasing_id() % 1024 + 1).otherwise(F.lit(0)))
    rest = ranks.where(~often).select(*[F.col(c).alias(f"{c}__r") for c in (*by, x)], F.lit(0).cast("long").alias("__salt__r"), "__rank")
    match = F.lit(True)
    for c in (*by, x, "__salt"):
        match = match & F.col(c).eqNullSafe(F.col(f"{c}__r"))
    return rows.join(rest, match, "left").withColumn(out, F.coalesce("__often", "__rank")).drop("__often", "__rank", "__salt", *[f"{c}__r" for c in (*by, x, "__salt")])


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation of two columns within each key, over rows where both are known. Keys of many rows are ranked by
    counts of values, the others by windows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if rows.groupBy(*by).count().where(F.col("count") > pieces.PIECE).isEmpty():
        rows = average_rank(average_rank(rows, by, x, "__rx"), by, y, "__ry")
    else:
        rows = rows.select(*by, x, y)
        rows = _value_rank(rows, _value_rank(rows, rows, by, x, "__rx"), by, y, "__ry")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("__rx", "__ry").alias("spearman"))


def lead_lag(df: DataFrame, s: Series, x: str, y: str, lags: Sequence[int]) -> DataFrame:
    """Correlation of x with y so many rows later, for each lag."""
    leads = df.select(*s.key, F.col(x).alias("__x"), *[F.lead(y, k).over(s.window()).alias(f"__y{k}") for k in lags])
    rows = leads.select(*s.key, "__x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__y{k}").alias("y")) for k in lags])).alias("__l"))
    rows = rows.select(*s.key, "__x", "__l.lag", "__l.y").where(F.col("__x").isNotNull() & F.col("y").isNotNull())
    return rows.groupBy(*s.key, "lag").agg(F.count(F.lit(1)).alias("n"), F.corr("__x", "y").alias("corr"))


def rolling_beta(df: DataFrame, s: Series, x: str, market: str, n: int) -> DataFrame:
    """Slope, intercept and correlation of x on the market over n rows in which both are known."""
    both = F.when(F.col(x).isNotNull() & F.col(market).isNotNull(), 1)
    known = F.count(both).over(s.last(n)) == n
    f = lambda g: F.when(known, g(F.col(x), F.col(market)).over(s.last(n)))
    return df.withColumns({"beta": f(F.regr_slope), "alpha": f(F.regr_intercept), "corr": f(F.corr)})


def benchmark_report(df: DataFrame, by: Sequence[str], x: str, market: str) -> DataFrame:
    """Beta, alpha, correlation, tracking error, information ratio, up and down capture."""
    a, m = F.col(x), F.col(market)
    rows = df.where(a.isNotNull() & m.isNotNull())
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(a, m).alias("beta"),
        F.regr_intercept(a, m).alias("alpha"),
        F.corr(a, m).alias("corr"),
        F.stddev_samp(a - m).alias("tracking_error"),
        ratio(F.avg(a - m), F.stddev_samp(a - m), 0.0).alias("information_ratio"),
        ratio(F.avg(F.when(m > 0, a)), F.avg(F.when(m > 0, m))).alias("up_capture"),
        ratio(F.avg(F.when(m < 0, a)), F.avg(F.when(m < 0, m))).alias("down_capture"),
    )


def event_window(df: DataFrame, events: DataFrame, s: Series, x: str, before: int, after: int) -> DataFrame:
    """Rows around each event with their offset in rows: both sides are numbered, the join is on key and position."""
    place = df.withColumn("__p", F.row_number().over(s.window()))
    at = place.join(events.select(*s.key, *s.order).distinct(), [*s.key, *s.order], "left_semi").select(*s.key, F.col("__p").alias("__e"))
    near = at.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("__p", F.col("__e") + F.col("offset"))
    return near.join(place.select(*s.key, "__p", F.col(x).alias("x")), [*s.key, "__p"]).groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
