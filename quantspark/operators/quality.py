"""Cleaning, scaling, deduplication and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.frames import Series, lag, ratio
from quantspark.operators import quantiles


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last by order."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(base: DataFrame, change: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of change over those of base with the same key."""
    return change.unionByName(base.join(change.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)


def iqr_bounds(df: DataFrame, x: str, by: Sequence[str] = (), width: float = 1.5) -> DataFrame:
    q = quantiles.exact(df, x, {"q1": 0.25, "q3": 0.75}, by)
    return q.withColumn("low", F.col("q1") - width * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + width * (F.col("q3") - F.col("q1")))


def _beside(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics beside every row: one row of them without a key, else by key."""
    return df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))


def drop_iqr_outliers(df: DataFrame, x: str, by: Sequence[str] = (), width: float = 1.5) -> DataFrame:
    rows = _beside(df, iqr_bounds(df, x, by, width).select(*by, "low", "high"), by)
    return rows.where(F.col(x).between(F.col("low"), F.col("high"))).drop("low", "high")


def drop_zscore_outliers(df: DataFrame, x: str, by: Sequence[str] = (), most: float = 3.0) -> DataFrame:
    stats = df.groupBy(*by).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    rows = _beside(df, stats, by)
    return rows.where(F.coalesce(F.abs(F.col(x) - F.col("__m")) <= most * F.col("__s"), F.lit(True))).drop("__m", "__s")


def winsorize(df: DataFrame, x: str, by: Sequence[str] = (), low: float = 0.05, high: float = 0.95) -> DataFrame:
    stats = quantiles.exact(df, x, {"__l": low, "__h": high}, by)
    rows = _beside(df, stats, by)
    return rows.withColumn(x, F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("__l")), F.col("__h")))).drop("__l", "__h")


def scaled(df: DataFrame, x: str, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """standard: by mean and std; minmax: to [0, 1]; robust: by median and quartile range. 0 where nothing varies."""
    c = F.col(x)
    if kind == "robust":
        q = quantiles.exact(df, x, {"__l": 0.25, "__c": 0.5, "__h": 0.75}, by)
        stats = q.select(*by, "__c", (F.col("__h") - F.col("__l")).alias("__w"))
    else:
        centre, width = {"standard": (F.avg(c), F.stddev_samp(c)), "minmax": (F.min(c), F.max(c) - F.min(c))}[kind]
        stats = df.groupBy(*by).agg(centre.alias("__c"), width.alias("__w"))
    rows = _beside(df, stats, by)
    return rows.withColumn(f"{x}_{kind}", ratio(c - F.col("__c"), F.col("__w"), 0.0)).drop("__c", "__w")


def bar_quality(df: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Counters of one pass: rows, missing values, impossible bars, idle bars, extreme ranges."""
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    counts: dict[str, Column] = {
        "n_rows": F.count(F.lit(1)),
        "n_null_close": F.count_if(F.col("close").isNull()),
        "n_bad_range": F.count_if(bad),
        "n_not_positive": F.count_if(F.least("open", "high", "low", "close") <= 0),
        "n_no_volume": F.count_if(F.col("volume") == 0),
        "n_wide": F.count_if(F.col("high") > 50 * F.col("low")),
    }
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in counts.items()])


def day_gaps(df: DataFrame, s: Series, day: str = "ts", weekends: bool = False) -> DataFrame:
    """Missing days between neighbours: gap_start, gap_end, missing. Without weekends, a gap that only they fill is none."""
    rows = df.withColumn("__before", lag(day, s)).where(F.datediff(day, "__before") > 1)
    days = F.sequence(F.date_add("__before", 1), F.date_sub(F.col(day), 1))
    if not weekends:
        days = F.filter(days, lambda d: F.weekday(d) < 5)
    return rows.withColumn("missing", F.size(days)).where("missing > 0").select(*s.key, F.date_add("__before", 1).alias("gap_start"), F.date_sub(F.col(day), 1).alias("gap_end"), "missing")


def null_report(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls, share of nulls, distinct values; one pass over the table."""
    total = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k_{c}") for c in df.columns], *[F.countDistinct(c).alias(f"d_{c}") for c in df.columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"k_{c}")).alias("n_nulls"), F.col(f"d_{c}").alias("n_distinct")) for c in df.columns])
    rows = total.select(F.explode(each).alias("x")).select("x.*")
    return rows.withColumn("null_share", ratio(F.col("n_nulls").cast("double"), F.col("n_rows").cast("double"), 0.0))


def stale_runs(df: DataFrame, s: Series, x: str, least: int = 2) -> DataFrame:
    """Runs of at least so many equal values: first, last, length."""
    change = F.coalesce((F.col(x) != lag(x, s)).cast("int"), F.lit(1))
    rows = df.withColumn("__c", change).withColumn("__run", F.sum("__c").over(s.so_far()))
    runs = rows.groupBy(*s.key, "__run").agg(F.min(s.order[0]).alias("first"), F.max(s.order[0]).alias("last"), F.count(F.lit(1)).alias("length"), F.max(x).alias("value"))
    return runs.where(F.col("length") >= least).drop("__run")
