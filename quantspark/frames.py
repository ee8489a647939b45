"""Series windows: every operator names its key and a total order, and masks warm-up rows on purpose."""

from __future__ import annotations

import math
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """Which rows make one series, and their total order (time, then a tie breaker)."""

    key: tuple[str, ...] = ("asset",)
    order: tuple[str, ...] = ("ts", "tie")

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        """The current row and n - 1 before it."""
        return self.window().rowsBetween(-(n - 1), 0)

    def past(self, n: int) -> WindowSpec:
        """The n rows before the current one."""
        return self.window().rowsBetween(-n, -1)

    def so_far(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def after(self, n: int) -> WindowSpec:
        return self.window().rowsBetween(1, n)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.key)


TICKS = Series()


def full(value: Column, x: Column, window: WindowSpec, n: int) -> Column:
    """value where the frame holds n known values of x, else null."""
    return F.when(F.count(x).over(window) == n, value)


def rolling_mean(x: Column, s: Series, n: int) -> Column:
    return full(F.avg(x).over(s.last(n)), x, s.last(n), n)


def rolling_sum(x: Column, s: Series, n: int) -> Column:
    return full(F.sum(x).over(s.last(n)), x, s.last(n), n)


def rolling_std(x: Column, s: Series, n: int) -> Column:
    return full(F.stddev_samp(x).over(s.last(n)), x, s.last(n), n)


def rolling_min(x: Column, s: Series, n: int) -> Column:
    return full(F.min(x).over(s.last(n)), x, s.last(n), n)


def rolling_max(x: Column, s: Series, n: int) -> Column:
    return full(F.max(x).over(s.last(n)), x, s.last(n), n)


def rolling_quantile(x: Column, s: Series, n: int, q: float) -> Column:
    return full(F.percentile(x, F.lit(q)).over(s.last(n)), x, s.last(n), n)


def lag(x: str | Column, s: Series, n: int = 1) -> Column:
    return F.lag(x, n).over(s.window())


def ratio(top: Column, bottom: Column, neutral: float | None = None) -> Column:
    """top / bottom, and neutral where the bottom is zero."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(neutral).cast("double") if neutral is None else F.when(bottom.isNotNull(), F.lit(neutral)))


def quotient(top: Column, bottom: Column) -> Column:
    """top / bottom of doubles as IEEE 754 has it, which is SQL's own division in engines that raise no error: infinite, or
    NaN of zero by zero, where the bottom is zero."""
    endless = F.when((top == 0) | F.isnan(top), math.nan).when(top > 0, math.inf).when(top < 0, -math.inf)
    return F.when(bottom != 0, top / bottom).when(bottom == 0, endless)


def simple_return(price: str, s: Series, n: int = 1) -> Column:
    """price / earlier price - 1; null at the start and after a price of zero."""
    return ratio(F.col(price), lag(price, s, n)) - 1


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, with -0.0 as 0.0: both engines then give the same digits. Whole units of the last place are rounded,
    half away from zero, as DuckDB does: rounding the decimal digits would tell halves apart in another way."""
    unit = 10.0**places

    def near(c: str) -> Column:
        units = F.col(c) * unit
        return F.when(F.abs(units) < math.inf, F.round(units) / unit).otherwise(F.col(c)) + F.lit(0.0)

    return df.select(*[near(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def settled(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed where the cluster names a shared folder for that, else persisted."""
    reliable = df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") is not None
    return df.checkpoint() if reliable else df.persist()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that loops keep short plans. Where the session names no folder, as in tests,
    a local master gets a temporary one; on a cluster that is an error, because tasks would not see each other's files."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='quantspark-')}")
    return df.checkpoint()
