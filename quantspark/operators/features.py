"""Row features, time features, array sets, re-indexing, trailing time windows, orders and samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.frames import TICKS, Series
from quantspark.operators import quantiles


def row_stats(columns: Sequence[str]) -> dict[str, Column]:
    """Mean and sample deviation over the known values of several columns of a row; null without enough of them."""
    known = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    n = F.size(known)
    mean = F.when(n > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n))
    square = F.aggregate(F.transform(known, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return {"row_mean": mean, "row_std": F.when(n > 1, F.sqrt(square / F.when(n > 1, n - 1)))}


def finite_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, nulls, NaN, infinite and finite values; one pass."""
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    inf = lambda c: F.abs(F.col(c)) == float("inf")
    sums = [x for c in columns for x in (count(F.col(c).isNull()).alias(f"u_{c}"), count(F.isnan(c)).alias(f"x_{c}"), count(inf(c) & F.col(c).isNotNull()).alias(f"i_{c}"))]
    total = df.agg(F.count(F.lit(1)).alias("n"), *sums)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"u_{c}").alias("n_null"), F.col(f"x_{c}").alias("n_nan"), F.col(f"i_{c}").alias("n_infinite")) for c in columns])
    rows = total.select(F.explode(each).alias("x")).select("x.*")
    return rows.withColumn("n_finite", F.col("n_rows") - F.col("n_null") - F.col("n_nan") - F.col("n_infinite"))


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column is_<value> for each of the given values; null and other values have 0 in all."""
    return df.withColumns({f"is_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def utc_time(text: Column, pattern: str, zone: str) -> Column:
    """Local time of a zone, parsed, in UTC; null where the text does not fit the pattern."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone)


def seconds_since(df: DataFrame, event: Column, s: Series = TICKS, ts: str = "ts", name: str = "since") -> DataFrame:
    """Seconds since the last row of the series at which the event was true; null before the first."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    last = F.last(F.when(event, at), True).over(s.so_far())
    return df.withColumn(name, (at - last) / 1e6)


def decay_weight(hours: Column, half_life: float) -> Column:
    """Halves with every half-life."""
    return F.exp(-math.log(2) / half_life * hours)


def array_sets(a: Column, b: Column) -> dict[str, Column]:
    """Sizes of intersection, union and differences of two arrays as sets, and their Jaccard similarity (1 if both are empty)."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return {"both": both, "any": any_, "only_a": F.size(F.array_except(a, b)), "only_b": F.size(F.array_except(b, a)), "jaccard": F.when(any_ > 0, both / F.when(any_ > 0, any_)).otherwise(1.0)}


def reindex_days(df: DataFrame, key: Sequence[str], day: str, columns: Sequence[str]) -> DataFrame:
    """One row for every day from the first to the last of each key; missing days carry the last known values."""
    span = df.groupBy(*key).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    spine = span.select(*key, F.explode(F.sequence("__a", "__b")).alias(day))
    w = Window.partitionBy(*key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(df.select(*key, day, *columns), [*key, day], "left").withColumns({c: F.last(c, True).over(w) for c in columns})


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by name: inner, left, right, full, left_semi or left_anti. Cross joins are refused."""
    kinds = ("inner", "left", "right", "full", "left_semi", "left_anti")
    if how not in kinds:
        raise ValueError(f"how must be one of {', '.join(kinds)}")
    return left.join(right, list(on), how)


def trailing(df: DataFrame, s: Series, seconds: int, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows in the trailing seconds (the current moment included) and mean and sum of columns over them."""
    frame = Window.partitionBy(*s.key).orderBy("__us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    out = {"n_trailing": F.count(F.lit(1)).over(frame)}
    for c in columns:
        out |= {f"{c}_mean": F.avg(c).over(frame), f"{c}_sum": F.sum(c).over(frame)}
    return df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumns(out).drop("__us")


def stuffing(df: DataFrame, s: Series, seconds: int, most: int, ts: str = "ts") -> DataFrame:
    """True where more than so many updates fall into the trailing seconds."""
    return trailing(df, s, seconds, (), ts).withColumn("stuffing", F.col("n_trailing") > most)


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df in a global order by several keys or expressions: a range partitioning and a sort of each part."""
    return df.orderBy(*keys)


def drawn(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """n rows in the order of a hash of the key: a shuffle that any run repeats."""
    return df.orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key).limit(n)


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have."""
    return a.intersect(b)


def quantile_edges(df: DataFrame, x: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """bucket from 0: the interval between neighbouring quantiles that holds x, upper ends included. Equal quantiles
    make one edge, so there may be fewer buckets. The edges come from one list of quantiles for each key."""
    places = {f"__q{k}": k / n for k in range(n + 1)}
    edges = quantiles.exact(df, x, places, by).select(*by, F.array_distinct(F.array(*places)).alias("__e"))
    rows = df.join(edges, list(by)) if by else df.crossJoin(F.broadcast(edges))  # one row
    inner = F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0)))
    return rows.withColumn("bucket", F.when(F.col(x).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(x))))).drop("__e")


def parsed_events(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, lines that are none) from JSON text; both work on batch and streaming frames."""
    kinds = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_bad", T.StringType())])
    rows = lines.withColumn("__e", F.from_json(column, kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("__e").isNull() | F.col("__e._bad").isNotNull()
    return rows.where(~bad).select("__e.*").drop("_bad"), rows.where(bad).select(column)


def merged_by_date(base: DataFrame, change: DataFrame, key: Sequence[str], date: str, keep: str = "last") -> DataFrame:
    """All rows of both, one for each key: that of the latest date, or of the earliest. At equal dates base wins."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    rows = base.withColumn("__new", F.lit(0)).unionByName(change.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.col(date).desc() if keep == "last" else F.col(date).asc(), "__new")
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__new")


def map_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over chunks of rows in Arrow batches; chunks never leave their partition."""
    return df.mapInPandas(lambda frames: (fn(f) for f in frames), schema)


def rolling_apply(df: DataFrame, s: Series, x: str, n: int, fn: Callable[[list[float]], float], name: str = "rolled") -> DataFrame:
    """fn over the last n values of each row; null until n are known. Frames of n values go to Python in batches."""

    @F.pandas_udf("double")
    def apply(frames: pd.Series) -> pd.Series:
        return frames.map(lambda f: float(fn(list(f))) if f is not None and len(f) == n else None).astype("float64")

    return df.withColumn(name, apply(F.collect_list(x).over(s.last(n))))


def resample_apply(df: DataFrame, every: str, by: Sequence[str], ts: str, fn: Callable[[pd.DataFrame], dict[str, float]], outs: Sequence[str]) -> DataFrame:
    """fn over the rows of each tumbling window, in time order. Windows stream through tasks in sorted batches, because a
    frame sent for each of many short ones would cost more than fn."""
    from quantspark.functions.kernels import _cuts

    kinds = dict(df.dtypes)
    keys = [*by, "__start"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "start timestamp", *[f"`{o}` double" for o in outs]])

    def told(window: pd.DataFrame) -> tuple:
        values = fn(window)
        return (*[window[c].iloc[0] for c in keys], *[values[o] for o in outs])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lambda rows: pd.DataFrame(rows, columns=[*by, "start", *outs])
        parts: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            frame = frame.reset_index(drop=True)
            starts = [int(i) for i in _cuts(frame[keys])]
            if parts and len(_cuts(pd.concat([parts[-1][keys].tail(1), frame[keys].head(1)], ignore_index=True))):
                starts.insert(0, 0)
            if not starts:
                parts.append(frame)
                continue
            # A window may have begun in earlier batches; the last one may go on in the next.
            windows = [pd.concat([*parts, frame.iloc[: starts[0]]]) if parts else frame.iloc[: starts[0]]]
            windows += [frame.iloc[i:j] for i, j in zip(starts, starts[1:], strict=False)]
            parts = [frame.iloc[starts[-1] :]]
            yield table([told(w) for w in windows])
        if parts:
            yield table([told(pd.concat(parts))])

    rows = df.withColumn("__start", F.window(ts, every)["start"].cast("timestamp"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, ts).mapInPandas(run, schema)


class Steps:
    """Named steps DataFrame -> DataFrame, applied in order. Each adds to one plan, which Catalyst optimises whole."""

    def __init__(self) -> None:
        self._steps: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Steps:
        if name in self._steps:
            raise ValueError(f"step {name} is there twice")
        self._steps[name] = step
        return self

    def run(self, df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
        unknown = set(only or ()) - set(self._steps)
        if unknown:
            raise KeyError(f"no step {', '.join(sorted(unknown))}")
        for name, step in self._steps.items():
            if only is None or name in only:
                df = df.transform(step)
        return df
