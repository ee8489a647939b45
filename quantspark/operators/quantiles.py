"""Exact percentiles of groups of any size: no task holds a group or its distinct values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that a doubling of values falls into. A cell is a range of values known before the data are read.
CELLS = 256
#: The cell of infinity, above those of all finite values.
LIMIT = 2_125 * CELLS
#: Parts of equal width that each narrowing cuts a cell into. A cell holds 2^44 different doubles, so two of them leave
#: about a million in a part at the very most, whatever the values are.
PARTS = (4_096, 4_096)


def cell(x: Column) -> Column:
    """The number of the range that x lies in: null for null, rising with x, NaN above all, zero alone."""
    steps = F.least(F.floor((F.log2(F.abs(x)) + 1_100) * CELLS), F.lit(LIMIT)).cast("int")
    return F.when(F.isnan(x), F.lit(LIMIT + 1)).when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("int") * F.greatest(steps, F.lit(1)))


def _part(parts: int) -> Column:
    """The number of the part of [__low, __high] that __x lies in. It never falls as __x rises."""
    width = F.col("__high") - F.col("__low")
    return F.when(width > 0, F.least(F.floor((F.col("__x") - F.col("__low")) / width * parts), F.lit(parts - 1))).otherwise(F.lit(0)).cast("int")


def _narrowed(values: DataFrame, at: list[str], wanted: Callable[[Column, Column, Column], Column], parts: int, name: str) -> tuple[DataFrame, list[str]]:
    """The values (at, __x, __n) of those parts of their place that hold a wanted rank, with __start (rows before the part),
    __all, __low and __high (the part's least and largest value). Places get one more column, name."""
    values = values.withColumn(name, _part(parts))
    sums = values.groupBy(*at, name, "__start", "__all").agg(F.sum("__n").alias("__m"), F.min("__x").alias("__least"), F.max("__x").alias("__most"))
    so_far = Window.partitionBy(*at).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("__end", F.col("__start") + F.sum("__m").over(so_far)).withColumn("__begin", F.col("__end") - F.col("__m"))
    sums = sums.where(wanted(F.col("__begin"), F.col("__end"), F.col("__all")))
    place = [*at, name]
    found = sums.select(*[F.col(c).alias(f"{c}n") for c in place], "__begin", "__least", "__most")
    rows = values.drop("__start", "__low", "__high").join(found, _same(place))
    return rows.select(*place, "__x", "__n", "__all", F.col("__begin").alias("__start"), F.col("__least").alias("__low"), F.col("__most").alias("__high")), place


def _same(names: Sequence[str]) -> Column:
    """Each name equals the name with an n behind it; null equals null. Numbers of cells and parts are never null."""
    match = F.lit(True)
    for c in names:
        match = match & (F.col(c).eqNullSafe(F.col(f"{c}n")) if c.startswith("__k") else F.col(c) == F.col(f"{c}n"))
    return match


def exact(df: DataFrame, x: str, wanted: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row for each group (one without by) with the wanted percentiles, between neighbours by their distance, by name.

    Rows are first counted by cell; running sums of those few counts tell in which cells the wanted ranks lie, and only
    the values there are shuffled and counted by value. Each such cell is cut into parts twice, by counts again, so that
    values are numbered only within the parts that hold a rank: a narrow range of prices does not land in one task. Nulls
    do not count; a group of nulls has null percentiles, as the one row of an empty table without by. Null keys are a group.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(x).cast("double").alias("__x")).withColumn("__cell", cell(F.col("__x")))
    group = keys or [F.lit(0)]
    cells = rows.groupBy(*keys, "__cell").agg(F.count("__x").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    so_far = Window.partitionBy(*group).orderBy(F.col("__cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("__end", F.sum("__n").over(so_far)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*group)))

    def inside(start: Column, end: Column, n: Column) -> Column:
        out = F.lit(False)
        for p in wanted.values():
            for rank in (F.floor(F.lit(float(p)) * (n - 1)), F.ceil(F.lit(float(p)) * (n - 1))):
                out = out | ((rank >= start) & (rank < end))
        return out

    start = F.col("__end") - F.col("__n")
    needed = cells.where(inside(start, F.col("__end"), F.col("__all")))
    needed = needed.select(*[F.col(k).alias(f"{k}n") for k in keys], F.col("__cell").alias("__celln"), start.alias("__start"), "__all", "__low", "__high")
    place = [*keys, "__cell"]
    values = rows.join(needed, _same(place)).groupBy(*place, "__x", "__start", "__all", "__low", "__high").agg(F.count(F.lit(1)).alias("__n"))
    for i, parts in enumerate(PARTS):
        values, place = _narrowed(values, place, inside, parts, f"__part{i}")
    run = Window.partitionBy(*place).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("__end", F.col("__start") + F.sum("__n").over(run)).select(*keys, "__x", "__all", "__n", "__end")
    none = cells.where(F.col("__all") == 0).select(*keys, F.lit(None).cast("double").alias("__x"), "__all", "__n", "__end")
    at = lambda rank: F.max(F.when((rank >= start) & (rank < F.col("__end")), F.col("__x")))
    places = {name: F.lit(float(p)) * (F.col("__all") - 1) for name, p in wanted.items()}
    ends = [c for name, rank in places.items() for c in (at(F.floor(rank)).alias(f"__{name}_low"), at(F.ceil(rank)).alias(f"__{name}_high"))]
    found = values.unionByName(none).groupBy(*keys).agg(F.max("__all").alias("__all"), *ends)
    between = []
    for name, rank in places.items():
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        share = rank - F.floor(rank)
        between.append(F.when(low == high, low).otherwise((1 - share) * low + share * high).alias(name))
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *between)
