"""Series of any length in pieces: windows stay within a piece, and a few numbers of a piece are carried into the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.frames import Series

#: Rows of a piece, about; only series with more are dealt.
PIECE = 250_000
#: Cells of equal time for each piece that a series gets. Rows of a cell stay together.
CELLS = 64


def beside(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """df joined with a broadcast table by keys of which null equals null."""
    named = small.select(*[F.col(k).alias(f"{k}__s") for k in keys], *[c for c in small.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}__s"))
    return df.join(F.broadcast(named), match, how).drop(*[f"{k}__s" for k in keys])


@dataclass(frozen=True)
class Dealt:
    """Rows with the number of their piece, __piece, rising with the order. s is the series within a piece."""

    rows: DataFrame
    s: Series
    key: tuple[str, ...]
    #: Keys of the series that have several pieces, few; None if there are none.
    long: DataFrame | None

    def using(self, rows: DataFrame) -> Dealt:
        return replace(self, rows=rows)

    def columns(self, **columns: Column) -> Dealt:
        return self.using(self.rows.withColumns(columns))

    def _carried(self, told: Column, carry: Callable[[str], Column]) -> DataFrame:
        """Rows with __c: what the pieces before hand over, by a window of pieces. Null for first pieces."""
        ends = self.rows.groupBy(*self.key, "__piece").agg(told.alias("__d_v")).select(*self.key, "__piece", carry("__d_v").alias("__d_c"))
        return beside(self.rows, ends.where(F.col("__d_c").isNotNull()), [*self.key, "__piece"])

    def _pieces(self) -> Window:
        return Window.partitionBy(*self.key).orderBy("__piece")

    def _before(self) -> Window:
        return self._pieces().rowsBetween(Window.unboundedPreceding, -1)

    def lag(self, **columns: str) -> Dealt:
        """Columns of the row before, by new names."""
        w = self.s.window()
        own = {name: F.lag(c).over(w) for name, c in columns.items()}
        if self.long is None:
            return self.columns(**own)
        values = F.struct(*[F.col(c).alias(name) for name, c in columns.items()])
        rows = self._carried(F.max_by(values, F.struct(*self.s.order)), lambda v: F.lag(v).over(self._pieces()))
        first = F.row_number().over(w) == 1
        return self.using(rows.withColumns({name: F.when(first, F.col("__d_c")[name]).otherwise(c) for name, c in own.items()}).drop("__d_c"))

    def last_known(self, name: str, c: str) -> Dealt:
        """The last value of c so far that is not null."""
        own = F.last(c, True).over(self.s.so_far())
        if self.long is None:
            return self.columns(**{name: own})
        told = F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*self.s.order)))
        return self.using(self._carried(told, lambda v: F.last(v, True).over(self._before())).withColumn(name, F.coalesce(own, "__d_c")).drop("__d_c"))

    def total(self, name: str, c: str) -> Dealt:
        """The sum of c so far, null while there is no value."""
        own = F.sum(c).over(self.s.so_far())
        if self.long is None:
            return self.columns(**{name: own})
        return self.using(self._carried(F.sum(c), lambda v: F.sum(v).over(self._before())).withColumn(name, F.coalesce(own + F.col("__d_c"), own, "__d_c")).drop("__d_c"))

    def number(self, name: str) -> Dealt:
        """The number of the row in its series, from 0."""
        own = F.row_number().over(self.s.window()) - 1
        if self.long is None:
            return self.columns(**{name: own})
        return self.using(self._carried(F.count(F.lit(1)), lambda v: F.sum(v).over(self._before())).withColumn(name, own + F.coalesce("__d_c", F.lit(0))).drop("__d_c"))

    def whole(self, **values: Column) -> Dealt:
        """Aggregates of all rows of a series beside each of them."""
        own = {name: v.over(self.s.whole()) for name, v in values.items()}
        if self.long is None:
            return self.columns(**own)
        stats = beside(self.rows, self.long, self.key, "left_semi").groupBy(*self.key).agg(F.struct(*[v.alias(name) for name, v in values.items()]).alias("__d_a"))
        rows = beside(self.rows, stats, self.key)
        return self.using(rows.withColumns({name: F.when(F.col("__d_a").isNotNull(), F.col("__d_a")[name]).otherwise(v) for name, v in own.items()}).drop("__d_a"))

    def past(self, n: int) -> Dealt:
        """The rows, __past false, and once more, __past true, in each piece the n rows before it."""
        rows = self.rows.withColumn("__past", F.lit(False))
        if self.long is None or n < 1:
            return self.using(rows)
        tail = beside(rows, self.long, self.key, "left_semi").withColumn("__end", F.lead(F.lit(1), n).over(self.s.window()).isNull()).where("__end")
        ends = tail.groupBy(*self.key, "__piece").agg(F.sort_array(F.collect_list(F.struct(F.struct(*self.s.order).alias("o"), F.struct(*[c for c in self.rows.columns if c not in (*self.key, "__piece")]).alias("r")))).alias("__d_v"))
        # Pieces may be shorter than n rows: n of them are surely enough.
        seen = F.flatten(F.collect_list("__d_v").over(self._pieces().rowsBetween(-n, -1)))
        ends = ends.select(*self.key, "__piece", seen.alias("__d_v"))
        ends = ends.select(*self.key, "__piece", F.explode(F.slice("__d_v", F.greatest(F.size("__d_v") - n + 1, F.lit(1)), n)).alias("__d_v"))
        return self.using(rows.unionByName(ends.select(*self.key, "__piece", "__d_v.r.*", F.lit(True).alias("__past"))))


def dealt(df: DataFrame, s: Series) -> Dealt:
    """df in pieces of about PIECE rows. Series with more rows are counted by cells of equal width of the first column
    of the order, and neighbouring cells make a piece; rows of one such cell stay in one task. Series whose order begins
    with something else than a time or a number are not dealt.
    Finding long series is one aggregation, counting cells another; the driver sees a row or two for each piece."""
    kind = df.schema[s.order[0]].dataType
    lead = F.col(s.order[0])
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        at = F.unix_micros(lead.cast("timestamp")).cast("double")
    elif isinstance(kind, T.NumericType):
        at = lead.cast("double")
    else:
        return Dealt(df.withColumn("__piece", F.lit(0)), s, s.key, None)
    known = F.when(~F.isnan(at) & (F.abs(at) < float("inf")), at)
    sizes = df.groupBy(*s.key).agg(F.count(F.lit(1)).alias("__d_n"), F.min(known).alias("__d_low"), F.max(known).alias("__d_high")).where(F.col("__d_n") > PIECE)
    found = sizes.collect()
    if not found:
        return Dealt(df.withColumn("__piece", F.lit(0)), s, s.key, None)
    spark = df.sparkSession
    sizes = spark.createDataFrame(found, sizes.schema).withColumn("__d_cells", (F.ceil(F.col("__d_n") / PIECE) * CELLS).cast("int"))
    width = F.col("__d_high") - F.col("__d_low")
    step = F.when(width > 0, F.floor((at - F.col("__d_low")) / F.when(width > 0, width) * F.col("__d_cells"))).otherwise(F.lit(0))
    inside = F.greatest(F.least(step, F.col("__d_cells").cast("long") - 1), F.lit(0)).cast("int")
    # Nulls come before all values, NaN after them; the infinite ends lie in the first and last cell.
    cell = F.when(F.col("__d_n").isNull(), F.lit(0)).when(at.isNull(), F.lit(-1)).when(F.isnan(at), F.col("__d_cells")).otherwise(inside)
    rows = beside(df, sizes, s.key).withColumn("__d_cell", cell).drop("__d_low", "__d_high", "__d_cells")
    counts = rows.where(F.col("__d_n").isNotNull()).groupBy(*s.key, "__d_cell").agg(F.count(F.lit(1)).alias("__d_m"))
    start = F.coalesce(F.sum("__d_m").over(Window.partitionBy(*s.key).orderBy("__d_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.withColumn("__piece", F.floor(start / PIECE).cast("int")).groupBy(*s.key, "__piece").agg(F.min("__d_cell").alias("__d_from"), F.max("__d_cell").alias("__d_to"))
    places = spark.createDataFrame(ranges.collect(), ranges.schema).select(*s.key, "__piece", F.explode(F.sequence("__d_from", "__d_to")).alias("__d_cell"))
    rows = beside(rows.drop("__d_n"), places, [*s.key, "__d_cell"]).withColumn("__piece", F.coalesce("__piece", F.lit(0))).drop("__d_cell")
    return Dealt(rows, Series((*s.key, "__piece"), s.order), s.key, sizes.select(*s.key))
