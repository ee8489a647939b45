"""Event-time windows and stateful operators on Structured Streaming. Every windowed function also takes a batch frame."""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantspark.frames import quotient

HORIZONS = (15, 60, 240)


def weigh_events(events: DataFrame, least_influence: float = 0.1, usual_volume: float = 100.0, most: float = 5.0) -> DataFrame:
    """Events of too little influence go; the others weigh influence times volume over the usual one, up to most."""
    volume = F.least(F.col("volume") / usual_volume, F.lit(most))
    return events.where(F.col("influence") >= least_influence).withColumn("weight", F.col("influence") * volume)


def sentiment_windows(events: DataFrame, minutes: int, slide: int, by: Sequence[str] = ("asset",), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Count, weighted mean and spread of sentiment in sliding event-time windows."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.col("weight")
    out = rows.groupBy(*by, F.window(ts, f"{minutes} minutes", f"{slide} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("sentiment") * w).alias("__t"), F.sum(w).alias("__w"), F.stddev_pop("sentiment").alias("std")
    )
    mean = F.when(F.col("__w") > 0, F.col("__t") / F.when(F.col("__w") > 0, F.col("__w"))).otherwise(0.0)
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", mean.alias("sentiment"), "std")


def window_signal(windows: DataFrame, strong: float = 0.2, enough: int = 30) -> DataFrame:
    """Direction of the mean and confidence n over enough, at most 1."""
    direction = F.when(F.col("sentiment") > strong, 1).when(F.col("sentiment") < -strong, -1).otherwise(0)
    return windows.withColumn("signal", direction).withColumn("confidence", F.least(F.lit(1.0), F.col("n") / enough))


def mood_signal(short: DataFrame, medium: DataFrame, long: DataFrame, by: Sequence[str] = ("asset",), least: int = 10, far: float = 2.5, enough: int = 30) -> DataFrame:
    """One row per end of a short window: sentiment and volatility of it, momentum, anomaly and confidence.

    Momentum is the change from the medium to the short mean relative to the medium one, in [-1, 1], 0 where that is 0.
    Anomaly is 0 unless the short mean lies at least far deviations off the long one, then a sigmoid of the distance
    beyond far; the first least signals of a key have none. Windows of equal end belong together.
    """
    part = lambda w, name: w.select(*by, "end", F.col("sentiment").alias(f"{name}_mean"), F.col("std").alias(f"{name}_std"))
    rows = short.join(part(medium, "medium"), [*by, "end"]).join(part(long, "long"), [*by, "end"])
    earlier = F.row_number().over(Window.partitionBy(*by).orderBy("end")) - 1
    m = F.col("medium_mean")
    momentum = F.when(m == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("sentiment") - m) / F.abs(F.when(m != 0, m)))))
    off = F.abs(F.col("sentiment") - F.col("long_mean")) / F.when(F.col("long_std") != 0, F.col("long_std"))
    anomaly = F.when((earlier >= least) & (off >= far), 1 / (1 + F.exp(-0.5 * (off - far)))).otherwise(0.0)
    return rows.withColumns({"momentum": momentum, "anomaly": anomaly, "confidence": F.least(F.col("n") / enough, F.lit(1.0))})


def momentum_scan(ticks: DataFrame, by: Sequence[str] = ("asset",), ts: str = "ts", price: str = "price", seconds: int = 60, least: float = 0.02) -> DataFrame:
    """Rows whose price has moved by at least least from the oldest one of the trailing seconds; n rows lie in them. A
    change from zero is infinite or NaN, and large enough."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(*by).orderBy("__us").rangeBetween(-seconds * 1_000_000, 0)
    rows = ticks.withColumn("__us", at).withColumn("n", F.count(F.lit(1)).over(frame)).withColumn("__first", F.first(price).over(frame))
    change = quotient(F.col(price), F.col("__first")) - 1
    return rows.withColumn("change", change).where((F.col("n") >= 2) & (F.abs("change") >= least)).drop("__us", "__first")


def stream_momentum(ticks: DataFrame, seconds: int = 60, least: float = 0.02, late: str = "10 minutes") -> DataFrame:
    """The same from a stream of (asset, ts, price): (asset, ts, price, change). The state of a key is the trailing rows;
    it goes when event time has passed them."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, prices = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        changes, moved = [], []
        for t, p in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["price"], strict=True):
            times.append(int(t))
            prices.append(float(p))
            keep = bisect_left(times, int(t) - seconds * 1_000_000)
            del times[:keep], prices[:keep]
            told = len(prices) > 1 and not (math.isnan(p) or math.isnan(prices[0]))
            with np.errstate(divide="ignore", invalid="ignore"):
                changes.append(np.float64(p) / np.float64(prices[0]) - 1 if told else 0.0)
            # A change of zero by zero is NaN and counts as large; an unknown price has none.
            moved.append(told and not abs(changes[-1]) < least)
        state.update((times, prices))
        state.setTimeoutTimestamp(max(times[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        out = rows[["ts", "price"]].assign(asset=key[0], change=changes)
        yield out[np.array(moved, bool)][["asset", "ts", "price", "change"]]

    kind = dict(ticks.dtypes)["asset"]
    rows = ticks.select("asset", "ts", "price").withWatermark("ts", late)
    out = rows.groupBy("asset").applyInPandasWithState(advance, f"asset {kind}, ts timestamp, price double, change double", "times array<long>, prices array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    # Arrow has made null of NaN.
    return out.withColumn("change", F.coalesce("change", F.lit(math.nan)))


def stop_states(ticks: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Trailing stop kept across triggers: (asset, ts, price, stop, hit) for streams of (asset, ts, price). Rows of one
    trigger are taken in time order; the state of a key is one number."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        stops, hits = [], []
        for price in rows["price"]:
            hits.append(bool(level and price <= level))
            level = max(level, price * (1 - fraction))
            stops.append(level)
        state.update((level,))
        yield rows[["ts", "price"]].assign(asset=key[0], stop=stops, hit=hits)[["asset", "ts", "price", "stop", "hit"]]

    kind = dict(ticks.dtypes)["asset"]
    return ticks.select("asset", "ts", "price").groupBy("asset").applyInPandasWithState(advance, f"asset {kind}, ts timestamp, price double, stop double, hit boolean", "level double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over everything available, writes it as Parquet below folder, and reads it back."""
    spark: SparkSession = stream.sparkSession
    root = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
