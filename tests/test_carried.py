"""Recursions read in batches and exact percentiles, against one pass over whole series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.frames import Series
from quantspark.functions import kernels as k
from quantspark.operators import quantiles

S = Series(("asset",), ("ts",))


@pytest.fixture(scope="module")
def rows():
    """Three series, one without a key, with missing values at the start, inside and at the end."""
    rng = np.random.default_rng(5)
    out = []
    for asset, n in (("a", 900), (None, 40), ("b", 1)):
        price = np.abs(100 + rng.normal(0, 1, n).cumsum()) + 1
        for i in range(n):
            hole = asset != "b" and (i in (0, 7, 8, n - 1) or 200 <= i < 520)
            out.append((asset, i, None if hole else float(price[i]), i % 3 or None, ["x"]))
    return out


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield spark.createDataFrame
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


SCHEMA = "asset string, ts long, price double, extra int, more array<string>"


def whole(rows, asset):
    return pd.Series([r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == asset], dtype="float64")


def test_batches_carry_the_means(rows, small_batches):
    df = small_batches(rows, SCHEMA)
    got = k.ema(df, S, span=10).withColumnRenamed("ema", "plain")
    got = k.ema_adjusted(got, S, span=10).collect()
    assert len(got) == len(rows)
    assert {r["extra"] for r in got} == {None, 1, 2} and all(r["more"] == ["x"] for r in got)
    for asset in ("a", None, "b"):
        mine = sorted((r for r in got if r["asset"] == asset), key=lambda r: r["ts"])
        x = whole(rows, asset)
        for name, want in (("plain", x.ewm(alpha=2 / 11, adjust=False).mean()), ("ema", x.ewm(span=10, adjust=True).mean())):
            have = [math.nan if r[name] is None else r[name] for r in mine]
            np.testing.assert_allclose(have, want, rtol=1e-9)


def test_batches_carry_earlier_rows_and_states(rows, small_batches, spark):
    df = small_batches([(a, t, 50.0 if p is None else p, e, m) for a, t, p, e, m in rows], SCHEMA)
    calls = {
        "rsi": k.rsi_wilder, "signal": k.macd_cross, "alarm": lambda d, s: k.cusum(d, s, threshold=2.0), "level": k.kalman_level,
        "volatility": k.return_volatility, "threshold": lambda d, s: k.dynamic_threshold(d, s, "price", start=90.0),
        "equity": lambda d, s: k.circuit_breaker(d.withColumn("ret", F.sin("price") / 5), s), "variance": lambda d, s: k.garch(d.withColumn("ret", F.sin("price")), s),
    }
    for name, call in calls.items():
        parts = {(r["asset"], r["ts"]): r[name] for r in call(df, S).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        at_once = {(r["asset"], r["ts"]): r[name] for r in call(df, S).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        assert parts.keys() == at_once.keys() and len(parts) == len(rows)
        for key, value in parts.items():
            other = at_once[key]
            assert value is other or value == pytest.approx(other, rel=1e-9, abs=1e-9), (name, key)


def test_volatility_of_returns_by_its_definition(rows, small_batches):
    got = k.return_volatility(small_batches(rows, SCHEMA), S, span=20).collect()
    for asset in ("a", None, "b"):
        r = whole(rows, asset).pipe(lambda x: x / x.shift(1) - 1)
        mean = lambda x: x.ewm(alpha=2 / 21, adjust=False).mean()
        want = np.sqrt((mean(r * r) - mean(r) ** 2).clip(lower=0)).where(r.notna())
        have = [math.nan if x["volatility"] is None else x["volatility"] for x in sorted((x for x in got if x["asset"] == asset), key=lambda x: x["ts"])]
        np.testing.assert_allclose(have, want, rtol=1e-6, atol=1e-9)


def test_empty_table(spark):
    assert k.garch(spark.createDataFrame([], SCHEMA).withColumn("ret", F.col("price")), S).collect() == []
    assert [tuple(r) for r in quantiles.exact(spark.createDataFrame([], SCHEMA), "price", {"m": 0.5}).collect()] == [(None,)]
    assert quantiles.exact(spark.createDataFrame([], SCHEMA), "price", {"m": 0.5}, ["asset"]).collect() == []


def test_exact_quantiles_by_group(spark):
    rng = np.random.default_rng(11)
    values = {
        "wide": np.concatenate([rng.normal(0, 1, 501), -np.exp(rng.normal(0, 20, 77)), np.zeros(9)]), "one": np.full(40, 2.5), "single": np.array([-3.0]),
        "close": 1 + rng.integers(0, 50, 700) * 1e-12, None: rng.integers(-3, 4, 100).astype(float), "ends": np.array([-math.inf, 0.0, 5e-324, 1.7e308, math.inf]),
    }
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [(g, None) for g in ("wide", "nulls", None)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("g", T.StringType()), T.StructField("x", T.DoubleType())])).repartition(7)
    wanted = {"q0": 0.0, "q05": 0.05, "q5": 0.5, "q9": 0.9, "q1": 1.0}
    got = {r["g"]: r for r in quantiles.exact(df, "x", wanted, ["g"]).collect()}
    assert got.keys() == {*values, "nulls"}
    assert tuple(got["nulls"])[1:] == (None,) * 5
    for g, vs in values.items():
        for name, p in wanted.items():
            place = p * (len(vs) - 1)
            low, high = np.sort(vs)[[math.floor(place), math.ceil(place)]]
            want = low if low == high else (1 - (place - math.floor(place))) * low + (place - math.floor(place)) * high
            assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)
    told = df.agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in wanted.items()]).first()
    assert tuple(quantiles.exact(df, "x", wanted).first()) == pytest.approx(tuple(told))


def test_quantiles_of_narrow_ranges(spark):
    """300,000 different prices in one cell, among them a cluster as close as doubles nearly allow: the ranks are found, and
    a part that is numbered in one task holds a small share of them. The cluster covers about three parts."""
    prices = spark.range(300_000).select((F.lit(10_000.0) + F.col("id") * 2e-5).alias("x"))
    close = spark.range(50_000).select((F.lit(10_003.0) + F.col("id") * 2e-11).alias("x"))
    df = prices.unionByName(close).repartition(5)
    assert df.select(quantiles.cell(F.col("x")).alias("c")).distinct().count() == 1
    wanted = {"low": 0.01, "mid": 0.5, "high": 0.77}
    told = df.agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in wanted.items()]).first()
    assert tuple(quantiles.exact(df, "x", wanted).first()) == pytest.approx(tuple(told), rel=1e-15)
    values = df.groupBy("x").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("x", "__x")
    ends = df.agg(F.min("x"), F.max("x"), F.count("x")).first()
    values = values.select(F.lit(1).alias("__cell"), "__x", "__n", F.lit(0).alias("__start"), F.lit(ends[2]).alias("__all"), F.lit(ends[0]).alias("__low"), F.lit(ends[1]).alias("__high"))
    place = ["__cell"]
    for i, parts in enumerate(quantiles.PARTS):
        values, place = quantiles._narrowed(values, place, lambda start, end, n: F.lit(True), parts, f"__part{i}")
    sizes = sorted(r["count"] for r in values.groupBy(*place).count().collect())
    assert sizes[-1] < 20_000 and sizes[-5] < 500


def test_zero_prices_give_no_return(spark):
    """A price of zero is behind the next return and below a bar's range; neither may stop a query."""
    from quantspark.operators import diagnostics, market

    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([10.0, 11.0, 0.0, 12.0, 11.0, 13.0])], "asset string, ts long, price double")
    rows = sorted(k.return_volatility(df, S).collect(), key=lambda r: r["ts"])
    assert rows[3]["volatility"] is None and math.isfinite(rows[5]["volatility"])
    out = {r["ts"]: r["touch_return"] for r in market.triple_barrier(k.return_volatility(df, S), S, "price", horizon=2).collect()}
    assert out[2] is None and out[4] == pytest.approx(13 / 11 - 1)
    bars = df.select("asset", "ts", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")])
    assert [r["parkinson"] for r in diagnostics.range_volatility(bars, S, n=1).orderBy("ts").collect()][2] is None
