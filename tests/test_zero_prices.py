"""Prices of zero divide as SQL's doubles do: infinite, or NaN of zero by zero. Halves round as SQL rounds them."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quantspark.frames import rounded
from quantspark.plans import registry

PRICES = {1: [0.0, 0.0, 3.0, 2.0, 4.0], 2: [5.0, 0.0, 6.0, 7.0, 0.0, 0.0, 2.0], 3: [5.0, 6.0, 6.4, 57.63, 6.4], 4: [2.0 + (i * 7 % 11) for i in range(60)]}
PRICES[4][9], PRICES[4][38] = 0.0, 0.0
QUERIES = "drawdown drawdown_report drawdown_episodes drawdown_recovery drawdown_scales equity_phases breach_independence ewma_volatility forward_return lag_diff_features momentum_scan stream_momentum_scan path_ratios triple_barrier variance_ratio".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zeros"))
    rows = [(user, i, p) for user, prices in PRICES.items() for i, p in enumerate(prices)]
    values = ", ".join(f"({k}, TIMESTAMP '2024-01-01' + INTERVAL {i * 50} MINUTE, {user}, 'view', {p!r}::DOUBLE, '')" for k, (user, i, p) in enumerate(rows))
    duckdb.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM (VALUES {values}) v(event_id, ts, user_id, event_type, value, props)) TO '{path}/events.parquet' (FORMAT parquet)")
    return path


def told(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", QUERIES)
def test_zero_prices_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    result = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, folder).select(*result.columns)
    assert sorted(tuple(map(told, r)) for r in got.collect()) == sorted(tuple(map(told, r)) for r in result.fetchall())


def test_halves_round_as_in_duckdb(spark):
    values = [8.0046875 - 0.0, 57.63 / 6.4 - 1, 2.5e-7, 1.0000005, -1.0000005, 1234567.1234565, 1e300, 12345678901.234567, -math.inf, math.nan, None]
    got = [r.x for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i")).select("i", F.col("x")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert list(map(told, got)) == list(map(told, want))
