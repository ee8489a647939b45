"""Resampling, seasonality, regime, liquidity and concentration queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantspark.frames import TICKS, rounded
from quantspark.functions.kernels import return_volatility
from quantspark.operators import market as m
from quantspark.pieces import dealt
from quantspark.plans.indicator_queries import RET, W, fullw, over_ticks, pick, r
from quantspark.plans.kernel_queries import fold
from quantspark.plans.registry import register
from quantspark.plans.report_queries import RETURNS, TRADES, TW, returns
from quantspark.plans.series_queries import SOFAR
from quantspark.sources.tables import TICKS_SQL, TRADES_SQL, ticks, trades


@register(
    "resample_ohlcv",
    f"""WITH {TICKS_SQL}, a AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS start, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY kind ORDER BY ts, tie)) / 1e6, 0) AS d FROM ticks)
SELECT kind, start, {r('arg_min(price, (ts, tie))', 'open')}, {r('max(price)', 'high')}, {r('min(price)', 'low')}, {r('arg_max(price, (ts, tie))', 'close')}, count(price) AS n, {r('sum(price * d) / nullif(sum(d), 0)', 'twap')} FROM a GROUP BY 1, 2""",
)
def resample_ohlcv(spark, sf_dir):
    return rounded(m.resample_bars(ticks(spark, sf_dir), "6 hours", ["kind"]))


@register(
    "vwap_bars",
    f"WITH {TRADES_SQL} SELECT symbol, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, {r('sum(price * quantity) / sum(quantity)', 'vwap')}, {r('sum(quantity)', 'volume')} FROM trades GROUP BY 1, 2",
)
def vwap_bars(spark, sf_dir):
    return rounded(m.vwap_bars(trades(spark, sf_dir), "7 days", ["symbol"], "ts", "price", "quantity"))


@register(
    "calendar_features",
    f"""WITH {TRADES_SQL}, d AS (SELECT DISTINCT ts FROM trades) SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(year(ts) AS INTEGER) AS year, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(month(ts) AS INTEGER) AS month, CAST(weekofyear(ts) AS INTEGER) AS iso_week, CAST(day(ts) AS INTEGER) AS day,
CAST(dayofyear(ts) AS INTEGER) AS year_day, CAST(isodow(ts) AS INTEGER) AS weekday, isodow(ts) > 5 AS weekend, CAST(ts AS DATE) = last_day(ts) AS month_end,
{r('sin(2 * pi() * month(ts) / 12)', 'month_sin')}, {r('cos(2 * pi() * month(ts) / 12)', 'month_cos')}, {r('sin(2 * pi() * isodow(ts) / 7)', 'weekday_sin')}, {r('cos(2 * pi() * isodow(ts) / 7)', 'weekday_cos')} FROM d""",
)
def calendar_features(spark, sf_dir):
    days = trades(spark, sf_dir).select("ts").distinct().withColumn("date", F.to_date("ts").cast("string"))
    return rounded(m.calendar_features(days).drop("ts"))


def _season(part: str, by: str = "") -> str:
    return f"""WITH {RETURNS} SELECT {by}{part} AS part, count(*) AS n, {r('avg(ret)', 'mean')}, {r('stddev_samp(ret)', 'std')}, {r('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {r('avg(ret) * sqrt(count(*)) / stddev_samp(ret)', 't_stat')} FROM rets WHERE ret IS NOT NULL GROUP BY ALL"""


@register("weekday_seasonality", _season("CAST(isodow(ts) AS INTEGER)"))
def weekday_seasonality(spark, sf_dir):
    return rounded(m.seasonality(returns(spark, sf_dir), F.weekday("ts") + 1))


@register("hour_seasonality", _season("CAST(hour(ts) AS INTEGER)", "kind, "))
def hour_seasonality(spark, sf_dir):
    return rounded(m.seasonality(returns(spark, sf_dir), F.hour("ts"), ["kind"]))


@register("seasonal_factors", f"WITH {TRADES_SQL} SELECT CAST(month(ts) AS INTEGER) AS part, {r('avg(price) / (SELECT avg(price) FROM trades)', 'factor')} FROM trades GROUP BY 1")
def seasonal_factors(spark, sf_dir):
    return rounded(m.seasonal_factors(trades(spark, sf_dir), F.month("ts"), "price"))


VOL = f"""a AS (SELECT *, {RET} AS x FROM ticks), v AS (SELECT *, {fullw('stddev_samp(x)', 'x', 10)} AS vol FROM a), c AS (SELECT asset, avg(vol) AS m, CASE WHEN count(vol) > 1 THEN stddev_samp(vol) ELSE 0.5 * avg(vol) END AS sd FROM v GROUP BY 1),
final AS (SELECT v.*, CASE WHEN vol < m - 0.5 * sd THEN 'low' WHEN vol > m + 1.5 * sd THEN 'high' ELSE 'normal' END AS regime FROM v JOIN c ON v.asset = c.asset)"""


@over_ticks("volatility_regimes", VOL, f"{r('vol', 'vol')}, regime")
def volatility_regimes(spark, sf_dir):
    return pick(m.volatility_regimes(ticks(spark, sf_dir)), "vol", "regime")


TREND = f"""a AS (SELECT *, {fullw('avg(price)', 'price', 5)} AS f, {fullw('avg(price)', 'price', 20)} AS s FROM ticks),
final AS (SELECT *, CASE WHEN s IS NULL OR f IS NULL THEN NULL WHEN (f - s) / s > 0.02 THEN 'up' WHEN (f - s) / s < -0.02 THEN 'down' ELSE 'flat' END AS trend FROM a)"""


@over_ticks("trend_regimes", TREND, "trend")
def trend_regimes(spark, sf_dir):
    return pick(m.trend_regimes(ticks(spark, sf_dir)), "trend")


@register(
    "regime_transitions",
    f"""WITH {TICKS_SQL}, {TREND}, t AS (SELECT lag(trend) OVER ({W}) AS "from", trend AS "to" FROM final), c AS (SELECT "from", "to", count(*) AS n FROM t WHERE "from" IS NOT NULL AND "to" IS NOT NULL GROUP BY 1, 2)
SELECT "from", "to", n, {r('n / sum(n) OVER (PARTITION BY "from")', 'share')} FROM c""",
)
def regime_transitions(spark, sf_dir):
    return rounded(m.transitions(m.trend_regimes(ticks(spark, sf_dir)), TICKS, "trend"))


@register(
    "regime_spells",
    f"""WITH {TICKS_SQL}, {TREND}, k AS (SELECT *, CASE WHEN trend IS DISTINCT FROM lag(trend) OVER ({W}) THEN 1 ELSE 0 END AS c FROM final WHERE trend IS NOT NULL), g AS (SELECT *, sum(c) OVER {SOFAR} AS run FROM k),
u AS (SELECT asset, run, max(trend) AS trend, count(*) AS n FROM g GROUP BY 1, 2) SELECT trend, count(*) AS spells, {r('avg(n)', 'mean_length')}, max(n) AS longest FROM u GROUP BY 1""",
)
def regime_spells(spark, sf_dir):
    return rounded(m.spells(m.trend_regimes(ticks(spark, sf_dir)), TICKS, "trend"))


@register(
    "amihud_illiquidity",
    f"WITH {TRADES_SQL}, a AS (SELECT *, price / lag(price) OVER ({TW}) - 1 AS ret FROM trades) SELECT symbol, round(avg(1e6 * abs(ret) / (price * quantity)), 6) + 0.0 AS illiquidity, count(ret) AS n FROM a GROUP BY 1",
)
def amihud_illiquidity(spark, sf_dir):
    rows = dealt(trades(spark, sf_dir), TRADES).lag(__p="price").rows.withColumn("ret", F.col("price") / F.col("__p") - 1).withColumn("value", F.col("price") * F.col("quantity"))
    return rounded(m.amihud(rows, ["symbol"], "ret", "value"))


@register(
    "roll_spread",
    f"""WITH {TICKS_SQL}, a AS (SELECT *, price - lag(price) OVER ({W}) AS d FROM ticks), b AS (SELECT *, lag(d) OVER ({W}) AS e FROM a), c AS (SELECT asset, covar_samp(d, e) AS cov, count(*) AS n FROM b WHERE e IS NOT NULL GROUP BY 1)
SELECT asset, {r('cov', 'cov')}, n, {r('CASE WHEN cov < 0 THEN 2 * sqrt(-cov) ELSE 0 END', 'spread')} FROM c""",
)
def roll_spread(spark, sf_dir):
    return rounded(m.roll_spread(ticks(spark, sf_dir), TICKS, "price"))


SIGNED = f"""g AS (SELECT *, nullif(sign(price - lag(price) OVER ({TW})), 0) AS g FROM trades), s AS (SELECT *, coalesce(last_value(g IGNORE NULLS) OVER ({TW} ROWS UNBOUNDED PRECEDING), 0) AS side FROM g)"""
T10 = f"({TW} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@register(
    "order_imbalance",
    f"WITH {TRADES_SQL}, {SIGNED} SELECT symbol, okey, line, CAST(side AS DOUBLE) AS side, {r(f'CASE WHEN count(quantity) OVER {T10} = 10 THEN sum(side * quantity) OVER {T10} / sum(quantity) OVER {T10} END', 'imbalance')} FROM s",
)
def order_imbalance(spark, sf_dir):
    return rounded(m.order_imbalance(trades(spark, sf_dir), TRADES, "price", "quantity", 10).select("symbol", "okey", "line", "side", "imbalance"))


@register(
    "vpin",
    f"""WITH {TRADES_SQL}, {SIGNED}, b AS (SELECT *, floor(sum(quantity) OVER ({TW} ROWS UNBOUNDED PRECEDING) / 5000) AS bucket FROM s), c AS (SELECT symbol, CAST(bucket AS BIGINT) AS bucket, abs(sum(side * quantity)) AS gap, sum(abs(side * quantity)) AS volume FROM b GROUP BY 1, 2)
SELECT symbol, bucket, gap, volume, {r('coalesce(avg(gap / nullif(volume, 0)) OVER w, 0)', 'vpin')} FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def vpin(spark, sf_dir):
    return rounded(m.vpin(trades(spark, sf_dir), TRADES, "price", "quantity", 5000.0, 5))


@register(
    "kyle_lambda",
    f"WITH {TRADES_SQL}, {SIGNED}, d AS (SELECT symbol, price - lag(price) OVER ({TW}) AS d, side * quantity AS v FROM s) SELECT symbol, round(regr_slope(d, v), 4) + 0.0 AS kyle_lambda, {r('regr_r2(d, v)', 'r2')} FROM d WHERE d IS NOT NULL GROUP BY 1",
)
def kyle_lambda(spark, sf_dir):
    return rounded(m.kyle_lambda(trades(spark, sf_dir), TRADES, "price", "quantity").withColumn("kyle_lambda", F.round("kyle_lambda", 4)))


@register(
    "volume_profile",
    f"""WITH {TRADES_SQL}, a AS (SELECT symbol, CAST(floor(price / 5000) * 5000 AS DOUBLE) AS bucket, sum(quantity) AS volume FROM trades GROUP BY 1, 2), b AS (SELECT *, row_number() OVER o AS k, coalesce(sum(volume) OVER (PARTITION BY symbol ORDER BY volume DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(volume) OVER (PARTITION BY symbol) AS f
 FROM a WINDOW o AS (PARTITION BY symbol ORDER BY volume DESC, bucket)) SELECT symbol, bucket, volume, k = 1 AS poc, f < 0.7 AS in_value_area FROM b""",
)
def volume_profile(spark, sf_dir):
    return rounded(m.volume_profile(trades(spark, sf_dir), ["symbol"], "price", "quantity", 5000.0))


@register(
    "concentration",
    """WITH a AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, sum(c_acctbal) AS x FROM customer GROUP BY 1, 2), b AS (SELECT *, x / sum(x) OVER (PARTITION BY segment) AS p, row_number() OVER (PARTITION BY segment ORDER BY x, nation) AS up, row_number() OVER (PARTITION BY segment ORDER BY x DESC, nation) AS down FROM a WHERE x > 0)
SELECT segment, count(*) AS n, round(sum(p * p), 6) + 0.0 AS hhi, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, round(2 * sum(up * p) / count(*) - (count(*) + 1) / count(*), 6) + 0.0 AS gini, round(sum(CASE WHEN down <= 3 THEN p END), 6) + 0.0 AS top_share, round(1 / sum(p * p), 6) + 0.0 AS effective_n FROM b GROUP BY 1""",
)
def concentration(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    return rounded(m.concentration(rows, ["segment"], "nation", "c_acctbal"))


@register(
    "sessions",
    f"""WITH {TICKS_SQL}, a AS (SELECT *, CASE WHEN ts < lag(ts) OVER ({W}) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM ticks), b AS (SELECT *, sum(c) OVER {SOFAR} AS g FROM a)
SELECT asset, min(ts) AS start, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds, count(*) AS n FROM b GROUP BY asset, g""",
)
def sessions(spark, sf_dir):
    return m.sessions(ticks(spark, sf_dir), ["asset"], "6 hours")


@register(
    "triple_barrier",
    f"""WITH {TICKS_SQL}, a AS (SELECT *, {RET} AS x FROM ticks), e AS (SELECT *, {fold('x', 2 / 21)} AS m, {fold('x * x', 2 / 21, 'x IS NOT NULL')} AS q, list(price) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS path FROM a),
v AS (SELECT *, CASE WHEN x IS NOT NULL THEN sqrt(greatest(q - m * m, 0)) END AS vol FROM e), b AS (SELECT *, coalesce(list_position(list_transform(path, lambda y: y >= price * (1 + 2 * vol)), true), 0) AS u, coalesce(list_position(list_transform(path, lambda y: y <= price * (1 - 2 * vol)), true), 0) AS d FROM v WHERE vol > 1e-9 AND len(path) > 0),
l AS (SELECT *, CASE WHEN u > 0 AND (d = 0 OR u <= d) THEN 1 WHEN d > 0 THEN -1 ELSE 0 END AS label FROM b), t AS (SELECT *, CASE label WHEN 1 THEN u WHEN -1 THEN d ELSE len(path) END AS touch FROM l)
SELECT asset, tie, CAST(label AS DOUBLE) AS label, CAST(touch AS DOUBLE) AS touch, {r('path[touch] / nullif(price, 0) - 1', 'touch_return')} FROM t""",
)
def triple_barrier(spark, sf_dir):
    rows = return_volatility(ticks(spark, sf_dir), skip=True)
    # What rounding leaves of a series that does not move is no volatility.
    out = m.triple_barrier(rows.withColumn("volatility", F.when(F.col("volatility") > 1e-9, F.col("volatility"))), TICKS, "price")
    return pick(out.withColumns({"label": F.col("label").cast("double"), "touch": F.col("touch").cast("double")}), "label", "touch", "touch_return")


@register(
    "top_assets",
    f"WITH {TICKS_SQL}, a AS (SELECT kind, asset, count(*) AS n, sum(price) AS value FROM ticks GROUP BY 1, 2) SELECT kind, asset, n, {r('value', 'value')} FROM a QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value DESC, asset) <= 5",
)
def top_assets(spark, sf_dir):
    """The five assets of largest value for each kind."""
    sums = ticks(spark, sf_dir).groupBy("kind", "asset").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("value"))
    best = Window.partitionBy("kind").orderBy(F.col("value").desc(), "asset")
    return rounded(sums.withColumn("k", F.row_number().over(best)).where("k <= 5").drop("k"))
