"""Indicator and signal queries over ticks (one series for each user) and daily bars (one for each event type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.frames import rounded
from quantspark.operators import indicators as ind
from quantspark.plans.registry import register
from quantspark.sources.tables import BARS_SQL, TICKS_SQL, bars, ticks

ID = "asset, tie"
DAY = "asset, CAST(ts AS VARCHAR) AS day"
W = "PARTITION BY asset ORDER BY ts, tie"


def rows(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def fullw(value: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} = {n} THEN {value} OVER {rows(n)} END"


def three(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def over_ticks(name: str, steps: str, out: str):
    return register(name, f"WITH {TICKS_SQL}, {steps} SELECT {ID}, {out} FROM final")


def over_bars(name: str, steps: str, out: str):
    return register(name, f"WITH {BARS_SQL}, {steps} SELECT {DAY}, {out} FROM final")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The row's identity and the named columns: ticks by their number, bars by their day."""
    day = dict(df.dtypes)["ts"] == "date"
    return rounded(df.select("asset", F.col("ts").cast("string").alias("day") if day else F.col("tie"), *columns))


RET = f"price / nullif(lag(price) OVER ({W}), 0) - 1"


@register(
    "backtest_sma",
    f"""WITH {TICKS_SQL},
a AS (SELECT *, {RET} AS ret, {fullw('avg(price)', 'price', 3)} - {fullw('avg(price)', 'price', 8)} AS gap FROM ticks),
b AS (SELECT *, coalesce(lag(coalesce(sign(gap), 0)) OVER ({W}), 0) AS position FROM a),
c AS (SELECT *, abs(position - coalesce(lag(position) OVER ({W}), 0)) AS turn FROM b),
d AS (SELECT *, position * coalesce(ret, 0) - 0.001 * turn AS pnl FROM c)
SELECT asset, count(*) AS days, CAST(sum(CASE WHEN turn > 0 THEN 1 ELSE 0 END) AS BIGINT) AS trades, round(sum(pnl), 6) + 0.0 AS total_pnl,
round(CASE WHEN stddev_samp(pnl) <> 0 THEN avg(pnl) / stddev_samp(pnl) END, 6) + 0.0 AS sharpe FROM d GROUP BY asset""",
)
def backtest_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.crossover_backtest(ticks(spark, sf_dir)))


@over_ticks("momentum", f"final AS (SELECT *, price / nullif(lag(price, 5) OVER ({W}), 0) - 1 AS m FROM ticks)", f"{r('m', 'momentum')}, {three('m > 0.1', 'm < -0.1')} AS signal")
def momentum(spark, sf_dir):
    return pick(ind.momentum(ticks(spark, sf_dir)), "momentum", "signal")


@over_ticks("rate_of_change", f"final AS (SELECT *, (price / nullif(lag(price, 3) OVER ({W}), 0) - 1) * 100 AS x FROM ticks)", r("x", "roc"))
def rate_of_change(spark, sf_dir):
    return pick(ind.rate_of_change(ticks(spark, sf_dir)), "roc")


def rsi_steps(n: int) -> str:
    return f"""a AS (SELECT *, price - lag(price) OVER ({W}) AS d FROM ticks),
b AS (SELECT *, CASE WHEN count(d) OVER {rows(n)} = {n} THEN avg(greatest(d, 0)) OVER {rows(n)} END AS g, CASE WHEN count(d) OVER {rows(n)} = {n} THEN avg(greatest(-d, 0)) OVER {rows(n)} END AS l FROM a),
final AS (SELECT *, CASE WHEN g IS NULL THEN NULL WHEN g = 0 AND l = 0 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END AS rsi0 FROM b)"""



@over_ticks("rsi_simple", rsi_steps(14), r("rsi0", "rsi"))
def rsi_simple(spark, sf_dir):
    return pick(ind.rsi_simple(ticks(spark, sf_dir)), "rsi")


BOLL = f"""a AS (SELECT *, {fullw('avg(price)', 'price', 10)} AS m, {fullw('stddev_samp(price)', 'price', 10)} AS s FROM ticks),
final AS (SELECT *, m + 2 * s AS u, m - 2 * s AS l, CASE WHEN s IS NULL THEN NULL WHEN s = 0 THEN 0.5 ELSE (price - (m - 2 * s)) / (4 * s) END AS b FROM a)"""


@over_ticks("bollinger_bands", BOLL, f"{r('m', 'middle')}, {r('u', 'upper')}, {r('l', 'lower')}, {r('CASE WHEN m = 0 THEN 0 ELSE (u - l) / m END', 'bandwidth')}, {r('b', 'percent_b')}")
def bollinger_bands(spark, sf_dir):
    return pick(ind.bollinger(ticks(spark, sf_dir)), "middle", "upper", "lower", "bandwidth", "percent_b")


@over_ticks("bollinger_pctb", BOLL, f"{three('b < 0.05', 'b > 0.95')} AS signal")
def bollinger_pctb(spark, sf_dir):
    return pick(ind.bollinger_place_signal(ticks(spark, sf_dir)), "signal")


@over_ticks("bollinger_touch", BOLL, f"{three('price <= l', 'price >= u')} AS signal")
def bollinger_touch(spark, sf_dir):
    return pick(ind.bollinger_touch_signal(ticks(spark, sf_dir)), "signal")


STOCH = f"""a AS (SELECT *, {fullw('min(low)', 'low', 5)} AS f, {fullw('max(high)', 'high', 5)} AS t FROM bars),
b AS (SELECT *, CASE WHEN t - f IS NULL THEN NULL WHEN t = f THEN 50.0 ELSE 100 * (close - f) / (t - f) END AS k0 FROM a),
c AS (SELECT *, {fullw('avg(k0)', 'k0', 3)} AS d0 FROM b),
final AS (SELECT *, lag(k0 - d0) OVER ({W}) AS p FROM c)"""


@over_bars("stochastic", STOCH, f"{r('k0', 'k')}, {r('d0', 'd')}, {three('k0 - d0 > 0 AND p <= 0 AND k0 < 20', 'k0 - d0 < 0 AND p >= 0 AND k0 > 80')} AS signal")
def stochastic(spark, sf_dir):
    return pick(ind.stochastic(bars(spark, sf_dir)), "k", "d", "signal")


@over_bars(
    "donchian_breakout",
    f"a AS (SELECT *, {fullw('max(high)', 'high', 5)} AS h, {fullw('min(low)', 'low', 5)} AS l FROM bars), final AS (SELECT *, lag(h) OVER ({W}) AS ch, lag(l) OVER ({W}) AS cl FROM a)",
    f"{r('ch', 'channel_high')}, {r('cl', 'channel_low')}, {three('close > ch', 'close < cl')} AS signal",
)
def donchian_breakout(spark, sf_dir):
    return pick(ind.donchian_breakout(bars(spark, sf_dir)), "channel_high", "channel_low", "signal")


@over_bars(
    "williams_r",
    f"final AS (SELECT *, {fullw('min(low)', 'low', 5)} AS f, {fullw('max(high)', 'high', 5)} AS t FROM bars)",
    r("CASE WHEN t - f IS NULL THEN NULL WHEN t = f THEN -50.0 ELSE -100 * (t - close) / (t - f) END", "williams_r"),
)
def williams_r(spark, sf_dir):
    return pick(ind.williams_r(bars(spark, sf_dir)), "williams_r")


TP = "a AS (SELECT *, (high + low + close) / 3 AS tp FROM bars)"


@over_bars("cci", f"{TP}, final AS (SELECT *, {fullw('avg(tp)', 'tp', 5)} AS m, 0.015 * {fullw('stddev_samp(tp)', 'tp', 5)} AS s FROM a)", r("CASE WHEN s IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE (tp - m) / s END", "cci"))
def cci(spark, sf_dir):
    return pick(ind.cci(bars(spark, sf_dir)), "cci")


@over_bars("on_balance_volume", f"a AS (SELECT *, coalesce(sign(close - lag(close) OVER ({W})), 0) * volume AS v FROM bars), final AS (SELECT *, sum(v) OVER ({W} ROWS UNBOUNDED PRECEDING) AS o FROM a)", r("CAST(o AS DOUBLE)", "obv"))
def on_balance_volume(spark, sf_dir):
    return pick(ind.on_balance_volume(bars(spark, sf_dir)), "obv")


@over_bars("running_vwap", f"{TP}, final AS (SELECT *, sum(tp * volume) OVER ({W} ROWS UNBOUNDED PRECEDING) / sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS x FROM a)", r("x", "vwap"))
def running_vwap(spark, sf_dir):
    return pick(ind.running_vwap(bars(spark, sf_dir)), "vwap")


@over_bars(
    "money_flow_index",
    f"{TP}, b AS (SELECT *, tp - lag(tp) OVER ({W}) AS up, tp * volume AS flow FROM a), final AS (SELECT *, {fullw('sum(CASE WHEN up > 0 THEN flow ELSE 0 END)', 'up', 5)} AS x, {fullw('sum(CASE WHEN up < 0 THEN flow ELSE 0 END)', 'up', 5)} AS y FROM b)",
    r("CASE WHEN x + y IS NULL THEN NULL WHEN x + y = 0 THEN 50 ELSE 100 * x / (x + y) END", "mfi"),
)
def money_flow_index(spark, sf_dir):
    return pick(ind.money_flow_index(bars(spark, sf_dir)), "mfi")


@over_bars(
    "keltner_simple",
    f"a AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM bars), final AS (SELECT *, {fullw('avg(close)', 'close', 5)} AS m, {fullw('avg(tr)', 'tr', 5)} AS t FROM a)",
    f"{r('m', 'middle')}, {r('m + 1.5 * t', 'upper')}, {r('m - 1.5 * t', 'lower')}",
)
def keltner_simple(spark, sf_dir):
    return pick(ind.keltner_simple(bars(spark, sf_dir)), "middle", "upper", "lower")


@over_ticks(
    "vol_filter",
    f"a AS (SELECT *, {RET} AS x FROM ticks), b AS (SELECT *, {fullw('stddev_samp(x)', 'x', 5)} AS v FROM a), final AS (SELECT *, {fullw('avg(v)', 'v', 20)} AS vm FROM b)",
    f"{r('v', 'vol')}, {r('vm', 'vol_mean')}, coalesce(v <= 1.5 * vm, false) AS calm",
)
def vol_filter(spark, sf_dir):
    return pick(ind.volatility_filter(ticks(spark, sf_dir)), "vol", "vol_mean", "calm")


@over_ticks(
    "composite_signal",
    BOLL.replace("final AS", "b AS")
    + f""", final AS (SELECT *, 0.5 * coalesce(sign(price / nullif(lag(price, 5) OVER ({W}), 0) - 1), 0) + 0.3 * coalesce(sign({fullw('avg(price)', 'price', 3)} - {fullw('avg(price)', 'price', 8)}), 0)
 + 0.2 * {three('b.b < 0.2', 'b.b > 0.8')} AS sc FROM b)""",
    f"{r('sc', 'score')}, {three('sc > 0.3', 'sc < -0.3')} AS signal",
)
def composite_signal(spark, sf_dir):
    return pick(ind.composite_signal(ticks(spark, sf_dir)), "score", "signal")


@over_ticks("trailing_stop", f"a AS (SELECT *, max(price * 0.9) OVER ({W} ROWS UNBOUNDED PRECEDING) AS st FROM ticks), final AS (SELECT *, lag(st) OVER ({W}) AS p FROM a)", f"{r('st', 'stop')}, coalesce(price <= p, false) AS hit")
def trailing_stop(spark, sf_dir):
    return pick(ind.trailing_stop(ticks(spark, sf_dir)), "stop", "hit")


@over_ticks(
    "rsi_divergence",
    rsi_steps(5).replace("final AS", "c AS")
    + f", final AS (SELECT *, {fullw('min(price)', 'price', 10)} AS pl, {fullw('max(price)', 'price', 10)} AS ph, {fullw('min(rsi0)', 'rsi0', 10)} AS rl, {fullw('max(rsi0)', 'rsi0', 10)} AS rh FROM c)",
    f"{three('price <= pl AND rsi0 > rl', 'price >= ph AND rsi0 < rh')} AS divergence",
)
def rsi_divergence(spark, sf_dir):
    return pick(ind.divergence(ticks(spark, sf_dir)), "divergence")


@over_ticks(
    "mean_reversion",
    f"a AS (SELECT *, {fullw('avg(price)', 'price', 10)} AS m, {fullw('stddev_samp(price)', 'price', 10)} AS s FROM ticks), final AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE (price - m) / s END AS z FROM a)",
    f"{r('z', 'zscore')}, {three('z < -1', 'z > 1')} AS signal",
)
def mean_reversion(spark, sf_dir):
    return pick(ind.mean_reversion(ticks(spark, sf_dir)), "zscore", "signal")


@over_bars(
    "pivot_points",
    f"a AS (SELECT *, lag(high) OVER ({W}) AS h, lag(low) OVER ({W}) AS l, lag(close) OVER ({W}) AS c FROM bars), final AS (SELECT *, (h + l + c) / 3 AS p FROM a)",
    f"{r('p', 'pivot')}, {r('2 * p - l', 'r1')}, {r('2 * p - h', 's1')}, {r('p + h - l', 'r2')}, {r('p - h + l', 's2')}",
)
def pivot_points(spark, sf_dir):
    return pick(ind.pivot_points(bars(spark, sf_dir)), "pivot", "r1", "s1", "r2", "s2")


@register("prediction_signal", "SELECT d.doc_id, CASE WHEN l.quality * 0.8 + 0.1 > 0.6 THEN 1 WHEN l.quality * 0.8 + 0.1 < 0.4 THEN -1 ELSE 0 END AS signal FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def prediction_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buy, sell or hold from a predicted probability; a missing prediction holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") * 0.8 + 0.1).alias("p"))
    return docs.join(labels, "doc_id", "left").select("doc_id", ind.three_way(F.col("p") > 0.6, F.col("p") < 0.4).alias("signal"))
