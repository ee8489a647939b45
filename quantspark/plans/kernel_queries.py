"""Queries of the sequential kernels; their SQL folds the list of all rows so far."""

from __future__ import annotations

from quantspark.frames import TICKS
from quantspark.functions import kernels as k
from quantspark.operators.indicators import composite_signal
from quantspark.plans.indicator_queries import BOLL, RET, W, fullw, over_bars, over_ticks, pick, r, three
from quantspark.plans.registry import register
from quantspark.plans.report_queries import returns
from quantspark.plans.series_queries import SOFAR
from quantspark.sources.tables import TICKS_SQL, bars, ticks


def fold(x: str, alpha: float, where: str = "") -> str:
    """Exponential mean of x over the rows so far, nulls skipped."""
    return f"list_reduce(list({x}) FILTER ({where or f'{x} IS NOT NULL'}) OVER {SOFAR}, lambda a, b: a * {1 - alpha!r} + b * {alpha!r})"


@over_ticks("ema", f"final AS (SELECT *, {fold('price', 2 / 11)} AS e FROM ticks)", r("e", "ema"))
def ema(spark, sf_dir):
    return pick(k.ema(ticks(spark, sf_dir)), "ema")


MACD = f"a AS (SELECT *, {fold('price', 2 / 13)} - {fold('price', 2 / 27)} AS m FROM ticks), final AS (SELECT *, {fold('m', 0.2)} AS s FROM a)"


@over_ticks("macd", MACD, f"{r('m', 'macd')}, {r('s', 'macd_signal')}, {r('m - s', 'macd_hist')}")
def macd(spark, sf_dir):
    return pick(k.macd(ticks(spark, sf_dir)), "macd", "macd_signal", "macd_hist")


@over_ticks(
    "macd_cross",
    MACD.replace("final AS", "b AS") + f", final AS (SELECT *, lag(round(m - s, 9)) OVER ({W}) AS p, round(m - s, 9) AS g FROM b)",
    "CASE WHEN g > 0 AND p <= 0 THEN 1 WHEN g < 0 AND p >= 0 THEN -1 ELSE 0 END AS signal",
)
def macd_cross(spark, sf_dir):
    return pick(k.macd_cross(ticks(spark, sf_dir)), "signal")


@over_ticks(
    "rsi_wilder",
    f"a AS (SELECT *, price - lag(price) OVER ({W}) AS d FROM ticks), b AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS v FROM a), final AS (SELECT *, {fold('u', 1 / 14)} AS g, {fold('v', 1 / 14)} AS l FROM b)",
    r("CASE WHEN d IS NULL THEN NULL WHEN l = 0 AND g = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END", "rsi"),
)
def rsi_wilder(spark, sf_dir):
    return pick(k.rsi_wilder(ticks(spark, sf_dir)), "rsi")


TR = f"a AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr, coalesce(high - lag(high) OVER ({W}), 0) AS up, coalesce(lag(low) OVER ({W}) - low, 0) AS dn FROM bars)"


@over_bars("atr", f"{TR}, final AS (SELECT *, {fold('tr', 1 / 14)} AS x FROM a)", r("x", "atr"))
def atr(spark, sf_dir):
    return pick(k.atr(bars(spark, sf_dir)), "atr")


@over_bars(
    "adx",
    f"""{TR}, b AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pd, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS md FROM a), c AS (SELECT *, {fold('tr', 1 / 14)} AS w, {fold('pd', 1 / 14)} AS p, {fold('md', 1 / 14)} AS m FROM b),
d AS (SELECT *, CASE WHEN w = 0 THEN 0 ELSE 100 * p / w END AS pi, CASE WHEN w = 0 THEN 0 ELSE 100 * m / w END AS mi FROM c), e AS (SELECT *, CASE WHEN pi + mi = 0 THEN 0 ELSE 100 * abs(pi - mi) / (pi + mi) END AS dx FROM d), final AS (SELECT *, {fold('dx', 1 / 14)} AS x FROM e)""",
    f"{r('pi', 'plus_di')}, {r('mi', 'minus_di')}, {r('x', 'adx')}",
)
def adx(spark, sf_dir):
    return pick(k.adx(bars(spark, sf_dir)), "plus_di", "minus_di", "adx")


@over_ticks("ewma_volatility", f"a AS (SELECT *, {RET} AS ret FROM ticks), b AS (SELECT *, ret * ret AS q FROM a), final AS (SELECT *, sqrt({fold('q', 1 - 0.94)}) AS v FROM b)", r("v", "ewma_vol"))
def ewma_volatility(spark, sf_dir):
    return pick(k.ewma_volatility(returns(spark, sf_dir)), "ewma_vol")


@over_ticks(
    "garch",
    f"""a AS (SELECT *, {RET} AS ret FROM ticks), v AS (SELECT *, var_pop(ret) OVER (PARTITION BY asset) AS v0, coalesce(list(ret * ret) FILTER (ret IS NOT NULL) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS q FROM a),
final AS (SELECT *, list_reduce(list_prepend(v0, q), lambda x, y: 1e-6 + 0.1 * y + 0.85 * x) AS g FROM v)""",
    "round(g, 5) + 0.0 AS variance",
)
def garch(spark, sf_dir):
    from pyspark.sql import functions as F

    return pick(k.garch(returns(spark, sf_dir)).withColumn("variance", F.round("variance", 5)), "variance")


def walk(rows: str, start: str, step: str) -> str:
    """State row by row: rows names (asset, i, tie, x) with i from 1, start gives the state before, step the state after
    from that (s) and the row (n)."""
    return f"WITH RECURSIVE {rows}, st AS (SELECT asset, 0::BIGINT AS i, {start} FROM (SELECT DISTINCT asset FROM n) UNION ALL SELECT n.asset, n.i, {step} FROM st s JOIN n ON n.asset = s.asset AND n.i = s.i + 1)"


NUMBERED = f"n AS (SELECT asset, row_number() OVER ({W}) AS i, tie, "
UP, DOWN = "greatest(0, s.up + n.x - 0.5)", "greatest(0, s.down - n.x - 0.5)"


@register(
    "cusum_alarms",
    walk(f"{TICKS_SQL}, {NUMBERED}coalesce((price - avg(price) OVER (PARTITION BY asset)) / nullif(stddev_samp(price) OVER (PARTITION BY asset), 0), 0) AS x FROM ticks)", "0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS alarm", f"CASE WHEN {UP} > 5 OR {DOWN} > 5 THEN 0 ELSE {UP} END, CASE WHEN {UP} > 5 OR {DOWN} > 5 THEN 0 ELSE {DOWN} END, CASE WHEN {UP} > 5 THEN 1 WHEN {DOWN} > 5 THEN -1 ELSE 0 END")
    + " SELECT n.asset, n.tie, alarm FROM st JOIN n USING (asset, i)",
)
def cusum_alarms(spark, sf_dir):
    return pick(k.cusum(ticks(spark, sf_dir)), "alarm")


@register(
    "kalman_level",
    walk(f"{TICKS_SQL}, {NUMBERED}price AS x, first_value(price) OVER ({W}) AS x0 FROM ticks)", "CAST(NULL AS DOUBLE) AS level, 1.0::DOUBLE AS spread", "coalesce(s.level, n.x0) + (s.spread + 0.001) / (s.spread + 0.101) * (n.x - coalesce(s.level, n.x0)), (s.spread + 0.001) * (1 - (s.spread + 0.001) / (s.spread + 0.101))")
    + f" SELECT n.asset, n.tie, {r('level', 'level')} FROM st JOIN n USING (asset, i)",
)
def kalman_level(spark, sf_dir):
    return pick(k.kalman_level(ticks(spark, sf_dir)), "level")


GROWN = "(s.equity * (1 + n.x))"
HIGH = f"greatest(s.peak, {GROWN})"


@register(
    "circuit_breaker",
    walk(
        f"{TICKS_SQL}, m AS (SELECT *, coalesce({RET}, 0) AS ret FROM ticks), {NUMBERED}ret AS x FROM m)",
        "1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak, 0 AS wait, true AS trading",
        f"CASE WHEN s.wait > 0 THEN s.equity ELSE {GROWN} END, CASE WHEN s.wait > 1 THEN s.peak WHEN s.wait = 1 THEN s.equity ELSE {HIGH} END, CASE WHEN s.wait > 0 THEN s.wait - 1 WHEN {GROWN} < {HIGH} * 0.8 THEN 5 ELSE 0 END, s.wait = 0",
    )
    + f" SELECT n.asset, n.tie, trading, {r('equity', 'equity')} FROM st JOIN n USING (asset, i)",
)
def circuit_breaker(spark, sf_dir):
    return pick(k.circuit_breaker(returns(spark, sf_dir)), "trading", "equity")


SCORE = BOLL.replace("final AS", "b AS") + f""", c AS (SELECT *, 0.5::DOUBLE * coalesce(sign(price / nullif(lag(price, 5) OVER ({W}), 0) - 1), 0)::DOUBLE
+ 0.3::DOUBLE * coalesce(sign({fullw('avg(price)', 'price', 3)} - {fullw('avg(price)', 'price', 8)}), 0)::DOUBLE + 0.2::DOUBLE * {three('b.b < 0.2', 'b.b > 0.8')}::DOUBLE AS sc FROM b)"""
CROSSED = "(abs(n.x) > s.next)"


@register(
    "dynamic_threshold",
    walk(
        f"{TICKS_SQL}, {SCORE}, {NUMBERED}sc AS x FROM c)",
        "0.3::DOUBLE AS next, CAST(NULL AS DOUBLE) AS level, 0 AS signal",
        f"greatest(0.0::DOUBLE, s.next + 0.05::DOUBLE * ({CROSSED}::INT::DOUBLE - 0.2::DOUBLE)), s.next, CASE WHEN {CROSSED} THEN sign(n.x)::INT ELSE 0 END",
    )
    + f" SELECT n.asset, n.tie, signal, {r('level', 'threshold')} FROM st JOIN n USING (asset, i)",
)
def dynamic_threshold(spark, sf_dir):
    return pick(k.dynamic_threshold(composite_signal(ticks(spark, sf_dir)).drop("signal"), TICKS, "score"), "signal", "threshold")
