"""Risk, trade and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, rounded
from quantspark.operators import joins as j
from quantspark.operators import risk
from quantspark.plans.indicator_queries import RET, W, fullw, over_ticks, pick, r
from quantspark.plans.registry import register
from quantspark.plans.series_queries import SOFAR
from quantspark.sources.tables import BARS_SQL, TICKS_SQL, TRADES_SQL, bars, ticks, trades, weights, weights_sql

RETURNS = f"{TICKS_SQL}, rets AS (SELECT *, {RET} AS ret FROM ticks)"
TRADES = Series(key=("symbol",), order=("ts", "okey", "line", "price", "quantity"))
TW = "PARTITION BY symbol ORDER BY ts, okey, line, price, quantity"


def returns(spark, sf_dir):
    return risk.with_returns(ticks(spark, sf_dir))


def skew(x: str) -> str:
    """Population skewness; DuckDB's own corrects for bias."""
    return f"skewness({x}) * (count({x}) - 2) / sqrt(count({x}) * (count({x}) - 1.0))"


@register(
    "risk_report",
    f"""WITH {RETURNS}, c AS (SELECT asset, quantile_cont(ret, 0.05) AS cut FROM rets GROUP BY 1), j AS (SELECT r.asset, ret, cut FROM rets r JOIN c ON r.asset = c.asset),
a AS (SELECT asset, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s, sqrt(avg(pow(least(ret, 0), 2)) FILTER (ret IS NOT NULL)) AS d, -max(cut) AS v, -avg(CASE WHEN ret <= cut THEN ret END) AS cv,
 {skew('ret')} AS sk, kurtosis_pop(ret) AS ku, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END) AS w, sum(greatest(ret, 0)) FILTER (ret IS NOT NULL) AS g, sum(greatest(-ret, 0)) FILTER (ret IS NOT NULL) AS l FROM j GROUP BY 1)
SELECT asset, n, {r('m * 252', 'annual_return')}, {r('s * sqrt(252)', 'annual_volatility')}, {r('CASE WHEN s = 0 THEN 0 ELSE m * sqrt(252) / s END', 'sharpe')},
{r('CASE WHEN d > 0 THEN least(100, m * sqrt(252) / d) WHEN m > 0 THEN 100 ELSE 0 END', 'sortino')}, {r('v', 'var')}, {r('cv', 'cvar')}, {r('sk', 'skew')}, {r('ku', 'kurt')}, {r('w', 'win_rate')}, {r('CASE WHEN l <> 0 THEN g / l END', 'omega')} FROM a""",
)
def risk_report(spark, sf_dir):
    return rounded(risk.risk_report(returns(spark, sf_dir)))


DD = f"{TICKS_SQL}, dd AS (SELECT *, max(price) OVER {SOFAR} AS peak, price / max(price) OVER {SOFAR} - 1 AS dd FROM ticks)"


@register("drawdown", f"WITH {DD} SELECT asset, tie, {r('peak', 'peak')}, {r('dd', 'drawdown')} FROM dd")
def drawdown(spark, sf_dir):
    return pick(risk.drawdowns(ticks(spark, sf_dir)), "peak", "drawdown")


@register(
    "drawdown_report",
    f"WITH {DD} SELECT asset, {r('min(dd)', 'max_drawdown')}, {r('avg(dd)', 'mean_drawdown')}, {r('sqrt(avg(pow(100 * dd, 2)))', 'ulcer')}, {r('avg(CASE WHEN dd < 0 THEN 1.0 ELSE 0.0 END)', 'under_water')} FROM dd GROUP BY 1",
)
def drawdown_report(spark, sf_dir):
    return rounded(risk.drawdown_report(ticks(spark, sf_dir)))


@register(
    "drawdown_episodes",
    f"""WITH {DD}, a AS (SELECT *, CASE WHEN dd < 0 AND NOT coalesce(lag(dd) OVER ({W}) < 0, false) THEN 1 ELSE 0 END AS n, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, tie DESC) AS back FROM dd),
b AS (SELECT *, sum(n) OVER {SOFAR} AS episode FROM a) SELECT asset, CAST(episode AS BIGINT) AS episode, count(*) AS length, {r('min(dd)', 'depth')}, NOT bool_or(back = 1) AS recovered FROM b WHERE dd < 0 GROUP BY 1, 2""",
)
def drawdown_episodes(spark, sf_dir):
    return rounded(risk.drawdown_episodes(ticks(spark, sf_dir)))


@register(
    "streaks",
    f"""WITH {TRADES_SQL}, a AS (SELECT *, sign(pnl) AS g, CASE WHEN sign(pnl) IS DISTINCT FROM lag(sign(pnl)) OVER ({TW}) THEN 1 ELSE 0 END AS c FROM trades),
b AS (SELECT *, sum(c) OVER ({TW} ROWS UNBOUNDED PRECEDING) AS run FROM a), k AS (SELECT symbol, run, max(g) AS g, count(*) AS n FROM b WHERE g <> 0 GROUP BY 1, 2)
SELECT symbol, max(CASE WHEN g > 0 THEN n END) AS longest_win, max(CASE WHEN g < 0 THEN n END) AS longest_loss, {r('avg(CASE WHEN g > 0 THEN n END)', 'mean_win_run')}, {r('avg(CASE WHEN g < 0 THEN n END)', 'mean_loss_run')} FROM k GROUP BY 1""",
)
def streaks(spark, sf_dir):
    return rounded(risk.streaks(trades(spark, sf_dir), TRADES))


@register(
    "trade_report",
    f"""WITH {TRADES_SQL}, a AS (SELECT symbol, count(pnl) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS w, avg(CASE WHEN pnl > 0 THEN pnl END) AS mw, avg(CASE WHEN pnl < 0 THEN -pnl END) AS ml,
sum(CASE WHEN pnl > 0 THEN pnl END) / sum(CASE WHEN pnl < 0 THEN -pnl END) AS pf, avg(pnl) AS e, max(pnl) AS b, min(pnl) AS x, stddev_samp(pnl) AS s FROM trades GROUP BY 1)
SELECT symbol, n, {r('w', 'win_rate')}, {r('mw', 'mean_win')}, {r('ml', 'mean_loss')}, {r('pf', 'profit_factor')}, {r('e', 'expectancy')}, {r('b', 'best')}, {r('x', 'worst')}, {r('s', 'std')}, {r('mw / ml', 'payoff')},
{r('w * mw - (1 - w) * ml', 'expectancy_by_rate')}, {r('w - (1 - w) / (mw / ml)', 'kelly')} FROM a""",
)
def trade_report(spark, sf_dir):
    return rounded(risk.trade_report(trades(spark, sf_dir), ["symbol"]))


@register(
    "monthly_report",
    f"""WITH {TRADES_SQL}, a AS (SELECT symbol, strftime(ts, '%Y-%m') AS period, sum(pnl) AS pnl, count(*) AS n FROM trades GROUP BY 1, 2)
SELECT symbol, period, {r('pnl', 'pnl')}, n, CAST(rank() OVER (PARTITION BY symbol ORDER BY round(pnl, 6) DESC) AS INTEGER) AS rank, round(sum(pnl) OVER (PARTITION BY symbol ORDER BY period ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS total FROM a""",
)
def monthly_report(spark, sf_dir):
    out = risk.period_report(trades(spark, sf_dir), ["symbol"])
    return rounded(out.withColumn("total", F.round("total", 4)))


@over_ticks(
    "rolling_risk",
    f"""a AS (SELECT *, {RET} AS x FROM ticks), final AS (SELECT *, {fullw('avg(x)', 'x', 10)} AS m, {fullw('stddev_samp(x)', 'x', 10)} AS s, {fullw('avg(pow(least(x, 0), 2))', 'x', 10)} AS d,
 {fullw('avg(CASE WHEN x > 0 THEN 1.0 WHEN x <= 0 THEN 0.0 END)', 'x', 10)} AS w, {fullw('sum(greatest(x, 0))', 'x', 10)} AS g, {fullw('sum(greatest(-x, 0))', 'x', 10)} AS l FROM a)""",
    f"{r('CASE WHEN s = 0 THEN 0 ELSE m / s END', 'roll_sharpe')}, {r('CASE WHEN d > 0 THEN m / sqrt(d) END', 'roll_sortino')}, {r('w', 'roll_win_rate')}, {r('CASE WHEN l <> 0 THEN g / l END', 'roll_profit_factor')}",
)
def rolling_risk(spark, sf_dir):
    return pick(risk.rolling_risk(returns(spark, sf_dir)), "roll_sharpe", "roll_sortino", "roll_win_rate", "roll_profit_factor")


PAST20 = f"({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
VAR = f"v AS (SELECT *, CASE WHEN count(ret) OVER {PAST20} = 20 THEN -quantile_cont(ret, 0.05) OVER {PAST20} END AS var FROM rets)"


@register("rolling_var", f"WITH {RETURNS}, {VAR} SELECT asset, tie, {r('var', 'var')}, coalesce(ret < -var, false) AS breach FROM v")
def rolling_var(spark, sf_dir):
    return pick(risk.rolling_var(returns(spark, sf_dir)), "var", "breach")


@register(
    "var_backtest",
    f"""WITH {RETURNS}, {VAR}, a AS (SELECT kind, count(*) AS n, sum(CASE WHEN ret < -var THEN 1 ELSE 0 END) AS x FROM v WHERE var IS NOT NULL GROUP BY 1)
SELECT kind, n, CAST(x AS BIGINT) AS breaches, {r('x / n', 'breach_rate')}, round(-2 * (((n - x) * ln(0.95) + x * ln(0.05)) - CASE WHEN x > 0 AND x < n THEN (n - x) * ln(1 - x / n) + x * ln(x / n) ELSE 0 END), 6) + 0.0 AS kupiec FROM a""",
)
def var_backtest(spark, sf_dir):
    return rounded(risk.var_backtest(risk.rolling_var(returns(spark, sf_dir)), ["kind"]))


@register(
    "tail_report",
    f"""WITH {RETURNS}, c AS (SELECT asset, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM rets GROUP BY 1)
SELECT r.asset, {r('max(lo)', 'low')}, {r('max(hi)', 'high')}, {r('avg(CASE WHEN ret <= lo THEN ret END)', 'mean_low')}, {r('avg(CASE WHEN ret >= hi THEN ret END)', 'mean_high')},
{r('sum(ret) / nullif(sum(greatest(-ret, 0)) FILTER (ret IS NOT NULL), 0)', 'gain_to_pain')}, {r('abs(max(hi) / max(lo))', 'tail_ratio')} FROM rets r JOIN c ON r.asset = c.asset GROUP BY 1""",
)
def tail_report(spark, sf_dir):
    return rounded(risk.tail_report(returns(spark, sf_dir), ["asset"]))


Z = -1.6448536269514722


@register(
    "cornish_fisher",
    f"""WITH {RETURNS}, a AS (SELECT asset, avg(ret) AS m, stddev_samp(ret) AS s, {skew('ret')} AS g, kurtosis_pop(ret) AS k FROM rets GROUP BY 1)
SELECT asset, {r(f'-(m + ({Z} + ({Z**2 - 1}) * g / 6 + ({Z**3 - 3 * Z}) * k / 24 - ({2 * Z**3 - 5 * Z}) * g * g / 36) * s)', 'modified_var')} FROM a""",
)
def cornish_fisher(spark, sf_dir):
    return rounded(risk.cornish_fisher(returns(spark, sf_dir), ["asset"]))


@register(
    "mtf_asof",
    f"""WITH {TICKS_SQL}, p AS (SELECT asset, ts, tie, price FROM ticks WHERE kind = 'purchase'), q AS (SELECT asset, ts, tie, price FROM ticks WHERE kind <> 'purchase')
SELECT p.asset, p.tie, {r('q.price', 'asof_price')} FROM p ASOF LEFT JOIN q ON p.asset = q.asset AND p.ts >= q.ts""",
)
def mtf_asof(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    left = rows.where("kind = 'purchase'").select("asset", "ts", "tie", "price")
    right = rows.where("kind <> 'purchase'").select("asset", "ts", F.col("tie").alias("rtie"), "price")
    return rounded(j.as_of(left, right, ["asset"], "ts", ["price"], ["rtie"]).select("asset", "tie", "asof_price"))


SIDES = f"{weights_sql('c', 'customer', 'c')}, {weights_sql('s', 'supplier', 's')}"


@register(
    "weight_drift",
    f"WITH {SIDES} SELECT nation, {r('coalesce(c.weight, 0)', 'current')}, {r('coalesce(s.weight, 0)', 'target')}, {r('coalesce(c.weight, 0) - coalesce(s.weight, 0)', 'drift')}, {r('abs(coalesce(c.weight, 0) - s.weight) / s.weight', 'relative_drift')} FROM c FULL JOIN s USING (nation)",
)
def weight_drift(spark, sf_dir):
    return rounded(j.weight_drift(weights(spark, sf_dir, "customer", "c"), weights(spark, sf_dir, "supplier", "s"), "nation"))


@register(
    "brinson_attribution",
    f"""WITH {SIDES}, a AS (SELECT nation, coalesce(c.weight, 0) AS wp, CASE WHEN c.weight IS NULL THEN 0 ELSE nation * 0.01 + 0.02 END AS rp, coalesce(s.weight, 0) AS wb, CASE WHEN s.weight IS NULL THEN 0 ELSE 0.05 - nation * 0.002 END AS rb FROM c FULL JOIN s USING (nation)),
t AS (SELECT sum(wb * rb) AS total FROM a) SELECT nation, {r('(wp - wb) * (rb - total)', 'allocation')}, {r('wb * (rp - rb)', 'selection')}, {r('(wp - wb) * (rp - rb)', 'interaction')} FROM a, t""",
)
def brinson_attribution(spark, sf_dir):
    p = weights(spark, sf_dir, "customer", "c").withColumn("ret", F.col("nation") * 0.01 + 0.02)
    b = weights(spark, sf_dir, "supplier", "s").withColumn("ret", F.lit(0.05) - F.col("nation") * 0.002)
    return rounded(j.brinson(p, b, "nation"))


DAILY = f"{BARS_SQL}, daily AS (SELECT asset, ts, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS ret FROM bars)"


def daily(spark, sf_dir):
    return risk.with_returns(bars(spark, sf_dir), TICKS, "close").select("asset", "ts", "ret")


@register(
    "pair_correlation",
    f"""WITH {DAILY} SELECT x.asset AS a, y.asset AS b, count(*) AS n, {r('corr(x.ret, y.ret)', 'corr')}, {r('covar_samp(x.ret, y.ret)', 'cov')}, {r('regr_slope(y.ret, x.ret)', 'beta')}
FROM daily x JOIN daily y ON x.ts = y.ts AND x.asset < y.asset WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def pair_correlation(spark, sf_dir):
    return rounded(j.pair_correlation(daily(spark, sf_dir).where("ret is not null"), "asset", "ts", "ret"))


@register(
    "spearman",
    f"""WITH {TRADES_SQL}, k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY quantity) + (count(*) OVER (PARTITION BY symbol, quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY pnl) + (count(*) OVER (PARTITION BY symbol, pnl) - 1) / 2.0 AS b FROM trades)
SELECT symbol, count(*) AS n, {r('corr(a, b)', 'spearman')} FROM k GROUP BY 1""",
)
def spearman(spark, sf_dir):
    return rounded(j.spearman(trades(spark, sf_dir), ["symbol"], "quantity", "pnl"))


@register(
    "lead_lag",
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {DAILY}, a AS (SELECT asset, ret, lead(ret, {k}) OVER (PARTITION BY asset ORDER BY ts) AS y FROM daily) SELECT asset, {k} AS lag, count(*) AS n, {r('corr(ret, y)', 'corr')} FROM a WHERE ret IS NOT NULL AND y IS NOT NULL GROUP BY 1)" for k in (1, 2, 3)
    ),
)
def lead_lag(spark, sf_dir):
    return rounded(j.lead_lag(daily(spark, sf_dir), Series(order=("ts",)), "ret", "ret", (1, 2, 3)))


MARKET = f"{DAILY}, m AS (SELECT ts, avg(ret) AS market FROM daily GROUP BY 1), d AS (SELECT daily.*, market FROM daily JOIN m USING (ts))"
N10 = "(PARTITION BY asset ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


def against_market(spark, sf_dir):
    rows = daily(spark, sf_dir)
    return rows.join(rows.groupBy("ts").agg(F.avg("ret").alias("market")), "ts")


@register(
    "rolling_beta",
    f"WITH {MARKET} SELECT asset, CAST(ts AS VARCHAR) AS day, " + ", ".join(r(f"CASE WHEN count(ret) OVER {N10} = 10 THEN {f}(ret, market) OVER {N10} END", n) for f, n in (("regr_slope", "beta"), ("regr_intercept", "alpha"), ("corr", "corr"))) + " FROM d",
)
def rolling_beta(spark, sf_dir):
    out = j.rolling_beta(against_market(spark, sf_dir), Series(order=("ts",)), "ret", "market", 10)
    return rounded(out.select("asset", F.col("ts").cast("string").alias("day"), "beta", "alpha", "corr"))


@register(
    "benchmark_report",
    f"""WITH {MARKET} SELECT asset, count(*) AS n, {r('regr_slope(ret, market)', 'beta')}, {r('regr_intercept(ret, market)', 'alpha')}, {r('corr(ret, market)', 'corr')}, {r('stddev_samp(ret - market)', 'tracking_error')}, {r('avg(ret - market) / stddev_samp(ret - market)', 'information_ratio')},
{r('avg(CASE WHEN market > 0 THEN ret END) / avg(CASE WHEN market > 0 THEN market END)', 'up_capture')}, {r('avg(CASE WHEN market < 0 THEN ret END) / avg(CASE WHEN market < 0 THEN market END)', 'down_capture')} FROM d WHERE ret IS NOT NULL AND market IS NOT NULL GROUP BY 1""",
)
def benchmark_report(spark, sf_dir):
    return rounded(j.benchmark_report(against_market(spark, sf_dir), ["asset"], "ret", "market"))


@register(
    "event_window",
    f"""WITH {RETURNS}, p AS (SELECT *, row_number() OVER ({W}) AS p FROM rets), e AS (SELECT asset, p AS e FROM p WHERE kind = 'error')
SELECT CAST(p.p - e.e AS INTEGER) AS "offset", count(*) AS n, {r('avg(p.ret)', 'mean')} FROM e JOIN p ON p.asset = e.asset AND p.p BETWEEN e.e - 2 AND e.e + 3 GROUP BY 1""",
)
def event_window(spark, sf_dir):
    rows = returns(spark, sf_dir)
    return rounded(j.event_window(rows, rows.where("kind = 'error'"), TICKS, "ret", 2, 3).withColumn("offset", F.col("offset").cast("int")))
