"""Queries of volatility, co-movement, breaches, signals and trading habits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, ratio, rounded
from quantspark.functions import kernels
from quantspark.operators import diagnostics as dg
from quantspark.operators import risk
from quantspark.plans.execution_queries import MOM, signals
from quantspark.plans.indicator_queries import W, fullw, over_bars, pick, r
from quantspark.plans.kernel_queries import NUMBERED, walk
from quantspark.plans.registry import register
from quantspark.plans.report_queries import DAILY, DD, MARKET, RETURNS, TRADES, TW, VAR, against_market, daily, returns
from quantspark.plans.text_queries import cdf
from quantspark.sources.tables import TICKS_SQL, TRADES_SQL, bars, ticks, trades


@over_bars(
    "range_volatility",
    "a AS (SELECT *, pow(ln(high / nullif(low, 0)), 2) / (4 * ln(2)) AS p, 0.5 * pow(ln(high / nullif(low, 0)), 2) - (2 * ln(2) - 1) * pow(ln(nullif(close, 0) / nullif(open, 0)), 2) AS g FROM bars), "
    f"final AS (SELECT *, {fullw('avg(p)', 'p', 5)} AS pv, {fullw('avg(g)', 'g', 5)} AS gv FROM a)",
    f"{r('sqrt(pv * 252)', 'parkinson')}, {r('CASE WHEN gv >= 0 THEN sqrt(gv * 252) END', 'garman_klass')}",
)
def range_volatility(spark, sf_dir):
    return pick(dg.range_volatility(bars(spark, sf_dir), n=5), "parkinson", "garman_klass")


@register(
    "volatility_cone",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH {RETURNS}, v AS (SELECT *, {fullw('stddev_samp(ret)', 'ret', n)} * sqrt(252) AS vol FROM rets)
SELECT asset, {n} AS "window", {r('arg_max(vol, (ts, tie))', 'current')}, {r('min(vol)', 'lowest')}, {r('quantile_cont(vol, 0.25)', 'q25')}, {r('median(vol)', 'median')}, {r('quantile_cont(vol, 0.75)', 'q75')}, {r('max(vol)', 'highest')} FROM v WHERE vol IS NOT NULL GROUP BY 1)"""
        for n in (5, 10, 21)
    ),
)
def volatility_cone(spark, sf_dir):
    return rounded(dg.volatility_cone(returns(spark, sf_dir)))


@register(
    "runs_test",
    f"""WITH {TRADES_SQL}, a AS (SELECT symbol, CAST(pnl > 0 AS INT) AS w, CASE WHEN (pnl > 0) IS DISTINCT FROM lag(pnl > 0) OVER ({TW}) THEN 1 ELSE 0 END AS c FROM trades), b AS (SELECT symbol, count(*) AS n, sum(w) AS wins, sum(c) AS runs FROM a GROUP BY 1),
v AS (SELECT *, 2.0::DOUBLE * wins * (n - wins) AS m FROM b), s AS (SELECT *, m * (m - n) / (n::DOUBLE * n * (n - 1)) AS sp FROM v), z AS (SELECT *, CASE WHEN sp > 0 THEN (runs - (m / n + 1)) / sqrt(sp) ELSE 0 END AS z FROM s)
SELECT symbol, n, CAST(wins AS BIGINT) AS wins, CAST(runs AS BIGINT) AS runs, {r('z', 'z')}, {r(f"CASE WHEN sp > 0 THEN 2 * (1 - {cdf('abs(z)')}) ELSE 1 END", 'p')} FROM z""",
)
def runs_test(spark, sf_dir):
    return rounded(dg.runs_test(trades(spark, sf_dir), TRADES, "pnl"))


def _side(test: str, name: str) -> str:
    at = f"FILTER (WHERE {test})"
    beta = r(f"CASE WHEN count(*) {at} >= 10 AND var_samp(market) {at} >= 1e-18 THEN regr_slope(ret, market) {at} END", f"{name}_beta")
    return f"{beta}, {r(f'CASE WHEN count(*) {at} = 0 OR product(1 + market) {at} = 1 THEN 100 ELSE 100 * (product(1 + ret) {at} - 1) / (product(1 + market) {at} - 1) END', f'{name}_capture')}"


@register(
    "co_moments",
    f"""WITH {MARKET}, k AS (SELECT *, ret - avg(ret) OVER (PARTITION BY asset) AS x, market - avg(market) OVER (PARTITION BY asset) AS y FROM d WHERE ret IS NOT NULL AND market IS NOT NULL)
SELECT asset, count(*) AS n, {_side('market < 0', 'down')}, {_side('market > 0', 'up')}, {r('avg(x * y * y) / (stddev_samp(ret) * pow(stddev_samp(market), 2))', 'coskewness')}, {r('avg(x * y * y * y) / (stddev_samp(ret) * pow(stddev_samp(market), 3))', 'cokurtosis')} FROM k GROUP BY 1""",
)
def co_moments(spark, sf_dir):
    return rounded(dg.co_moments(against_market(spark, sf_dir), ["asset"], "ret", "market"))


def _likely(stay: str, go: str, p: str) -> str:
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN {stay} * ln(1 - {p}) + {go} * ln({p}) ELSE 0 END"


@register(
    "breach_independence",
    f"""WITH {RETURNS}, {VAR}, b AS (SELECT asset, ts, tie, ret < -var AS b FROM v WHERE var IS NOT NULL), l AS (SELECT asset, b, lag(b) OVER ({W}) AS a FROM b),
c AS (SELECT asset, count(*) AS n, sum(b::INT)::DOUBLE AS x, count(*) FILTER (NOT a AND NOT b) AS n00, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (a AND b) AS n11 FROM l GROUP BY 1 HAVING count(a) > 0),
p AS (SELECT *, CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) ELSE 0 END AS p0, CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0 END AS p1, (n01 + n11) / (n00 + n01 + n10 + n11) AS p FROM c),
q AS (SELECT *, greatest(-2 * ({_likely('n00', 'n01', 'p')} + {_likely('n10', 'n11', 'p')} - {_likely('n00', 'n01', 'p0')} - {_likely('n10', 'n11', 'p1')}), 0) AS i, -2 * (((n - x) * ln(0.95) + x * ln(0.05)) - {_likely('(n - x)', 'x', '(x / n)')}) AS k FROM p)
SELECT asset, n00, n01, n10, n11, {r('i', 'lr_independence')}, {r('i + k', 'lr_coverage')}, {r(f"2 * (1 - {cdf('sqrt(i)')})", 'p_independence')}, {r('least(exp(-(i + k) / 2), 1)', 'p_coverage')} FROM q""",
)
def breach_independence(spark, sf_dir):
    rows = risk.rolling_var(returns(spark, sf_dir))
    # A row without a return, as after a price of zero, tells of no breach.
    return rounded(dg.breach_independence(rows.withColumn("breach", F.when(F.col("ret").isNotNull(), F.col("breach"))), TICKS))


@register(
    "signal_persistence",
    f"""WITH {TICKS_SQL}, {MOM}, a AS (SELECT *, CASE WHEN lag(signal) OVER ({W}) IS NULL THEN NULL ELSE (signal <> lag(signal) OVER ({W}))::INT END AS f FROM sg),
b AS (SELECT *, sum(coalesce(f, 1)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run, CASE WHEN count(*) OVER ({W} ROWS 9 PRECEDING) = 10 THEN sum(f) OVER ({W} ROWS 8 PRECEDING) / 9.0 END AS q FROM a),
k AS (SELECT asset, run, count(*) AS n FROM b GROUP BY 1, 2), u AS (SELECT asset, count(*) AS runs, avg(n) AS m, max(n) AS h, min(n) AS l FROM k GROUP BY 1),
t AS (SELECT asset, coalesce(avg(f), 0) AS fr, avg(q) AS qa, max(q) AS qh, min(q) AS ql FROM b GROUP BY 1)
SELECT asset, runs, {r('m', 'mean_run')}, h AS longest_run, l AS shortest_run, {r('fr', 'flip_rate')}, {r('coalesce(qa, fr)', 'mean_rate')}, {r('coalesce(qh, fr)', 'highest_rate')}, {r('coalesce(ql, fr)', 'lowest_rate')} FROM u JOIN t USING (asset)""",
)
def signal_persistence(spark, sf_dir):
    return rounded(dg.signal_persistence(signals(spark, sf_dir)))


@register(
    "trade_habits",
    f"""WITH {TRADES_SQL}, a AS (SELECT symbol, okey, line, coalesce(lag(pnl) OVER ({TW}) < 0 AND epoch_us(ts) - lag(epoch_us(ts)) OVER ({TW}) < 86400000000, false) AS revenge, count(*) OVER (PARTITION BY symbol ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM trades)
SELECT symbol, okey, line, revenge, recent, recent > 2 * avg(recent) OVER (PARTITION BY symbol) AS overtrading FROM a""",
)
def trade_habits(spark, sf_dir):
    return dg.trade_habits(trades(spark, sf_dir), TRADES).select("symbol", "okey", "line", "revenge", "recent", "overtrading")


def _scaled(value: str) -> str:
    return f"CASE WHEN x <= 0 THEN 1 WHEN x >= 0.2 THEN 0.25 ELSE {value} END"


@register(
    "drawdown_scales",
    f"""WITH {DD}, k AS (SELECT *, -dd AS x, -dd / 0.2::DOUBLE AS t FROM dd)
SELECT asset, tie, {r(_scaled('1 - t * 0.75'), 'linear')}, {r(_scaled('1 - (1 - (1 - t) * (1 - t)) * 0.75'), 'convex')}, {r(_scaled('1 - t * t * 0.75'), 'concave')}, {r('CASE WHEN x >= 0.3 THEN 0 WHEN x >= 0.2 THEN 0.1 WHEN x >= 0.15 THEN 0.3 WHEN x >= 0.1 THEN 0.5 WHEN x >= 0.05 THEN 0.8 ELSE 1 END', 'stepped')} FROM k""",
)
def drawdown_scales(spark, sf_dir):
    rows = risk.drawdowns(ticks(spark, sf_dir))
    scales = dg.drawdown_scales(-F.col("drawdown"))
    return pick(rows.withColumns(scales), *scales)


@register(
    "correlation_network",
    f"""WITH {DAILY}, p AS (SELECT x.asset AS a, y.asset AS b FROM daily x JOIN daily y ON x.ts = y.ts AND x.asset <> y.asset WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 AND abs(corr(x.ret, y.ret)) >= 0.1),
n AS (SELECT DISTINCT asset FROM daily WHERE ret IS NOT NULL), d AS (SELECT a AS asset, count(*) AS degree FROM p GROUP BY 1), t AS (SELECT x.a AS asset, count(*) // 2 AS triangles FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = y.b AND z.b = x.a GROUP BY 1)
SELECT asset, coalesce(degree, 0) AS degree, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles, {r('CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2) END', 'clustering')} FROM n LEFT JOIN d USING (asset) LEFT JOIN t USING (asset)""",
)
def correlation_network(spark, sf_dir):
    return rounded(dg.correlation_network(daily(spark, sf_dir), "asset", "ts", "ret", 0.1))


PREDICTED = f"p AS (SELECT *, price / 500 AS x, lead(price) OVER ({W}) / nullif(price, 0) - 1 AS y FROM ticks)"


def predicted(spark, sf_dir):
    """A tick's price as a share of 500 taken for the probability that the next one is higher."""
    ahead = ratio(F.lead("price").over(TICKS.window()), F.col("price")) - 1
    return ticks(spark, sf_dir).withColumns({"prob_up": F.col("price") / 500, "ret": ahead})


@register(
    "threshold_grid",
    f"""WITH {TICKS_SQL}, {PREDICTED}, g AS (SELECT unnest([0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE]) AS t), s AS (SELECT kind, t, sum(CASE WHEN x > t THEN y WHEN x < 1 - t THEN -y ELSE 0 END) AS pnl FROM p, g WHERE y IS NOT NULL GROUP BY 1, 2)
SELECT kind, t AS threshold, {r('pnl', 'pnl')}, row_number() OVER (PARTITION BY kind ORDER BY pnl DESC, t) = 1 AS best FROM s""",
)
def threshold_grid(spark, sf_dir):
    return rounded(dg.threshold_grid(predicted(spark, sf_dir), "prob_up", "ret", by=["kind"]))


WRONG = "(NOT coalesce(n.y IS NULL OR (n.x > 0.5 AND n.y > 0) OR (n.x < 0.5 AND n.y < 0), false))"
FULL = f"({WRONG} AND s.wrong = 4)"


@register(
    "threshold_policy",
    walk(
        f"{TICKS_SQL}, {PREDICTED}, {NUMBERED}x, y FROM p)",
        "0.5::DOUBLE AS next, 0 AS wrong, 0.0::DOUBLE AS total, CAST(NULL AS DOUBLE) AS level, 0 AS signal",
        f"""CASE WHEN {FULL} THEN greatest(0.2, least(0.8, 0.1::DOUBLE * (0.5::DOUBLE + (s.total + abs(n.x - 0.5::DOUBLE)) / 5) + 0.9::DOUBLE * s.next)) ELSE s.next END,
CASE WHEN {FULL} THEN 0 WHEN {WRONG} THEN s.wrong + 1 ELSE s.wrong END, CASE WHEN {FULL} THEN 0 WHEN {WRONG} THEN s.total + abs(n.x - 0.5::DOUBLE) ELSE s.total END, s.next, CASE WHEN n.x > s.next THEN 1 WHEN n.x < 1 - s.next THEN -1 ELSE 0 END""",
    )
    + f" SELECT n.asset, n.tie, signal, {r('level', 'threshold')} FROM st JOIN n USING (asset, i)",
)
def threshold_policy(spark, sf_dir):
    return pick(kernels.threshold_policy(predicted(spark, sf_dir)), "signal", "threshold")


@register(
    "risk_contributions",
    f"""WITH {DAILY}, k AS (SELECT *, (SELECT count(DISTINCT asset) FROM daily WHERE ret IS NOT NULL) AS a FROM daily WHERE ret IS NOT NULL), p AS (SELECT ts, avg(ret) AS p FROM k GROUP BY 1 HAVING count(*) = max(a)),
c AS (SELECT asset, 1 / max(a) AS w, covar_samp(ret, p) AS c, stddev_samp(p) AS s FROM k JOIN p USING (ts) GROUP BY 1)
SELECT asset, {r('w', 'weight')}, {r('CASE WHEN s = 0 THEN 0 ELSE c / s END', 'marginal')}, {r('CASE WHEN s = 0 THEN 0 ELSE w * c / s END', 'component')}, {r('CASE WHEN s = 0 THEN 0 ELSE w * c / (s * s) END', 'share')} FROM c""",
)
def risk_contributions(spark, sf_dir):
    return rounded(dg.risk_contributions(daily(spark, sf_dir)))
