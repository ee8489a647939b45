"""Cost, schedule, sizing, rebalancing, pair and signal-quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantspark.frames import Series, TICKS, ratio, rounded, simple_return
from quantspark.operators import execution as ex
from quantspark.operators import indicators as ind
from quantspark.operators import risk
from quantspark.plans.indicator_queries import RET, W, fullw, over_ticks, pick, r, rows
from quantspark.plans.registry import register
from quantspark.plans.report_queries import returns
from quantspark.plans.series_queries import SOFAR
from quantspark.sources.tables import TICKS_SQL, TRADES_SQL, ticks, trades, weights, weights_sql

ORDERS_SQL = "o AS (SELECT o_orderkey AS id, o_totalprice AS size, 1e6 + o_custkey * 1000.0 AS adv, 2.0 + o_custkey % 7 AS spread, CASE WHEN o_custkey % 5 <> 0 THEN 0.01 * (1 + o_custkey % 4) END AS vol FROM orders)"


def orders(spark, sf_dir):
    rows_ = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = F.col("o_custkey")
    return rows_.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("order_size"),
        (1e6 + c * 1000.0).alias("avg_daily_volume"),
        (2.0 + c % 7).cast("double").alias("spread_bps"),
        F.when(c % 5 != 0, 0.01 * (1 + c % 4)).alias("volatility"),
    )


@register(
    "transaction_costs",
    f"WITH {ORDERS_SQL}, a AS (SELECT *, size / adv AS p FROM o), b AS (SELECT *, coalesce(1e4 * 0.1 * vol * sqrt(p), 0) AS i FROM a) SELECT id, {r('p', 'participation')}, {r('i', 'impact_bps')}, {r('1 + spread / 2 + i', 'total_bps')}, round(size * (1 + spread / 2 + i) / 1e4, 2) + 0.0 AS cost FROM b",
)
def transaction_costs(spark, sf_dir):
    out = ex.transaction_costs(orders(spark, sf_dir)).withColumn("cost", F.round("cost", 2))
    return rounded(out.select("id", "participation", "impact_bps", "total_bps", "cost"))


@register(
    "execution_schedule",
    "SELECT o_orderkey AS id, CAST(k AS INTEGER) AS slice, round(pow(0.8, k) / (1 + 0.8 + 0.64 + 0.512), 6) + 0.0 AS share, round(o_totalprice * pow(0.8, k) / (1 + 0.8 + 0.64 + 0.512), 4) + 0.0 AS slice_size FROM orders, range(4) t(k)",
)
def execution_schedule(spark, sf_dir):
    out = ex.execution_schedule(orders(spark, sf_dir), "id", "order_size", 4, 0.8)
    return rounded(out.withColumn("slice_size", F.round("slice_size", 4)))


@register(
    "pyramid_levels",
    "WITH a AS (SELECT p_partkey AS id, CAST(k AS INTEGER) AS level, p_retailprice * (1 + 0.02 * k) AS p, p_size * pow(0.5, k) AS q FROM part, range(3) t(k)) SELECT id, level, round(p, 6) + 0.0 AS level_price, round(q, 6) + 0.0 AS level_size, round(sum(p * q) OVER w / sum(q) OVER w, 6) + 0.0 AS average_entry FROM a WINDOW w AS (PARTITION BY id ORDER BY level ROWS UNBOUNDED PRECEDING)",
)
def pyramid_levels(spark, sf_dir):
    rows_ = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return rounded(ex.pyramid_levels(rows_, "id", "p_retailprice", "p_size"))


@over_ticks(
    "volatility_sizing",
    f"a AS (SELECT *, {RET} AS x FROM ticks), v AS (SELECT *, {fullw('stddev_samp(x)', 'x', 10)} AS v FROM a), final AS (SELECT *, lag(v) OVER ({W}) AS p FROM v)",
    r("CASE WHEN p IS NULL THEN NULL WHEN p = 0 THEN 2 ELSE least(2, 0.5 / p) END", "size"),
)
def volatility_sizing(spark, sf_dir):
    return pick(ex.target_volatility_size(returns(spark, sf_dir), TICKS, "ret", 10, 0.5), "size")


SIDES = f"{weights_sql('c', 'customer', 'c')}, {weights_sql('s', 'supplier', 's')}"


@register(
    "rebalance_trades",
    f"WITH {SIDES}, a AS (SELECT nation, coalesce(c.weight, 0) AS x, coalesce(s.weight, 0) AS y FROM c FULL JOIN s USING (nation)) SELECT nation, {r('x', 'current')}, {r('y', 'target')}, round((y - x) * 1000, 4) + 0.0 AS trade, CASE WHEN y > x THEN 'buy' ELSE 'sell' END AS side, CAST(row_number() OVER (ORDER BY abs(y - x) DESC, nation) AS INTEGER) AS rank FROM a WHERE abs(y - x) > 0.01",
)
def rebalance_trades(spark, sf_dir):
    out = ex.rebalance_trades(weights(spark, sf_dir, "customer", "c"), weights(spark, sf_dir, "supplier", "s"), "nation", 1000.0, 0.01)
    return rounded(out.withColumn("trade", F.round("trade", 4)))


@register(
    "turnover",
    f"""WITH {TRADES_SQL}, v AS (SELECT year(ts) AS period, symbol, sum(price) AS x FROM trades GROUP BY 1, 2), w AS (SELECT period, symbol, x / sum(x) OVER (PARTITION BY period) AS weight FROM v), o AS (SELECT period, row_number() OVER (ORDER BY period) AS k FROM (SELECT DISTINCT period FROM w)),
n AS (SELECT k, symbol, weight FROM w JOIN o USING (period)), b AS (SELECT k + 1 AS k, symbol, weight AS before FROM n), f AS (SELECT k, sum(abs(coalesce(weight, 0) - coalesce(before, 0))) / 2 AS t FROM n FULL JOIN b USING (k, symbol) GROUP BY 1)
SELECT CAST(period AS INTEGER) AS period, {r('t', 'turnover')} FROM f JOIN o USING (k) WHERE k > 1""",
)
def turnover(spark, sf_dir):
    values = trades(spark, sf_dir).groupBy(F.year("ts").alias("period"), "symbol").agg(F.sum("price").alias("x"))
    shares = values.withColumn("weight", F.col("x") / F.sum("x").over(Window.partitionBy("period"))).drop("x")
    return rounded(ex.turnover(shares, "period", "symbol"))


PAIR_SQL = """q AS (SELECT CAST(ts AS DATE) AS ts, avg(value) FILTER (event_type = 'click') AS y, avg(value) FILTER (event_type = 'view') AS x FROM events GROUP BY 1)"""


def pair(spark, sf_dir):
    rows_ = ticks(spark, sf_dir).groupBy(F.to_date("ts").alias("ts")).agg(F.avg(F.when(F.col("kind") == "click", F.col("price"))).alias("y"), F.avg(F.when(F.col("kind") == "view", F.col("price"))).alias("x"))
    return rows_.withColumn("pair", F.lit("click-view"))


@register(
    "hedge_ratio",
    f"WITH {PAIR_SQL}, f AS (SELECT regr_slope(y, x) AS h, regr_intercept(y, x) AS i, corr(y, x) AS c FROM q) SELECT 'click-view' AS pair, {r('max(h)', 'hedge')}, {r('max(i)', 'intercept')}, {r('max(c)', 'corr')}, {r('stddev_samp(y - h * x - i)', 'spread_std')} FROM q, f",
)
def hedge_ratio(spark, sf_dir):
    return rounded(ex.hedge_ratio(pair(spark, sf_dir), ["pair"], "y", "x"))


P8 = "(ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"


@register(
    "pair_signal",
    f"""WITH {PAIR_SQL}, a AS (SELECT *, CASE WHEN count(*) FILTER (y IS NOT NULL AND x IS NOT NULL) OVER {P8} = 8 THEN regr_slope(y, x) OVER {P8} END AS h FROM q), b AS (SELECT *, y - h * x AS s FROM a),
z AS (SELECT *, CASE WHEN count(s) OVER {P8} = 8 THEN (s - avg(s) OVER {P8}) / stddev_samp(s) OVER {P8} END AS z FROM b) SELECT CAST(ts AS VARCHAR) AS day, {r('h', 'hedge')}, {r('s', 'spread')}, {r('z', 'zscore')}, CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 ELSE 0 END AS signal FROM z""",
)
def pair_signal(spark, sf_dir):
    out = ex.pair_signal(pair(spark, sf_dir), Series(key=("pair",), order=("ts",)), "y", "x", 8)
    return rounded(out.select(F.col("ts").cast("string").alias("day"), "hedge", "spread", "zscore", "signal"))


MOM = f"m AS (SELECT *, price / nullif(lag(price, 5) OVER ({W}), 0) - 1 AS m FROM ticks), sg AS (SELECT *, CASE WHEN m > 0.1 THEN 1 WHEN m < -0.1 THEN -1 ELSE 0 END AS signal FROM m)"


def signals(spark, sf_dir):
    return ind.momentum(ticks(spark, sf_dir))


@register(
    "signal_backtest",
    f"""WITH {TICKS_SQL}, {MOM}, p AS (SELECT *, coalesce(lag(signal) OVER ({W}), 0) AS position FROM sg), n AS (SELECT *, position * coalesce({RET}, 0) - 0.0005 * abs(position - coalesce(lag(position) OVER ({W}), 0)) AS net FROM p)
SELECT asset, tie, CAST(position AS DOUBLE) AS position, {r('net', 'net')}, round(product(1 + greatest(least(net, 0.5), -0.5)) OVER {SOFAR}, 6) + 0.0 AS capped FROM n""",
)
def signal_backtest(spark, sf_dir):
    rows_ = ex.signal_backtest(signals(spark, sf_dir), TICKS, "signal", "price")
    capped = F.product(1 + F.greatest(F.least(F.col("net"), F.lit(0.5)), F.lit(-0.5))).over(TICKS.so_far())
    return pick(rows_.withColumn("capped", capped), "position", "net", "capped")


@register(
    "signal_quality",
    f"""WITH {TICKS_SQL}, {MOM}, a AS (SELECT *, lead(price) OVER ({W}) / nullif(price, 0) - 1 AS o FROM sg) SELECT kind, count(*) AS n, CAST(sum(CASE WHEN signal <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS signals, {r('sum(CASE WHEN signal <> 0 AND sign(signal) = sign(o) THEN 1.0 ELSE 0 END) / sum(CASE WHEN signal <> 0 THEN 1 ELSE 0 END)', 'accuracy')},
{r('sum(CASE WHEN signal > 0 AND o > 0 THEN 1.0 ELSE 0 END) / sum(CASE WHEN signal > 0 THEN 1 ELSE 0 END)', 'precision_up')}, {r('sum(CASE WHEN signal > 0 AND o > 0 THEN 1.0 ELSE 0 END) / sum(CASE WHEN o > 0 THEN 1 ELSE 0 END)', 'recall_up')}, {r('avg(CASE WHEN signal <> 0 THEN sign(signal) * o END)', 'mean_edge')} FROM a WHERE o IS NOT NULL GROUP BY 1""",
)
def signal_quality(spark, sf_dir):
    rows_ = signals(spark, sf_dir).withColumn("o", ratio(F.lead("price").over(TICKS.window()), F.col("price")) - 1)
    return rounded(ex.signal_quality(rows_, ["kind"], "signal", "o"))


@register(
    "signal_decay",
    " UNION ALL ".join(f"SELECT * FROM (WITH {TICKS_SQL}, {MOM}, b AS (SELECT *, {RET} AS x FROM sg), a AS (SELECT signal, CASE WHEN count(x) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN sum(x) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS f FROM b) SELECT {h} AS horizon, count(*) AS n, {r('corr(CAST(signal AS DOUBLE), f)', 'ic')} FROM a WHERE f IS NOT NULL)" for h in (1, 3, 5)),
)
def signal_decay(spark, sf_dir):
    return rounded(ex.signal_decay(signals(spark, sf_dir).withColumn("ret", simple_return("price", TICKS)), TICKS, "signal", "ret", (1, 3, 5)))


@over_ticks("confirmed_signal", f"{MOM}, final AS (SELECT *, min(signal) OVER {rows(3)} = max(signal) OVER {rows(3)} AND count(signal) OVER {rows(3)} = 3 AS ok FROM sg)", "CASE WHEN ok THEN signal ELSE 0 END AS confirmed")
def confirmed_signal(spark, sf_dir):
    return pick(ex.confirmed_signal(signals(spark, sf_dir), TICKS, "signal", 3), "confirmed")


@over_ticks("signal_cooldown", f"{MOM}, final AS (SELECT *, coalesce(sum(CASE WHEN signal <> 0 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS k FROM sg)", "CASE WHEN k = 0 THEN signal ELSE 0 END AS cooled")
def signal_cooldown(spark, sf_dir):
    return pick(ex.cooldown(signals(spark, sf_dir), TICKS, "signal", 3), "cooled")


@over_ticks(
    "rolling_hit_rate",
    f"{MOM}, a AS (SELECT *, CASE WHEN {RET} IS NOT NULL THEN CASE WHEN sign(signal) = sign({RET}) THEN 1.0 ELSE 0.0 END END AS h FROM sg), final AS (SELECT *, {fullw('avg(h)', 'h', 10)} AS x FROM a)",
    r("x", "hit_rate"),
)
def rolling_hit_rate(spark, sf_dir):
    return pick(ex.rolling_hit_rate(risk.with_returns(signals(spark, sf_dir)), TICKS, "signal", "ret", 10), "hit_rate")


@register("kelly_fraction", f"WITH {TRADES_SQL}, a AS (SELECT symbol, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS w, avg(CASE WHEN pnl > 0 THEN pnl END) / avg(CASE WHEN pnl < 0 THEN -pnl END) AS p FROM trades GROUP BY 1) SELECT symbol, {r('greatest(0, 0.5 * (w - (1 - w) / p))', 'kelly')} FROM a")
def kelly_fraction(spark, sf_dir):
    out = risk.trade_report(trades(spark, sf_dir), ["symbol"])
    return rounded(out.select("symbol", ex.kelly_fraction(F.col("win_rate"), F.col("payoff")).alias("kelly")))
