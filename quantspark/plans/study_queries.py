"""Queries of event studies, filters, rebalancing and reports by size, holding time and phase."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, lag, rounded
from quantspark.operators import studies as st
from quantspark.operators import windows
from quantspark.plans.execution_queries import MOM, signals
from quantspark.plans.indicator_queries import W, fullw, over_bars, over_ticks, pick, r
from quantspark.plans.registry import register
from quantspark.plans.report_queries import DD, MARKET, RETURNS, SIDES, against_market, returns
from quantspark.sources.tables import TICKS_SQL, TRADES_SQL, bars, read, ticks, trades, weights

BY_DAY = Series(order=("ts",))


@register(
    "event_study",
    f"""WITH {MARKET}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS p FROM d WHERE ret IS NOT NULL AND market IS NOT NULL),
e AS (SELECT k.asset, k.ts, k.p, regr_intercept(o.ret, o.market) AS al, regr_slope(o.ret, o.market) AS be, stddev_samp(o.ret) AS s FROM k JOIN k o ON o.asset = k.asset AND o.p BETWEEN k.p - 9 AND k.p - 2 WHERE k.ret > 0.5 GROUP BY 1, 2, 3 HAVING count(*) > 1 AND var_samp(o.market) > 0),
x AS (SELECT e.*, o.ret - (al + be * o.market) AS a FROM e JOIN k o ON o.asset = e.asset AND o.p BETWEEN e.p - 1 AND e.p + 1)
SELECT asset, CAST(ts AS VARCHAR) AS day, count(*) AS n, {r('sum(a)', 'car')}, {r('avg(a)', 'mean')}, {r('max(a)', 'highest')}, {r('min(a)', 'lowest')}, {r('al', 'alpha')}, {r('be', 'beta')}, {r('CASE WHEN s <> 0 THEN sum(a) / (s * sqrt(count(*))) END', 't_stat')} FROM x GROUP BY asset, ts, al, be, s""",
)
def event_study(spark, sf_dir):
    rows = against_market(spark, sf_dir)
    out = st.event_study(rows, rows.where("ret > 0.5"), BY_DAY, estimate=10)
    return rounded(out.withColumn("day", F.col("ts").cast("string")).drop("ts"))


@over_bars(
    "volume_spikes",
    f"final AS (SELECT *, avg(volume) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS u FROM bars)",
    f"{r('u', 'usual')}, {r('CASE WHEN u > 0 THEN volume / u ELSE 0 END', 'volume_ratio')}, coalesce(u > 0 AND volume / u > 1.2, false) AS spike",
)
def volume_spikes(spark, sf_dir):
    return pick(st.volume_spikes(bars(spark, sf_dir), TICKS, lookback=5, times=1.2), "usual", "volume_ratio", "spike")


@over_ticks(
    "adaptive_threshold",
    f"{MOM}, v AS (SELECT *, {fullw('stddev_samp(price)', 'price', 5)} AS v FROM sg), u AS (SELECT *, {fullw('avg(v)', 'v', 10)} AS a, {fullw('stddev_samp(v)', 'v', 10)} AS s FROM v), final AS (SELECT *, coalesce(0.3 + CASE WHEN s <> 0 THEN (v - a) / s END * 0.5 * 0.3, 0.3) AS h FROM u)",
    f"{r('h', 'threshold')}, {r('CASE WHEN h <> 0 THEN abs(signal) / h END', 'strength')}, coalesce(abs(signal) > h, false) AS above",
)
def adaptive_threshold(spark, sf_dir):
    rows = windows.rolling_stats(signals(spark, sf_dir), TICKS, "price", 5)
    return pick(st.adaptive_threshold(rows, TICKS, "signal", "roll_std", n=10), "threshold", "strength", "above")


TESTS = ("price > 100", "kind <> 'error'", "signal <> 0")


def _filtered(rule: str, condition: str):
    @register(f"filtered_{rule}", f"WITH {TICKS_SQL}, {MOM} SELECT asset, tie, signal FROM sg WHERE {condition}")
    def query(spark, sf_dir):
        return st.filtered(signals(spark, sf_dir), [F.expr(t) for t in TESTS], rule).select("asset", "tie", "signal")

    return query


_filtered("all", " AND ".join(TESTS))
_filtered("any", " OR ".join(TESTS))
_filtered("majority", " + ".join(f"({t})::INT" for t in TESTS) + " >= 2")


@register(
    "turnover_parts",
    f"""WITH {SIDES}, a AS (SELECT nation, coalesce(c.weight, 0) AS b, coalesce(s.weight, 0) AS a, nation * 0.01::DOUBLE - 0.1::DOUBLE AS x FROM c FULL JOIN s USING (nation)), w AS (SELECT 1 + sum(b * x) AS w FROM a), m AS (SELECT a.*, b * (1 + x) / w AS m FROM a, w)
SELECT {r('sum(abs(a - b)) / 2', 'total')}, {r('sum(abs(m - b)) / 2', 'drift')}, {r('sum(abs(a - m)) / 2', 'rebalance')}, count(*) FILTER (b = 0 AND a > 0) AS opened, count(*) FILTER (b > 0 AND a = 0) AS closed, count(*) FILTER (b <> 0 AND a > b) AS raised, count(*) FILTER (a <> 0 AND a < b) AS cut FROM m""",
)
def turnover_parts(spark, sf_dir):
    c, s = weights(spark, sf_dir, "customer", "c"), weights(spark, sf_dir, "supplier", "s")
    moves = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") * 0.01 - 0.1).alias("ret"))
    return rounded(st.turnover_parts(c, s, moves, "nation"))


@register(
    "calendar_rebalance",
    f"""WITH t AS (SELECT * FROM (VALUES ('F', 0.5), ('O', 0.3), ('X', 0.2)) v(asset, w)), f AS (SELECT min(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY strftime(o_orderdate, '%Y-%m')),
s AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS asset, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), k AS (SELECT day, sum(v) AS k FROM s JOIN f USING (day) GROUP BY 1)
SELECT CAST(k.day AS VARCHAR) AS day, t.asset, {r('coalesce(v / k, 0)', 'current')}, {r('w', 'target')}, round((w - coalesce(v / k, 0)) * k, 4) + 0.0 AS adjustment FROM k CROSS JOIN t LEFT JOIN s ON s.day = k.day AND s.asset = t.asset""",
)
def calendar_rebalance(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("asset"), F.col("o_totalprice").alias("value"))
    targets = spark.createDataFrame([("F", 0.5), ("O", 0.3), ("X", 0.2)], "asset string, weight double")
    out = st.calendar_rebalance(rows, targets, "day", "asset", "value")
    return rounded(out.withColumns({"day": F.col("day").cast("string"), "adjustment": F.round("adjustment", 4)}))


PF = "CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) <> 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) END"


@register(
    "profit_by_size",
    f"""WITH {TRADES_SQL}, e AS (SELECT symbol, quantile_cont(price, 0.2) AS a, quantile_cont(price, 0.4) AS b, quantile_cont(price, 0.6) AS c, quantile_cont(price, 0.8) AS d FROM trades GROUP BY 1)
SELECT symbol, CAST(1 + (price > a)::INT + (price > b)::INT + (price > c)::INT + (price > d)::INT AS INTEGER) AS bucket, count(*) AS n, {r(PF, 'profit_factor')} FROM trades JOIN e USING (symbol) GROUP BY 1, 2""",
)
def profit_by_size(spark, sf_dir):
    return rounded(st.profit_by_size(trades(spark, sf_dir), "price", "pnl", ["symbol"]))


@register(
    "profit_by_hold",
    f"""WITH {TICKS_SQL}, h AS (SELECT kind, (epoch_us(ts) - epoch_us(lag(ts) OVER ({W}))) / 3.6e9::DOUBLE AS h, price - lag(price) OVER ({W}) AS pnl FROM ticks)
SELECT kind, CASE WHEN h <= 4 THEN '<4h' WHEN h <= 12 THEN '4-12h' WHEN h <= 24 THEN '12-24h' WHEN h <= 48 THEN '1-2d' WHEN h <= 168 THEN '2-7d' ELSE '>7d' END AS bucket, count(*) AS n, {r('avg(pnl)', 'mean')}, {r('avg((pnl > 0)::INT)', 'win_rate')}, {r(PF, 'profit_factor')} FROM h WHERE h > 0 GROUP BY 1, 2""",
)
def profit_by_hold(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.withColumn("at", at)
    held = (F.col("at") - lag("at", TICKS)) / 3.6e9
    return rounded(st.profit_by_hold(rows.withColumns({"hours": held, "pnl": F.col("price") - lag("price", TICKS)}), "hours", "pnl", ["kind"]))


@register(
    "equity_phases",
    f"""WITH {DD}, p AS (SELECT *, CASE WHEN dd <= -0.05 THEN 'drawdown' ELSE 'growth' END AS phase FROM dd), c AS (SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER ({W}) THEN 1 ELSE 0 END AS c FROM p), g AS (SELECT *, sum(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT asset, tie, {r('dd', 'drawdown')}, phase, CAST(row_number() OVER (PARTITION BY asset, g ORDER BY ts, tie) AS INTEGER) AS lasted FROM g""",
)
def equity_phases(spark, sf_dir):
    return pick(st.equity_phases(ticks(spark, sf_dir)), "drawdown", "phase", "lasted")


TEN = f"({W} ROWS 9 PRECEDING)"


@register(
    "rolling_growth",
    f"WITH {RETURNS}, g AS (SELECT *, CASE WHEN count(ret) OVER {TEN} = 10 THEN CASE WHEN product(1 + ret) OVER {TEN} > 0 THEN pow(product(1 + ret) OVER {TEN}, 0.5) - 1 ELSE 0 END END AS g FROM rets) SELECT asset, tie, {r('g', 'growth')} FROM g",
)
def rolling_growth(spark, sf_dir):
    return pick(st.rolling_growth(returns(spark, sf_dir), n=10, periods=5), "growth")


@register(
    "event_clusters",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type = 'error'), c AS (SELECT *, sum(CASE WHEN p IS NULL OR d - p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY d RANGE UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, CAST(min(d) AS VARCHAR) AS start, CAST(max(d) AS VARCHAR) AS "end", count(*) AS events FROM c GROUP BY user_id, g HAVING count(*) > 1""",
)
def event_clusters(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("event_type = 'error'")
    return st.event_clusters(rows, "ts", 1, ["user_id"]).withColumns({c: F.col(c).cast("string") for c in ("start", "end")})
