"""Queries over panels: hourly prices of event types, and monthly unit prices of suppliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, ratio, rounded, simple_return
from quantspark.operators import blocks, breaks, lagged, optimise
from quantspark.plans.indicator_queries import r
from quantspark.plans.registry import register
from quantspark.sources.tables import TICKS_SQL, TRADES_SQL, read, ticks, trades

PANEL = Series(("asset",), ("ts",))
HOURS_SQL = """hours AS (SELECT event_type AS asset, date_trunc('hour', ts) AS ts, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY 1, 2),
hour_returns AS (SELECT asset, ts, price / nullif(lag(price) OVER (PARTITION BY asset ORDER BY ts), 0) - 1 AS ret FROM hours)"""
MONTHS_SQL = """months AS (SELECT l_suppkey AS asset, date_trunc('month', l_shipdate) AS ts, avg(l_extendedprice / nullif(l_quantity, 0)) AS price FROM lineitem GROUP BY 1, 2),
month_returns AS (SELECT asset, ts, price / nullif(lag(price) OVER (PARTITION BY asset ORDER BY ts), 0) - 1 AS ret FROM months)"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, price, ret): the last value of each event type in each hour, and its return."""
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    return rows.withColumn("ret", simple_return("price", PANEL))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, price, ret): the mean unit price of each supplier in each month, and its return."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), F.date_trunc("month", "l_shipdate").alias("ts")).agg(F.avg(ratio(F.col("l_extendedprice"), F.col("l_quantity"))).alias("price"))
    return rows.withColumn("ret", simple_return("price", PANEL))


def complete_sql(name: str, source: str, x: str) -> str:
    """The rows of moments that every asset has."""
    return f"{name} AS (SELECT asset, ts, {x} AS x FROM {source} WHERE {x} IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ts) = (SELECT count(DISTINCT asset) FROM {source} WHERE {x} IS NOT NULL))"


def residual_sql(name: str, source: str, by: str, columns: Sequence[str]) -> tuple[str, str]:
    """(steps, last step): the columns centred in each group, each made orthogonal to those before it."""
    part = f"OVER (PARTITION BY {by})"
    steps = [f"{name}0 AS (SELECT {by}, {', '.join(f'{c} - avg({c}) {part} AS {c}' for c in columns)} FROM {source})"]
    for j, c in enumerate(columns[:-1]):
        rest = [f"{d} - {c} * coalesce(sum({d} * {c}) {part} / nullif(sum({c} * {c}) {part}, 0), 0) AS {d}" for d in columns[j + 1 :]]
        steps.append(f"{name}{j + 1} AS MATERIALIZED (SELECT {by}, {', '.join([*columns[: j + 1], *rest])} FROM {name}{j})")
    return ",\n".join(steps), f"{name}{len(columns) - 1}"


def unit_root_sql(source: str, by: str, k: int) -> str:
    """Steps from source (by, pos, x) to adf (by, adf_stat): a regression on so many earlier changes, then the level."""
    w = f"(PARTITION BY {by} ORDER BY pos)"
    lags = [f"d{i}" for i in range(1, k + 1)]
    back = f"ub AS (SELECT {by}, pos, lag(x) OVER {w} AS lvl, x - lag(x) OVER {w} AS dy FROM {source})"
    rows = f"ur AS (SELECT {by}, {''.join(f'lag(dy, {i}) OVER {w} AS d{i}, ' for i in range(1, k + 1))}lvl, dy, row_number() OVER {w} AS nth FROM ub)"
    kept = f"uk AS (SELECT * FROM ur WHERE nth >= {k + 2})"
    # The level comes last: what is left of it and of the change gives coefficient and error.
    steps, last = residual_sql("us", "uk", by, [*lags, "lvl", "dy"])
    before = f"us{k}"
    slope = f"ua AS (SELECT {by}, sum(lvl * dy) / nullif(sum(lvl * lvl), 0) AS slope, sum(lvl * lvl) AS ll, count(*) AS n FROM {before} GROUP BY {by})"
    rest = f"ue AS (SELECT {by}, sum(dy * dy) AS ee FROM {last} GROUP BY {by})"
    return f"{back}, {rows}, {kept}, {steps}, {slope}, {rest}, adf AS (SELECT {by}, slope / sqrt(ee / nullif(n - {k + 2}, 0) / ll) AS adf_stat FROM ua JOIN ue USING ({by}) WHERE n > {k + 2} AND ee > 0)"


P_SQL = "CASE " + " ".join(f"WHEN adf_stat < {bound} THEN {p}" for bound, p in lagged.CRITICAL) + " WHEN adf_stat IS NOT NULL THEN least(1.0, 0.5 + 0.5 * (1 - exp(-0.5 * (adf_stat + 1.94)))) END"


@register("augmented_dickey_fuller", f"WITH {TICKS_SQL}, n AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY ts, tie) AS pos, price AS x FROM ticks), {unit_root_sql('n', 'asset', 2)} SELECT asset, c.n, CAST(2 AS INTEGER) AS lags, {r('adf_stat', 'adf_stat')}, {r(P_SQL, 'p_value')} FROM (SELECT asset, count(*) AS n FROM n GROUP BY 1) c LEFT JOIN adf USING (asset)")
def augmented_dickey_fuller(spark, sf_dir):
    return rounded(lagged.augmented_dickey_fuller(ticks(spark, sf_dir), TICKS, lags=2))


def cointegration_sql(k: int, where: str = "TRUE") -> str:
    return f"""WITH {MONTHS_SQL}, {complete_sql('c', 'months', 'price')}, pr AS (SELECT a.asset AS a, b.asset AS b, a.ts, a.x AS y, b.x AS x FROM c a JOIN c b ON a.ts = b.ts AND a.asset < b.asset),
h AS (SELECT a, b, regr_slope(y, x) AS h, corr(y, x) AS correlation FROM pr GROUP BY 1, 2),
sp AS MATERIALIZED (SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY ts) AS pos, y - h * x AS x FROM pr JOIN h USING (a, b)), {unit_root_sql('sp', 'a, b', k)},
lf AS (SELECT a, b, x, lag(x) OVER (PARTITION BY a, b ORDER BY pos) AS before FROM sp),
f AS (SELECT a, b, 1 + sum(before * (x - before)) / nullif(sum(before * before), 0) AS phi, avg(x) AS m, stddev_samp(x) AS s, count(*) AS n FROM lf GROUP BY 1, 2),
o AS (SELECT a AS asset_y, b AS asset_x, n, {r('correlation', 'correlation')}, {r('h', 'hedge_ratio')}, {r('adf_stat', 'adf_stat')}, {r('CASE WHEN phi > 0 AND phi < 1 THEN greatest(1.0, -ln(2) / ln(phi)) END', 'half_life')}, {r('m', 'spread_mean')}, {r('s', 'spread_std')}, {r(P_SQL, 'p_value')} FROM h JOIN f USING (a, b) LEFT JOIN adf USING (a, b))
SELECT * FROM o WHERE {where}"""


@register("cointegration", cointegration_sql(1))
def cointegration(spark, sf_dir):
    return rounded(lagged.cointegration(months(spark, sf_dir), lags=1))


@register("cointegrated_pairs", cointegration_sql(1, "p_value < 0.05 AND half_life BETWEEN 1 AND 60"))
def cointegrated_pairs(spark, sf_dir):
    return rounded(lagged.cointegrated_pairs(months(spark, sf_dir), lags=1))


def granger_sql(most: int) -> str:
    parts = []
    for lag in range(1, most + 1):
        w = "(PARTITION BY c, e ORDER BY ts)"
        names = [f"{v}{i}" for v in "yx" for i in range(1, lag + 1)]
        back = ", ".join(f"lag({v}, {i}) OVER {w} AS {v}{i}" for v in "yx" for i in range(1, lag + 1))
        steps, last = residual_sql("q", "g", "c, e", [*names, "y"])
        body = f"g AS (SELECT c, e, {back}, y FROM pr QUALIFY row_number() OVER {w} > {lag}), {steps}"
        parts.append(f"(WITH {body}, a AS (SELECT c, e, sum(y * y) AS short, count(*) AS n FROM q{lag} GROUP BY 1, 2), b AS (SELECT c, e, sum(y * y) AS long FROM {last} GROUP BY 1, 2) SELECT c, e, {lag} AS lag, n, short, long FROM a JOIN b USING (c, e))")
    return f"""WITH {HOURS_SQL}, {complete_sql('k', 'hour_returns', 'ret')}, pr AS (SELECT a.asset AS c, b.asset AS e, a.ts, a.x AS x, b.x AS y FROM k a JOIN k b ON a.ts = b.ts AND a.asset <> b.asset),
u AS ({' UNION ALL '.join(parts)}) SELECT c AS cause, e AS effect, CAST(lag AS INTEGER) AS lag, n, {r('CASE WHEN n >= 2 * lag + 2 AND long > 0 AND long < short THEN (short - long) / lag / (long / (n - 2 * lag - 1)) ELSE 0 END', 'f_stat')} FROM u"""


@register("granger_lags", granger_sql(3))
def granger_lags(spark, sf_dir):
    return rounded(lagged.granger_pairs(hours(spark, sf_dir), 3).drop("p_value"))


@register("granger_links")
def granger_links(spark, sf_dir):
    """The F distribution is beyond DuckDB's functions; tests compare the p values with sums over the density."""
    return rounded(lagged.granger_links(lagged.granger_pairs(hours(spark, sf_dir), 5)))


@register("block_correlation", f"WITH {MONTHS_SQL}, {complete_sql('c', 'month_returns', 'ret')} SELECT a.asset AS a, b.asset AS b, {r('CASE WHEN a.asset = b.asset THEN 1.0 ELSE corr(a.x, b.x) END', 'corr')} FROM c a JOIN c b ON a.ts = b.ts AND a.asset <= b.asset GROUP BY 1, 2")
def block_correlation(spark, sf_dir):
    return rounded(blocks.covariance(blocks.panel(months(spark, sf_dir))).scaled().pairs("corr"))


SHRINK_SQL = f"""WITH {MONTHS_SQL}, {complete_sql('k', 'month_returns', 'ret')}, c AS (SELECT asset, ts, x - avg(x) OVER (PARTITION BY asset) AS x FROM k),
p AS (SELECT a.asset AS i, b.asset AS j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q, avg(a.x * b.x * b.x * b.x) AS c3, avg(b.x * a.x * a.x * a.x) AS d3, count(*) AS t FROM c a JOIN c b ON a.ts = b.ts GROUP BY 1, 2),
v AS (SELECT i, s AS var FROM p WHERE i = j), w AS (SELECT p.*, a.var AS vi, b.var AS vj FROM p JOIN v a ON a.i = p.i JOIN v b ON b.i = p.j),
m AS (SELECT count(DISTINCT i) AS n, max(t) AS t, sum(CASE WHEN i = j THEN s END) AS tr, avg(CASE WHEN i <> j THEN s / sqrt(vi * vj) END) AS rr, sum(s * s) AS ss, sum(q - s * s) AS er,
 sum(CASE WHEN i = j THEN q - s * s END) AS de, sum(CASE WHEN i <> j THEN ((c3 - s * vj) * sqrt(vj / vi) + (d3 - s * vi) * sqrt(vi / vj)) / 2 END) AS th FROM w),
g AS (SELECT sum(CASE WHEN i <> j THEN (s - rr * sqrt(vi * vj)) * (s - rr * sqrt(vi * vj)) ELSE 0 END) AS gam FROM w, m)"""
LW_SQL = "greatest(0.0, least(1.0, (er - de - rr * th) / gam / t))"
IDENTITY_SQL = "greatest(0.0, least(1.0, er / (t * (ss - tr * tr / n))))"
OAS_SQL = "greatest(0.0, least(1.0, ((1 - 2.0 / n) * ss + tr * tr) / ((t + 1 - 2.0 / n) * (ss - tr * tr / n))))"


@register("shrinkage_intensities", f"{SHRINK_SQL} " + " UNION ALL ".join(f"SELECT '{name}' AS method, {r(sql, 'intensity')}, {r('rr', 'mean_correlation')}, {r('tr / n', 'mean_variance')}, n AS n_assets, t AS n_moments FROM m, g" for name, sql in (("identity", IDENTITY_SQL), ("ledoit_wolf", LW_SQL), ("oas", OAS_SQL))))
def shrinkage_intensities(spark, sf_dir):
    return rounded(blocks.shrinkage_report(months(spark, sf_dir), strict=False))


@register("ledoit_wolf", f"{SHRINK_SQL}, h AS (SELECT {LW_SQL} AS k, rr FROM m, g) SELECT i AS a, j AS b, {r('CASE WHEN i = j THEN s ELSE k * rr * sqrt(vi * vj) + (1 - k) * s END', 'cov')} FROM w, h WHERE i <= j")
def ledoit_wolf(spark, sf_dir):
    return rounded(blocks.shrunk_covariance(months(spark, sf_dir), strict=False)[0].pairs("cov"))


@register("market_concentration")
def market_concentration(spark, sf_dir):
    """SQL has no eigenvalues; tests compare them with those of a dense matrix."""
    return rounded(blocks.market_concentration(months(spark, sf_dir)), 5)


@register("turbulence")
def turbulence(spark, sf_dir):
    """SQL inverts no matrices; tests compare with the definition."""
    return rounded(blocks.turbulence(hours(spark, sf_dir), 48))


DEALS = Series(("symbol",), ("ts", "okey", "line"))
BREAKS_SQL = f"""WITH RECURSIVE {TRADES_SQL}, q AS MATERIALIZED (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY ts, okey, line) - 1 AS pos, pnl - avg(pnl) OVER (PARTITION BY symbol) AS g, count(*) OVER (PARTITION BY symbol) AS n FROM trades WHERE pnl IS NOT NULL),
c AS MATERIALIZED (SELECT symbol, pos, sum(g * g) OVER (PARTITION BY symbol ORDER BY pos) AS s, n FROM q),
seg AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS a, n AS b, CAST(-1 AS BIGINT) AS cut, CAST(0 AS DOUBLE) AS stat, 0 AS depth, 0 AS half FROM c WHERE n >= 60
 UNION ALL SELECT symbol, CASE WHEN h = 0 THEN a ELSE cut END, CASE WHEN h = 0 THEN cut ELSE b END, cut, stat, depth + 1, h FROM (
 SELECT symbol, a, b, depth, arg_max(pos, d) + 1 AS cut, sqrt((b - a) / 2.0) * max(d) AS stat FROM (
  SELECT t.symbol, t.a, t.b, t.depth, c.pos, abs((c.s - coalesce(f.s, 0)) / nullif(l.s - coalesce(f.s, 0), 0) - (c.pos - t.a + 1) / CAST(t.b - t.a AS DOUBLE)) AS d
  FROM seg t JOIN c ON c.symbol = t.symbol AND c.pos >= t.a AND c.pos < t.b - 1 LEFT JOIN c f ON f.symbol = t.symbol AND f.pos = t.a - 1 JOIN c l ON l.symbol = t.symbol AND l.pos = t.b - 1 WHERE t.b - t.a >= 60)
 GROUP BY 1, 2, 3, 4), (SELECT unnest([0, 1]) AS h) WHERE stat > {breaks.CRITICAL} AND cut - a >= 30 AND b - cut >= 30),
found AS (SELECT symbol, cut AS position, stat, depth - 1 AS depth FROM seg WHERE depth > 0 AND half = 0)"""


@register("variance_breaks", f"{BREAKS_SQL} SELECT symbol, position, {r('stat', 'statistic')}, CAST(depth AS INTEGER) AS depth FROM found")
def variance_breaks(spark, sf_dir):
    return rounded(breaks.variance_breaks(trades(spark, sf_dir), DEALS, "pnl"))


@register("variance_segments", f"{BREAKS_SQL}, m AS (SELECT q.*, count(position) OVER (PARTITION BY q.symbol ORDER BY pos) AS part FROM q LEFT JOIN found ON found.symbol = q.symbol AND position = pos) SELECT symbol, min(pos) AS start, max(pos) + 1 AS end, count(*) AS n, {r('stddev_samp(pnl)', 'volatility')} FROM m GROUP BY symbol, part")
def variance_segments(spark, sf_dir):
    return rounded(breaks.variance_segments(trades(spark, sf_dir), DEALS, "pnl"))


@register("extreme_tail")
def extreme_tail(spark, sf_dir):
    """A largest likelihood is beyond SQL; tests compare it with a plain search."""
    return rounded(breaks.extreme_tail(trades(spark, sf_dir), DEALS, "pnl"), 3)


def nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """months of the suppliers with their nation."""
    home = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("nation"))
    return months(spark, sf_dir).join(home, "asset")


@register("efficient_frontier")
def efficient_frontier(spark, sf_dir):
    """Quadratic programmes are beyond SQL; tests check the conditions of an optimum."""
    rows = optimise.efficient_frontier(optimise.group_panels(nation_months(spark, sf_dir), ["nation"]), [0.1, 0.5, 1.0, 2.0, 5.0, 20.0, 100.0])
    return rounded(rows.drop("assets", "weights", "residual"), 5)


@register("tracking_portfolios")
def tracking_portfolios(spark, sf_dir):
    rows = nation_months(spark, sf_dir)
    market = rows.groupBy("ts").agg(F.avg("ret").alias("market"))
    out = optimise.tracking_portfolios(rows.join(market, "ts"), F.col("market"), ["nation"])
    return rounded(out.drop("assets", "weights", "residual"), 5)


@register("black_litterman")
def black_litterman(spark, sf_dir):
    """Market weights are the suppliers' shares of all months' prices; the one view is that a nation's first supplier
    gains one per cent a month."""
    rows = nation_months(spark, sf_dir)
    caps = rows.groupBy("nation", "asset").agg(F.avg("price").alias("cap")).groupBy("nation").agg(F.transform(F.sort_array(F.collect_list(F.struct("asset", "cap"))), lambda c: c["cap"]).alias("caps"))
    problems = optimise.group_panels(rows, ["nation"]).join(caps, "nation")
    first = F.transform("assets", lambda a, i: F.when(i == 0, 1.0).otherwise(0.0))
    view = F.array(F.struct(first.alias("weights"), F.lit(0.01).alias("ret"), F.lit(0.6).alias("confidence")))
    out = optimise.black_litterman(problems.withColumn("views", view), "caps", "views")
    return rounded(out.drop("assets", "weights", "residual", "caps", "views"), 5)
