"""Further market queries: latest rows, strength, coverage, roll-ups, equity, correlation, histograms, exposures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, rounded
from quantspark.operators import market as m
from quantspark.plans.indicator_queries import r
from quantspark.plans.registry import register
from quantspark.plans.report_queries import DAILY, against_market, daily
from quantspark.plans.text_queries import MOOD
from quantspark.sources.tables import TICKS_SQL, read, ticks


@register("last_rows", f"WITH {TICKS_SQL} SELECT asset, tie, CAST(row_number() OVER (PARTITION BY asset ORDER BY ts DESC, tie DESC) AS INTEGER) AS place FROM ticks QUALIFY place <= 3")
def last_rows(spark, sf_dir):
    return m.last_rows(ticks(spark, sf_dir), TICKS, 3).select("asset", "tie", "place")


def mood(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy(F.col("kind").alias("asset"), F.to_date("ts").alias("ts")).agg(F.avg(F.col("price") / 250 - 1).alias("mood"))


@register(
    "relative_strength",
    f"""WITH {DAILY}, {MOOD}, a AS (SELECT d.asset, d.ts, ret, x FROM daily d JOIN mood USING (asset, ts) WHERE ret IS NOT NULL), z AS (SELECT *, 0.6 * coalesce((ret - avg(ret) OVER p) / nullif(stddev_pop(ret) OVER p, 0), 0) + 0.4 * coalesce((x - avg(x) OVER p) / nullif(stddev_pop(x) OVER p, 0), 0) AS s FROM a WINDOW p AS (PARTITION BY ts))
SELECT asset, CAST(ts AS VARCHAR) AS day, {r('s', 'strength')}, CAST(rank() OVER (PARTITION BY ts ORDER BY round(s, 9) DESC) AS INTEGER) AS rank FROM z""",
)
def relative_strength(spark, sf_dir):
    rows = daily(spark, sf_dir).join(mood(spark, sf_dir), ["asset", "ts"])
    return rounded(m.relative_strength(rows, "ts", "ret", "mood").select("asset", F.col("ts").cast("string").alias("day"), "strength", "rank"))


@register("missing_suppliers", "SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def missing_suppliers(spark, sf_dir):
    need = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    have = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return m.missing_keys(need, have, ["nation"])


@register(
    "region_rollup",
    f"""WITH a AS (SELECT r_name AS region, c_acctbal AS v, CAST(c_custkey % 7 + 1 AS DOUBLE) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT CASE WHEN grouping(region) = 1 THEN 'all' ELSE region END AS region, count(*) AS members, {r('sum(w)', 'weight')}, {r('sum(v * w) / sum(w)', 'mean')} FROM a GROUP BY ROLLUP (region)""",
)
def region_rollup(spark, sf_dir):
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 7 + 1).cast("double").alias("w"))
    return rounded(m.group_rollup(rows, places, "nation", "region", "v", "w"))


@register(
    "equity_report",
    f"""WITH b AS (SELECT event_type AS asset, CAST(ts AS DATE) AS ts, sum(value) AS v FROM events GROUP BY 1, 2), q AS (SELECT *, sum(v) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS e FROM b),
a AS (SELECT *, e / lag(e) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r, e / max(e) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS d FROM q), g AS (SELECT asset, arg_max(e, ts) / arg_min(e, ts) AS g, count(r) AS n, stddev_samp(r) AS s, min(d) AS d FROM a GROUP BY 1)
SELECT asset, n, {r('d', 'max_drawdown')}, {r('g - 1', 'total_return')}, {r('pow(g, 60.0 / n) - 1', 'cagr')}, {r('s * sqrt(60)', 'volatility')}, {r('CASE WHEN d <> 0 THEN (pow(g, 60.0 / n) - 1) / abs(d) END', 'calmar')} FROM g""",
)
def equity_report(spark, sf_dir):
    rows = ticks(spark, sf_dir).groupBy(F.col("kind").alias("asset"), F.to_date("ts").alias("ts")).agg(F.sum("price").alias("v"))
    s = Series(order=("ts",))
    return rounded(m.equity_report(rows.withColumn("e", F.sum("v").over(s.so_far())), s, "e", 60))


N8 = "(PARTITION BY asset ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"


@register(
    "rolling_correlation",
    f"""WITH {DAILY}, m AS (SELECT ts, avg(ret) AS market FROM daily GROUP BY 1), a AS (SELECT asset, ts, CASE WHEN day(ts) % 4 <> 0 THEN ret END AS x, market AS y FROM daily JOIN m USING (ts)), b AS (SELECT asset, ts, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS y FROM a)
SELECT asset, CAST(ts AS VARCHAR) AS day, {r(f'CASE WHEN count(x) OVER {N8} >= 4 THEN corr(x, y) OVER {N8} END', 'corr')} FROM b""",
)
def rolling_correlation(spark, sf_dir):
    rows = against_market(spark, sf_dir).withColumn("ret", F.when(F.dayofmonth("ts") % 4 != 0, F.col("ret")))
    out = m.rolling_correlation(rows, Series(order=("ts",)), "ret", "market", 8)
    return rounded(out.select("asset", F.col("ts").cast("string").alias("day"), "corr"))


@register("value_histogram", f"WITH {TICKS_SQL}, a AS (SELECT kind, CAST(floor(price / 25) * 25 AS DOUBLE) AS bucket, count(*) AS n FROM ticks GROUP BY 1, 2) SELECT kind, bucket, n, {r('n / sum(n) OVER (PARTITION BY kind)', 'share')} FROM a")
def value_histogram(spark, sf_dir):
    return rounded(m.histogram(ticks(spark, sf_dir), "price", 25.0, ["kind"]))


@register(
    "two_factor_exposures",
    f"""WITH {DAILY}, m AS (SELECT ts, avg(ret) AS a FROM daily GROUP BY 1), {MOOD}, j AS (SELECT d.asset, d.ret AS y, m.a, x AS b FROM daily d JOIN m USING (ts) JOIN mood ON mood.asset = d.asset AND mood.ts = d.ts WHERE d.ret IS NOT NULL AND m.a IS NOT NULL),
c AS (SELECT asset, count(*) AS n, covar_samp(a, a) AS aa, covar_samp(b, b) AS bb, covar_samp(a, b) AS ab, covar_samp(y, a) AS ya, covar_samp(y, b) AS yb, covar_samp(y, y) AS yy, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM j GROUP BY 1),
e AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS p, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS q FROM c) SELECT asset, n, {r('p', 'beta_a')}, {r('q', 'beta_b')}, {r('my - p * ma - q * mb', 'alpha')}, {r('(p * ya + q * yb) / yy', 'r2')} FROM e""",
)
def two_factor_exposures(spark, sf_dir):
    rows = against_market(spark, sf_dir).join(mood(spark, sf_dir), ["asset", "ts"])
    return rounded(m.two_factor_exposures(rows, ["asset"], "ret", "market", "mood"))


NAMES = ("click", "error", "purchase", "signup", "view")


@register("returns_matrix", f"WITH {DAILY} SELECT CAST(ts AS VARCHAR) AS day, " + ", ".join(r(f"avg(ret) FILTER (asset = '{n}')", n) for n in NAMES) + " FROM daily GROUP BY 1")
def returns_matrix(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("day", F.col("ts").cast("string"))
    return rounded(m.wide_matrix(rows, "day", "asset", NAMES, "ret"))


@register("returns_long", f"WITH {DAILY} SELECT CAST(ts AS VARCHAR) AS day, asset, {r('ret', 'ret')} FROM daily WHERE ret IS NOT NULL")
def returns_long(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("day", F.col("ts").cast("string"))
    return rounded(m.long_table(m.wide_matrix(rows, "day", "asset", NAMES, "ret"), "day", NAMES, "asset", "ret"))
