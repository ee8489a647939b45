"""Queries over graphs of suppliers whose monthly returns move together, and over clusters of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.frames import rounded
from quantspark.operators import blocks, networks
from quantspark.plans.panel_queries import MONTHS_SQL, complete_sql, months
from quantspark.plans.registry import register
from quantspark.sources.tables import read

LEAST_CORRELATION = 0.25
CORRELATION_SQL = f"""WITH RECURSIVE {MONTHS_SQL}, {complete_sql('c', 'month_returns', 'ret')}, p AS MATERIALIZED (SELECT a.asset AS a, b.asset AS b, coalesce(corr(a.x, b.x), 0) AS corr FROM c a JOIN c b ON a.ts = b.ts AND a.asset < b.asset GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b, 1 - abs(corr) AS w FROM p)"""


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.covariance(blocks.panel(months(spark, sf_dir))).scaled().pairs("corr")


def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, w): suppliers correlated enough, weighted by how much."""
    pairs = correlations(spark, sf_dir).where((F.col("a") != F.col("b")) & (F.abs("corr") >= LEAST_CORRELATION))
    return pairs.select("a", "b", F.abs("corr").alias("w"))


@register("correlation_clusters", f"""{CORRELATION_SQL}, l AS (SELECT a, b FROM e WHERE w <= 0.7 UNION ALL SELECT b, a FROM e WHERE w <= 0.7), n AS (SELECT DISTINCT asset AS node FROM c),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a) SELECT node, min(seen) AS cluster FROM r GROUP BY 1""")
def correlation_clusters(spark, sf_dir):
    return networks.single_linkage(networks.correlation_distance(correlations(spark, sf_dir)), 0.7)


@register("spanning_tree")
def spanning_tree(spark, sf_dir):
    return rounded(networks.spanning_tree(networks.correlation_distance(correlations(spark, sf_dir))))


@register("betweenness", f"""{CORRELATION_SQL}, l AS (SELECT a, b FROM p WHERE abs(corr) >= {LEAST_CORRELATION} UNION ALL SELECT b, a FROM p WHERE abs(corr) >= {LEAST_CORRELATION}), n AS (SELECT DISTINCT a AS node FROM l),
t AS (SELECT node AS s, node AS v, 0 AS d FROM n UNION SELECT t.s, l.b, t.d + 1 FROM t JOIN l ON l.a = t.v WHERE t.d < 12), h AS MATERIALIZED (SELECT s, v, min(d) AS d FROM t GROUP BY 1, 2),
k AS (SELECT s, v, d, CAST(1 AS DOUBLE) AS c FROM h WHERE d = 0 UNION ALL SELECT h.s, h.v, h.d, sum(k.c) AS c FROM k JOIN l ON l.a = k.v JOIN h ON h.s = k.s AND h.v = l.b AND h.d = k.d + 1 GROUP BY 1, 2, 3),
b AS (SELECT a.v AS node, sum(a.c * z.c / st.c) AS x FROM k a JOIN k z ON z.s = a.v JOIN k st ON st.s = a.s AND st.v = z.v AND st.d = a.d + z.d WHERE a.s <> a.v AND z.v <> a.v AND a.s <> z.v GROUP BY 1)
SELECT node, round(CAST(coalesce(coalesce(x, 0) / nullif(((SELECT count(*) FROM n) - 1.0) * ((SELECT count(*) FROM n) - 2), 0), 0) AS DOUBLE), 6) + 0.0 AS betweenness FROM n LEFT JOIN b USING (node)""")
def betweenness(spark, sf_dir):
    return rounded(networks.betweenness(movers(spark, sf_dir)))


@register("density_clusters", """WITH RECURSIVE m AS (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS s, avg(p_size) AS b, stddev_pop(p_size) AS t FROM part),
x AS MATERIALIZED (SELECT p_partkey AS id, (p_retailprice - a) / s AS x, (p_size - b) / t AS y FROM part, m),
n AS MATERIALIZED (SELECT u.id AS a, v.id AS b FROM x u JOIN x v ON (u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y) <= 0.08 * 0.08),
k AS MATERIALIZED (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) >= 5), l AS MATERIALIZED (SELECT a, b FROM n WHERE a IN (FROM k) AND b IN (FROM k)),
r AS (SELECT id, id AS seen FROM k UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a), g AS (SELECT id, min(seen) AS cluster FROM r GROUP BY 1),
e AS (SELECT n.a AS id, min(cluster) AS cluster FROM n JOIN g ON g.id = n.b WHERE n.a NOT IN (FROM k) GROUP BY 1)
SELECT x.id, coalesce(g.cluster, e.cluster) AS cluster, g.id IS NOT NULL AS core FROM x LEFT JOIN g USING (id) LEFT JOIN e USING (id)""")
def density_clusters(spark, sf_dir):
    return networks.density_clusters(read(spark, sf_dir, "part"), ["p_retailprice", "p_size"], eps=0.08, least=5, id_col="p_partkey")
