"""Model, clustering, search and evaluation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantspark.frames import TICKS, rounded
from quantspark.operators import explain
from quantspark.operators import models as md
from quantspark.operators import text, windows
from quantspark.plans.indicator_queries import W, r, rows
from quantspark.plans.registry import register
from quantspark.plans.text_queries import posts
from quantspark.sources.tables import TICKS_SQL, ticks

FEATURES = ("change_1", "change_2", "change_5")


def featured(spark, sf_dir):
    known = windows.lag_features(ticks(spark, sf_dir), TICKS, "price")
    # Models take no change from a price of zero.
    known = known.withColumns({c: F.when(F.abs(c) < math.inf, F.col(c)) for c in FEATURES})
    return windows.time_split(md.with_direction(known, TICKS), TICKS)


@register("direction_probabilities")
def direction_probabilities(spark, sf_dir):
    """Averaged logistic and tree models, trained on the first part of each series, for the last part."""
    known = featured(spark, sf_dir)
    train = known.where("part = 'train'")
    fitted = [md.fit_direction(train, FEATURES, kind) for kind in ("logistic", "trees")]
    return md.predict_up(known.where("part = 'test'"), fitted, FEATURES, ["asset", "tie"])


@register("feature_importance")
def feature_importance(spark, sf_dir):
    known = featured(spark, sf_dir)
    return md.permutation_importance(md.fit_direction(known.where("part = 'train'"), FEATURES), known.where("part = 'test'"), FEATURES)


@register("partial_dependence")
def partial_dependence(spark, sf_dir):
    """Scores of a fitted model are beyond SQL; tests compare with every row and grid value tried."""
    known = featured(spark, sf_dir)
    model = md.fit_direction(known.where("part = 'train'"), FEATURES)
    return rounded(explain.partial_dependence(known.where("part = 'test'"), FEATURES, explain.logistic_score(model), points=20), 4)


@register("interaction_strength")
def interaction_strength(spark, sf_dir):
    known = featured(spark, sf_dir)
    score = explain.logistic_score(md.fit_direction(known.where("part = 'train'"), FEATURES))
    test = known.where("part = 'test'")
    rows = [(a, b, round(explain.interaction_strength(test, FEATURES, a, b, score, points=8), 4)) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
    return spark.createDataFrame(rows, "one string, two string, strength double")


@register("asset_clusters")
def asset_clusters(spark, sf_dir):
    known = ticks(spark, sf_dir).groupBy("asset").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"), F.count(F.lit(1)).cast("double").alias("n"))
    return md.cluster_rows(known, ["mean", "std", "n"])


def _search_sql(fast: int, slow: int) -> str:
    mean = lambda n: f"CASE WHEN count(price) OVER {rows(n)} = {n} THEN avg(price) OVER {rows(n)} END"
    return f"""SELECT * FROM (WITH {TICKS_SQL}, a AS (SELECT *, coalesce(sign(round({mean(fast)} - {mean(slow)}, 9)), 0) AS g, coalesce(price / nullif(lag(price) OVER ({W}), 0) - 1, 0) AS x FROM ticks), b AS (SELECT *, coalesce(lag(g) OVER ({W}), 0) AS p FROM a),
c AS (SELECT asset, p * x - 0.001 * abs(p - coalesce(lag(p) OVER ({W}), p)) AS net FROM b) SELECT asset, CAST({fast} AS BIGINT) AS fast, CAST({slow} AS BIGINT) AS slow, {r(f'CASE WHEN count(*) > {slow + 2} AND stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) ELSE 0 END', 'score')} FROM c GROUP BY 1)"""


SEARCH_SQL = " UNION ALL ".join(_search_sql(f, s) for f in (3, 5) for s in (8, 13))


@register("crossover_search", SEARCH_SQL)
def crossover_search(spark, sf_dir):
    return rounded(md.crossover_search(ticks(spark, sf_dir), TICKS, (3, 5), (8, 13)))


@register("parameter_search", SEARCH_SQL)
def parameter_search(spark, sf_dir):
    return rounded(md.parameter_search(ticks(spark, sf_dir), TICKS, {"fast": (3, 5), "slow": (8, 13)}))


@register(
    "label_confusion",
    f"""WITH a AS (SELECT source, length(text) > 600 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, sum(CAST(p AND a AS INTEGER)) AS tp, sum(CAST(p AND NOT a AS INTEGER)) AS fp, sum(CAST(NOT p AND a AS INTEGER)) AS fn, sum(CAST(NOT p AND NOT a AS INTEGER)) AS tn FROM a GROUP BY 1),
d AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rc FROM c)
SELECT source, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {r('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {r('pr', 'precision')}, {r('rc', 'recall')}, {r('CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END', 'f1')} FROM d""",
)
def label_confusion(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", (F.length("text") > 600).alias("p"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("a"))
    return rounded(md.confusion(docs.join(labels, "doc_id"), "p", "a", ["source"]))


@register(
    "calibration",
    f"""WITH a AS (SELECT least(n_chars / 5000.0::DOUBLE, 1) AS p, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id))
SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, {r('avg(p)', 'predicted')}, {r('avg(y)', 'observed')}, {r('avg((p - y) * (p - y))', 'brier')} FROM a GROUP BY 1""",
)
def calibration(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("prob_up"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("label"))
    return rounded(md.calibration(docs.join(labels, "doc_id")))


@register("near_copies")
def near_copies(spark, sf_dir):
    return text.near_copies(posts(spark, sf_dir))
