"""Direction models on feature tables with pyspark.ml, averaged ensembles, permutation importance, clustering, and
parameter searches in walk-forward order."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.frames import Series, lag, ratio, rolling_mean, simple_return

KINDS = {"logistic": lambda seed: LogisticRegression(featuresCol="__z", labelCol="label", maxIter=50), "trees": lambda seed: GBTClassifier(featuresCol="__z", labelCol="label", maxIter=10, maxDepth=3, seed=seed)}


def with_direction(df: DataFrame, s: Series, price: str = "price") -> DataFrame:
    """label 1 where the next price of the same series is higher; the last row of a series has none."""
    later = F.lead(price).over(s.window())
    return df.withColumn("label", F.when(later.isNotNull(), (later > F.col(price)).cast("double")))


def fit_direction(train: DataFrame, features: Sequence[str], kind: str = "logistic", seed: int = 7) -> PipelineModel:
    """A scaled model of one kind; rows with a missing feature or label are left out."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), KINDS[kind](seed)]
    return Pipeline(stages=stages).fit(train.where(F.col("label").isNotNull()).dropna(subset=list(features)))


def predict_up(df: DataFrame, models: Sequence[PipelineModel], features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, label, prob_up): the mean of the models' probabilities."""
    out = df.dropna(subset=list(features))
    # One scan: each model adds its column and leaves its work behind.
    for k, model in enumerate(models):
        scored = model.transform(out).withColumn(f"__p{k}", vector_to_array("probability")[1])
        out = scored.drop("__x", "__z", "rawPrediction", "probability", "prediction")
    total = F.lit(0.0)
    for k in range(len(models)):
        total = total + F.col(f"__p{k}")
    return out.select(*key, "label", (total / len(models)).alias("prob_up"))


#: Rows among which one task deals values anew.
DEALT = 50_000


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], seed: int = 7) -> DataFrame:
    """(feature, importance): loss of area under the curve when one feature is dealt anew among the rows.

    Rows swap values within hash buckets of about DEALT rows, by joining their numbers in two orders.
    """
    rows = df.where(F.col("label").isNotNull()).dropna(subset=list(features))
    judge = BinaryClassificationEvaluator(labelCol="label")
    base = judge.evaluate(model.transform(rows))
    buckets = max(1, rows.count() // DEALT)
    found = []
    for feature in features:
        bucket = rows.withColumn("__b", F.pmod(F.xxhash64(*[F.col(c) for c in features]), F.lit(buckets)))
        a = Window.partitionBy("__b").orderBy(F.xxhash64(*features, F.lit(seed)))
        values = bucket.select("__b", F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(*features, F.lit(seed + 1)))).alias("__n"), F.col(feature).alias("__v"))
        mixed = bucket.withColumn("__n", F.row_number().over(a)).drop(feature).join(values, ["__b", "__n"]).withColumnRenamed("__v", feature)
        found.append((feature, float(base - judge.evaluate(model.transform(mixed)))))
    return df.sparkSession.createDataFrame(found, "feature string, importance double")


def cluster_rows(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 7) -> DataFrame:
    """df with a cluster number from k-means on standardised features; rows with a missing one have none."""
    known = df.dropna(subset=list(features))
    stages = [VectorAssembler(inputCols=list(features), outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), KMeans(featuresCol="__z", predictionCol="cluster", k=k, seed=seed)]
    return Pipeline(stages=stages).fit(known).transform(known).drop("__x", "__z")


def crossover_score(prices: np.ndarray, fast: int, slow: int, cost: float = 0.001) -> float:
    """Mean over deviation of the net returns of a moving-average crossover."""
    if len(prices) <= slow + 2:
        return 0.0
    p = pd.Series(prices)
    # Rounded, so that equal means are no crossing whatever a running sum leaves.
    gap = np.sign((p.rolling(fast).mean() - p.rolling(slow).mean()).round(9)).fillna(0.0)
    position = gap.shift(1).fillna(0.0)
    net = position * p.pct_change().where(p.shift(1) != 0).fillna(0.0) - cost * position.diff().abs().fillna(0.0)
    return float(net.mean() / net.std()) if net.std() > 0 else 0.0


def parameter_search(df: DataFrame, s: Series, grid: dict[str, Sequence], score: Callable[..., float] = crossover_score, price: str = "price") -> DataFrame:
    """(key, parameters, score) for every series and every combination. A series is shuffled once, key, order and price
    alone, and scored under all combinations where it lies. The crossover's own score is found by windows (see
    crossover_search), which spares a call of Python for each series; prices that are not a number count as missing."""
    names = list(grid)
    if score is crossover_score and sorted(names) == ["fast", "slow"] and all(isinstance(n, int) for values in grid.values() for n in values):
        known = df.select(*s.key, *s.order, F.when(~F.isnan(F.col(price).cast("double")), F.col(price).cast("double")).alias(price))
        return crossover_search(known, s, grid["fast"], grid["slow"], price=price).select(*s.key, *names, "score")
    combos = [dict(zip(names, values, strict=True)) for values in itertools.product(*grid.values())]
    kinds = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        prices = frame.sort_values(list(s.order), kind="stable")[price].to_numpy(float)
        rows = pd.DataFrame(combos).assign(score=[score(prices, **c) for c in combos])
        for k in s.key:
            rows[k] = frame[k].iloc[0]
        return rows[[*s.key, *names, "score"]]

    schema = ", ".join([f"{k} {kinds[k]}" for k in s.key] + [f"{n} {'long' if isinstance(grid[n][0], int) else 'double'}" for n in names] + ["score double"])
    return df.select(*s.key, *s.order, price).groupBy(*s.key).applyInPandas(run, schema)


def crossover_search(df: DataFrame, s: Series, fast: Sequence[int], slow: Sequence[int], cost: float = 0.001, price: str = "price") -> DataFrame:
    """What parameter_search gives for crossover_score and all pairs of lengths, by windows: one sort of the series holds
    all means, and the pairs meet their rows only in partial sums, so that a series of any length is no task's burden."""
    lengths = sorted({*fast, *slow})
    rows = df.withColumns({f"__m{n}": rolling_mean(F.col(price), s, n) for n in lengths} | {"__x": F.coalesce(simple_return(price, s), F.lit(0.0))})
    pairs = list(itertools.product(fast, slow))
    # Rounded, so that equal means are no crossing whatever a running sum leaves.
    rows = rows.withColumns({f"__g{f}_{n}": F.coalesce(lag(F.signum(F.round(F.col(f"__m{f}") - F.col(f"__m{n}"), 9)), s), F.lit(0.0)) for f, n in pairs})

    def net(position: Column) -> Column:
        return position * F.col("__x") - cost * F.abs(position - F.coalesce(lag(position, s), position))

    rows = rows.withColumns({f"__n{f}_{n}": net(F.col(f"__g{f}_{n}")) for f, n in pairs})
    sums = [e for f, n in pairs for e in (F.avg(f"__n{f}_{n}").alias(f"__a{f}_{n}"), F.stddev_samp(f"__n{f}_{n}").alias(f"__d{f}_{n}"))]
    out = rows.groupBy(*s.key).agg(F.count(F.lit(1)).alias("__rows"), *sums)

    def scored(f: int, n: int) -> Column:
        spread = F.col(f"__d{f}_{n}")
        score = F.when((F.col("__rows") > n + 2) & (spread > 0), F.col(f"__a{f}_{n}") / F.when(spread > 0, spread)).otherwise(0.0)
        return F.struct(F.lit(f).cast("long").alias("fast"), F.lit(n).cast("long").alias("slow"), score.alias("score"))

    return out.select(*s.key, F.inline(F.array(*[scored(f, n) for f, n in pairs])))


def best_parameters(scores: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The combination of the best mean score; ties go to the smaller parameters."""
    means = scores.groupBy(*by, *names).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    best = F.struct(F.col("score"), *[(-F.col(n)).alias(n) for n in names])
    picked = means.groupBy(*by).agg(F.max(best).alias("b")) if by else means.agg(F.max(best).alias("b"))
    return picked.select(*by, *[(-F.col(f"b.{n}")).alias(n) for n in names], F.col("b.score").alias("score"))


def calibration(df: DataFrame, prob: str = "prob_up", label: str = "label", bins: int = 10) -> DataFrame:
    """Predicted against observed share by bin of probability, with the Brier score's parts."""
    bucket = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    gap = F.col(prob) - F.col(label)
    return df.where(F.col(label).isNotNull()).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("predicted"), F.avg(label).alias("observed"), F.avg(gap * gap).alias("brier"))


def confusion(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the four outcomes, accuracy, precision, recall and F1 of boolean columns."""
    p, a = F.col(predicted), F.col(actual)
    n = lambda c: F.sum(c.cast("long"))
    out = df.where(p.isNotNull() & a.isNotNull()).groupBy(*by).agg(n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"), n(~p & ~a).alias("tn"))
    d = lambda c: F.col(c).cast("double")
    out = out.withColumn("accuracy", ratio(d("tp") + d("tn"), d("tp") + d("tn") + d("fp") + d("fn")))
    out = out.withColumn("precision", ratio(d("tp"), d("tp") + d("fp"), 0.0)).withColumn("recall", ratio(d("tp"), d("tp") + d("fn"), 0.0))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))
