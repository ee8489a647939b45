"""What a fitted model makes of its features: partial dependence and interactions over all rows.

A model is a function from an array of rows to an array of scores. Rows are scored in Arrow batches with each grid value
put in their place inside the batch; what leaves a task is a sum for each grid point, so no row is shuffled, let alone
once per grid point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.operators.quantiles import exact

Score = Callable[[np.ndarray], np.ndarray]


def grid_of(df: DataFrame, feature: str, points: int = 50, between: tuple[float, float] = (5.0, 95.0)) -> np.ndarray:
    """Evenly spaced values between two percentiles of a feature; where these are equal, between its least and its largest
    value, and a little beyond if all are equal. Empty without rows."""
    known = df.where(F.col(feature).isNotNull()).select(F.col(feature).cast("double").alias("__v"))
    low = known.agg(F.min("__v").alias("least"), F.max("__v").alias("most")).first()
    if low["least"] is None:
        return np.zeros(0)
    ends = exact(known, "__v", {"a": between[0] / 100, "b": between[1] / 100}).first()
    a, b = ends["a"], ends["b"]
    if a == b:
        a, b = low["least"], low["most"]
    return np.linspace(a, b if b > a else a + 1e-6, points)


def _sums(df: DataFrame, features: Sequence[str], settings: Sequence[tuple[tuple[int, float], ...]], score: Score) -> pd.DataFrame:
    """Mean and deviation of the scores of all rows, under each setting of some features; one small row a task and setting
    is shuffled."""
    rows = df.dropna(subset=list(features)).select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, base = 0, None
        total = np.zeros((2, len(settings)))
        for frame in frames:
            x = frame.to_numpy(float)
            if not len(x):
                continue
            for k, setting in enumerate(settings):
                put = x.copy()
                for place, value in setting:
                    put[:, place] = value
                found = np.asarray(score(put), float)
                found = found.mean(axis=1) if found.ndim > 1 else found
                # Squares are summed around the first score, so that large scores keep their digits.
                base = np.full(len(settings), np.nan) if base is None else base
                base[k] = found[0] if np.isnan(base[k]) else base[k]
                total[:, k] += (found - base[k]).sum(), ((found - base[k]) ** 2).sum()
            n += len(x)
        if n:
            mean = base + total[0] / n
            yield pd.DataFrame({"k": np.arange(len(settings)), "n": n, "mean": mean, "apart": total[1] - total[0] ** 2 / n})

    parts = rows.mapInPandas(run, "k int, n long, mean double, apart double")
    sums = parts.groupBy("k").agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("apart").alias("within"), F.collect_list(F.struct("n", "mean")).alias("parts"))
    between = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    out = sums.select("k", "n", "mean", F.sqrt((F.col("within") + between) / F.col("n")).alias("std"))
    return out.orderBy("k").toPandas()


def partial_dependence(df: DataFrame, features: Sequence[str], score: Score, points: int = 50, between: tuple[float, float] = (5.0, 95.0), of: Sequence[str] | None = None) -> DataFrame:
    """(feature, point, value, mean, std, n): the mean score and its deviation over all rows when a feature is set to each
    value of its grid. Rows that lack a feature are left out. All features (or those of `of`) share one pass."""
    names = list(of or features)
    known = df.dropna(subset=list(features))
    settings = [(name, k, v) for name in names for k, v in enumerate(grid_of(known, name, points, between))]
    told = "feature string, point int, value double, mean double, std double, n long"
    found = _sums(known, features, [((list(features).index(name), float(v)),) for name, _, v in settings], score)
    rows = [(name, k, float(v), float(r.mean), float(r.std), int(r.n)) for (name, k, v), r in zip(settings, found.itertuples(index=False), strict=True)]
    return df.sparkSession.createDataFrame(rows, told)


def interaction_strength(df: DataFrame, features: Sequence[str], one: str, two: str, score: Score, points: int = 20) -> float:
    """The share of the joint effect of two features that the sum of their single effects leaves, between 0 and 1, over the
    grid of both; all settings are scored in one pass."""
    if one == two:
        raise ValueError("two different features are needed")
    known = df.dropna(subset=list(features))
    i, j = list(features).index(one), list(features).index(two)
    a, b = grid_of(known, one, points).tolist(), grid_of(known, two, points).tolist()
    if not a:
        return 0.0
    settings = [((i, v),) for v in a] + [((j, v),) for v in b] + [((i, u), (j, v)) for u in a for v in b]
    mean = _sums(known, features, settings, score)["mean"].to_numpy()
    first, second, joint = mean[: len(a)], mean[len(a) : len(a) + len(b)], mean[len(a) + len(b) :].reshape(len(a), len(b))
    below = float((joint**2).sum())
    left = float(((joint - first[:, None] - second[None, :]) ** 2).sum())
    return 0.0 if below < 1e-10 else min(1.0, max(0.0, left / below))


def logistic_score(model: PipelineModel) -> Score:
    """The probability that a fitted pipeline of assembler, scaler and logistic regression gives, as a plain function."""
    scaler, last = model.stages[1], model.stages[-1]
    spread = np.array(scaler.std.toArray())
    weights = np.array(last.coefficients.toArray()) / np.where(spread > 0, spread, np.inf)
    centre, bias = np.array(scaler.mean.toArray()), float(last.intercept)
    return lambda x: 1 / (1 + np.exp(-((x - centre) @ weights + bias)))
