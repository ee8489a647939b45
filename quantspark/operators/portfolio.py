"""Portfolio weights by closed forms and small recursions; Spark gathers each group's moments and spreads the groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quantspark.operators.optimise import group_moments


def shrunk(matrix: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Towards a diagonal of the mean variance."""
    return (1 - share) * matrix + share * np.eye(len(matrix)) * np.trace(matrix) / max(len(matrix), 1)


def minimum_variance(matrix: np.ndarray) -> np.ndarray:
    w = np.linalg.solve(matrix, np.ones(len(matrix)))
    return w / w.sum()


def maximum_sharpe(means: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    w = np.linalg.solve(matrix, means)
    return w / np.abs(w).sum()


def risk_parity(matrix: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Equal contributions to risk by cyclic coordinate steps."""
    n = len(matrix)
    w = np.ones(n)
    for _ in range(rounds):
        for i in range(n):
            rest = matrix[i] @ w - matrix[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest * rest + 4 * matrix[i, i])) / (2 * matrix[i, i])
    return w / w.sum()


def hierarchical_risk_parity(matrix: np.ndarray) -> np.ndarray:
    """Assets ordered by single linkage of their correlation distance, weights split by inverse cluster variance."""
    n = len(matrix)
    d = np.sqrt(np.diag(matrix))
    distance = np.sqrt(np.clip((1 - matrix / np.outer(d, d)) / 2, 0, 1))
    groups: list[list[int]] = [[i] for i in range(n)]
    between = distance + np.diag(np.full(n, np.inf))
    for _ in range(n - 1):
        x, y = sorted(divmod(int(between.argmin()), n))
        groups[x] = groups[x] + groups[y]
        # The nearer of the two counts for the group that they make; the other leaves the table.
        between[x] = between[:, x] = np.minimum(between[x], between[y])
        between[x, x] = between[y] = between[:, y] = np.inf
    w = np.ones(n)
    todo = [groups[0]]

    def variance(part: list[int]) -> float:
        sub = matrix[np.ix_(part, part)]
        inverse = 1 / np.diag(sub)
        inverse /= inverse.sum()
        return float(inverse @ sub @ inverse)

    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        a, b = part[: len(part) // 2], part[len(part) // 2 :]
        share = 1 - variance(a) / (variance(a) + variance(b))
        w[a] *= share
        w[b] *= 1 - share
        todo += [a, b]
    return w


def allocations(spark: SparkSession, returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, asset, minimum_variance, maximum_sharpe, risk_parity, hierarchical): a group's moments are a row, and its four
    problems are solved where that row is."""
    kinds = dict(returns.dtypes)
    told = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"asset {kinds['asset']}"] + [f"{m} double" for m in ("minimum_variance", "maximum_sharpe", "risk_parity", "hierarchical")])

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                n = len(row.assets)
                matrix, means = shrunk(np.array(row.cov).reshape(n, n)), np.array(row.means)
                table = {"asset": row.assets, "minimum_variance": minimum_variance(matrix), "maximum_sharpe": maximum_sharpe(means, matrix), "risk_parity": risk_parity(matrix), "hierarchical": hierarchical_risk_parity(matrix)}
                yield pd.DataFrame({c: [getattr(row, c)] * n for c in by} | table)

    return group_moments(returns, by).mapInPandas(solved, told)


def monte_carlo(spark: SparkSession, mean: float, std: float, start: float = 1.0, paths: int = 10_000, horizon: int = 252, seed: int = 42, block: int = 1_000) -> DataFrame:
    """(path, final, max_drawdown): geometric paths in blocks, each seeded by its number, so any split gives the same paths."""

    def simulate(frames):
        for frame in frames:
            for k in frame["id"]:
                rng = np.random.default_rng([seed, int(k)])
                size = min(block, paths - int(k) * block)
                steps = rng.normal(mean - std * std / 2, std, (size, horizon))
                curve = start * np.exp(np.cumsum(steps, axis=1))
                peak = np.maximum.accumulate(np.maximum(curve, start), axis=1)
                yield pd.DataFrame({"path": np.arange(size) + int(k) * block, "final": curve[:, -1], "max_drawdown": (curve / peak - 1).min(axis=1)})

    return spark.range(-(-paths // block)).mapInPandas(simulate, "path long, final double, max_drawdown double")
