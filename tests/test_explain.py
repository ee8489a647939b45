from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quantspark.operators import explain, models

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(2).normal(size=(300, 3)) * [1, 5, 0.1] + [0, 100, 3]
    rows = [tuple(map(float, v)) for v in x]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0)], "a double, b double, c double").repartition(5), x


def curved(x):
    return np.sin(x[:, 0]) * x[:, 1] + x[:, 2] ** 2 + 1e6


def test_dependence_equals_every_row_and_value_tried(table):
    df, x = table
    got = explain.partial_dependence(df, NAMES, curved, points=9).collect()
    assert len(got) == 27 and {r.n for r in got} == {300}
    for k, name in enumerate(NAMES):
        grid = np.linspace(np.percentile(x[:, k], 5), np.percentile(x[:, k], 95), 9)
        mine = sorted((r for r in got if r.feature == name), key=lambda r: r.point)
        for r, v in zip(mine, grid, strict=True):
            put = x.copy()
            put[:, k] = v
            want = curved(put)
            assert abs(r.value - v) < 1e-9 and abs(r.mean - want.mean()) < 1e-7 and abs(r.std - want.std()) < 1e-7


def test_interactions_equal_their_definition(table):
    df, x = table

    def small(v):
        return v[:, 0] * v[:, 1] + v[:, 2]

    grids = [np.linspace(np.percentile(x[:, k], 5), np.percentile(x[:, k], 95), 5) for k in range(3)]

    def mean(score, **put):
        v = x.copy()
        for k, value in put.items():
            v[:, NAMES.index(k)] = value
        return score(v).mean()

    for one, two in (("a", "b"), ("a", "c")):
        g, h = grids[NAMES.index(one)], grids[NAMES.index(two)]
        joint = np.array([[mean(small, **{one: u, two: w}) for w in h] for u in g])
        left = joint - np.array([mean(small, **{one: u}) for u in g])[:, None] - np.array([mean(small, **{two: w}) for w in h])[None]
        want = min(1.0, (left**2).sum() / (joint**2).sum())
        assert abs(explain.interaction_strength(df, NAMES, one, two, small, points=5) - want) < 1e-9
    with pytest.raises(ValueError):
        explain.interaction_strength(df, NAMES, "a", "a", small)


def test_grids_and_tables_without_spread(spark, table):
    df, _ = table
    flat = df.withColumn("a", F.lit(2.0))
    got = explain.partial_dependence(flat, NAMES, curved, points=3, of=["a"]).collect()
    assert [r.value for r in sorted(got, key=lambda r: r.point)] == pytest.approx([2.0, 2.0000005, 2.000001])
    assert explain.partial_dependence(df.limit(0), NAMES, curved).count() == 0 and explain.interaction_strength(df.limit(0), NAMES, "a", "b", curved) == 0.0


def test_the_plain_function_scores_as_the_model(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(a + 0.3 * b + rng.normal() > 0)) for a, b in rng.normal(size=(400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    model = models.fit_direction(df, ["a", "b"])
    want = [(r.a, r.b, r.p) for r in model.transform(df).select("a", "b", vector_to_array("probability")[1].alias("p")).collect()]
    got = explain.logistic_score(model)(np.array([w[:2] for w in want]))
    assert np.allclose(got, [w[2] for w in want], atol=1e-12)
    # The averaged probability of two models is the mean of what each one says.
    both = models.predict_up(df.withColumn("id", F.monotonically_increasing_id()), [model, model], ["a", "b"], ["id"]).collect()
    assert len(both) == 400 and np.allclose(sorted(r.prob_up for r in both), sorted(w[2] for w in want), atol=1e-12)
