from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from quantspark.llm import elkan, queries


def brute(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    """Every distance of every round in Python integers."""
    kept = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        got = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), g in zip(kept, got, strict=True) if g == j]
            if mine:
                centres[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    final = [nearest(x) for _, x in kept]
    inertia = [sum(d for d, j in final if j == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia), digest[j]) for (i, _), (d, j) in zip(kept, final, strict=True)), key=str)


def digest(df):
    return sorted((tuple(r)[:6] for r in elkan.cluster_digest(df).collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_equals_a_search_of_all_centroids(spark):
    rng = np.random.default_rng(5)
    around = rng.normal(size=(12, 64)) * 0.3
    rows = [(i, [float(np.float32(v)) for v in around[i % 12] + rng.normal(size=64) * 0.1]) for i in range(400)]
    df = vectors(spark, rows).repartition(5)
    assert digest(df) == brute(rows)
    found, _ = elkan.elkan_clusters(df)
    assert found.selectExpr("sum(calculated)").first()[0] < 0.5 * 400 * 8 * 11


def test_ties_and_equal_centroids_go_to_the_smaller_number(spark):
    # Components of -1, 0 and 1 thousandths: many equal distances, and several starting centroids are equal.
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) / 1024 for v in (rng.integers(-1, 2, 3).tolist() + [0] * 61)]) for i in range(200)]
    assert digest(vectors(spark, rows)) == brute(rows)


def test_bounds_prune_only_what_cannot_win_or_tie():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (300, 4)).astype(np.int64)
    centroids = elkan.Centroids(rng.integers(-3, 4, (6, 4)).astype(np.int64))
    state = (np.full(300, -1), np.zeros(300), np.zeros((300, 6)))
    for _ in range(8):
        cluster, upper, lower, _ = elkan.assign(x, *state, centroids)
        exact = ((x[:, None] - centroids.at) ** 2).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all()
        assert (upper >= np.sqrt(exact[np.arange(300), cluster])).all() and (lower <= np.sqrt(exact)).all()
        moved = elkan.Centroids(centroids.at + rng.integers(-1, 2, (6, 4)))
        moved.moved = elkan._up(np.sqrt(((moved.at - centroids.at) ** 2).sum(axis=1).astype(float)))
        state, centroids = (cluster, elkan._up(upper + moved.moved[cluster]), elkan._down(lower - moved.moved)), moved


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(v)) for v in rng.uniform(-60_000, 60_000, 64)]) for i in range(60)]
    assert digest(vectors(spark, rows)) == brute(rows)


def test_awkward_vectors(spark):
    one = [0.25] * 64
    rows = [(1, one), (1, one), (None, [0.5] * 64), (2, None), (3, []), (4, [1.0] * 63), (5, [None] + [0.0] * 63), (6, [float("nan")] + [0.0] * 63), (7, [float("inf")] * 64), (8, [0.1] * 5000), (9, [-0.0001] * 64), (10, [1e30] * 64)]
    df = vectors(spark, rows).selectExpr("*", "1 AS cluster", "2L AS distance", "'x' AS x")
    got = digest(df)
    assert got == brute([r for r in rows if r[0] != 10]) and len(got) == 4
    assert elkan.cluster_digest(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_query_equals_brute_force_and_its_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    got = sorted(tuple(r)[:6] for r in queries.op11_elkan_clusters(spark, path).collect())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert got == sorted(brute(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    told = con.execute(queries.oracle_sql()["op11_elkan_clusters"]).fetchall()
    assert sorted(told) == got
