from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quantspark.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(links by id, component by id) of every pair of usable vectors of a label."""
    usable = [(i, np.array(v, np.float64), label) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a, p) in enumerate(usable):
        for j, b, q in usable[k + 1 :]:
            if p == q and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= pivots.MIN_COSINE:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return links, {i: find(i) for i in root}


def near(rng, x, cosine):
    e = rng.normal(size=x.shape)
    e -= (e @ x) * x
    e /= np.linalg.norm(e)
    return cosine * x + np.sqrt(1 - cosine**2) * e


def unit(rng, n):
    x = rng.normal(size=n)
    return x / np.linalg.norm(x)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(500):
        x = unit(rng, 64)
        rows += [(3 * k, x.tolist(), k % 3), (3 * k + 1, near(rng, x, rng.uniform(0.931, 0.99)).tolist(), k % 3), (3 * k + 2, near(rng, x, rng.uniform(0.5, 0.92)).tolist(), k % 3)]
    got = pivots.embedding_groups(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("vec_id").n_links
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), label) for i, v, label in rows]
    want, _ = brute(rows)
    assert all(got[i] <= want[i] for i in want)
    assert got.sum() >= 0.95 * sum(want.values())


def test_long_lists_get_pivots_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(pivots, "MAX_PIVOTS", 16)
    monkeypatch.setattr(pivots, "LONG", 60)
    monkeypatch.setattr(pivots, "CHUNK", 32)
    made = []
    monkeypatch.setattr(pivots, "_described", lambda cells, scratch, name, f=pivots._described: made.append(name) or f(cells, scratch, name))
    rng = np.random.default_rng(6)
    rows = []
    for k in range(450):
        x = unit(rng, 48)
        rows += [(2 * k, x.tolist(), 1), (2 * k + 1, near(rng, x, rng.uniform(0.931, 0.99)).tolist(), 1)]
    centre = unit(rng, 48)
    rows += [(2000 + i, near(rng, centre, 0.98).tolist(), 1) for i in range(100)]
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), label) for i, v, label in rows]
    got = pivots.embedding_groups(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("vec_id").n_links
    want, _ = brute(rows)
    assert len(made) > 1 and all(got[i] <= want[i] for i in want)
    assert got.sum() >= 0.9 * sum(want.values())


def test_dense_group_copies_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 16)
    rng = np.random.default_rng(2)
    centre = unit(rng, 32)
    rows = [(i, near(rng, centre, 0.99).tolist(), 1) for i in range(120)] + [(200 + i, centre.tolist(), 1) for i in range(50)] + [(300 + i, unit(rng, 32).tolist(), 1) for i in range(100)]
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), label) for i, v, label in rows]
    out = pivots.embedding_groups(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("vec_id")
    want, component = brute(rows)
    assert out.n_links.to_dict() == want and out.component_id.to_dict() == component
    assert (out.kept == (out.index == out.component_id)).all()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, None, 1),
        (1, [0.0, 0.0], 1),
        (2, [1.0, None], 1),
        (3, [nan, 1.0], 1),
        (4, [inf, 1.0], 1),
        (5, [], 1),
        (6, [1.0, 0.0], None),
        (7, [1.0, 0.0], 1),
        (8, [2.0, 0.0], 1),
        (9, [1.0, -0.0], 1),
        (10, [1.0, 0.0, 0.0], 1),
        (11, [1.0, 0.0], 2),
    ]
    out = pivots.embedding_groups(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], f"{SCHEMA}, row int, class int, v string")).toPandas().set_index("vec_id")
    assert len(out) == 12
    assert out.n_links[[7, 8, 9]].tolist() == [2, 2, 2] and out.component_id[[7, 8, 9]].tolist() == [7, 7, 7]
    others = [i for i in range(12) if i not in (7, 8, 9)]
    assert (out.n_links[others] == 0).all() and out.kept[others].all()
    assert pivots.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("scale", [1e-30, 1e30])
def test_scale_does_not_matter(spark, scale):
    rows = [(1, [scale, 0.0], 1), (2, [scale * 2, scale * 0.1], 1)]
    assert pivots.embedding_groups(spark.createDataFrame(rows, SCHEMA)).where("n_links = 1").count() == 2


@pytest.mark.parametrize("count", [16, 64, 512, 4096, pivots.MAX_PIVOTS])
def test_recall_does_not_fall_with_the_number_of_pivots(count):
    rng = np.random.default_rng(3)
    x = [unit(rng, 64) for _ in range(600)]
    y = [near(rng, v, rng.uniform(0.931, 0.95)) for v in x]
    drawn = np.random.default_rng(4).normal(size=(count, 64))
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
    frame = pd.DataFrame({"class": range(1200), "label": "a", "dim": 64, "cell": "", "v": x + y, "copies": 1, "earlier": [[]] * 1200})
    out = pivots._describe(frame, pd.DataFrame({"pivots": [drawn.tobytes()]}))
    looked_up = int(out["looked_up"].iloc[0]) if "looked_up" in out else pivots.LOOKED_UP
    perm = [p.tolist() for p in out["perm"]]
    met = [len({*a} & {*b}) >= pivots.SHARED and bool({*a[:looked_up]} & {*b[:looked_up]}) for a, b in zip(perm[:600], perm[600:], strict=True)]
    assert np.mean(met) >= 0.97
