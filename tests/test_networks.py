from __future__ import annotations

from collections import deque
from itertools import combinations

import numpy as np
import pytest

from quantspark.operators import networks


def graph(spark, edges):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in edges], "a long, b long, w double")


def random_edges(rng, n, p, weights=False):
    return [(a, b, round(rng.uniform(0.1, 2), 3) if weights else 1.0) for a, b in combinations(range(n), 2) if rng.random() < p]


def score(edges, part):
    total = sum(w for *_, w in edges)
    degree = np.zeros(len(part))
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
    return sum(w for a, b, w in edges if part[a] == part[b]) / total - sum((sum(degree[i] for i in range(len(part)) if part[i] == c) / (2 * total)) ** 2 for c in set(part))


def partitions(n):
    def grow(part):
        if len(part) == n:
            yield part
        else:
            for c in range(max(part) + 2):
                yield from grow([*part, c])

    return grow([0])


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = random_edges(rng, 40, 0.04) + [(100 + k, 101 + k, 1.0) for k in range(30)]
    got = {r.node: r.component for r in networks.components(graph(spark, edges)).collect()}
    root = {v: v for e in edges for v in e[:2]}
    for _ in range(50):
        for a, b, _w in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


@pytest.mark.parametrize("seed", [1, 4])
def test_communities_are_near_the_best_partition(spark, seed):
    rng = np.random.default_rng(seed)
    edges = random_edges(rng, 8, 0.4, True)
    edges += [(v, (v + 1) % 8, 0.2) for v in range(8) if not any(v in e[:2] for e in edges)]
    edges = [(min(a, b), max(a, b), w) for a, b, w in edges]
    members = networks.communities(graph(spark, edges))
    got = {r.node: r.community for r in members.collect()}
    best = max(score(edges, p) for p in partitions(8))
    assert score(edges, [got[v] for v in range(8)]) >= 0.99 * best
    assert abs(networks.modularity(graph(spark, edges), members) - score(edges, [got[v] for v in range(8)])) < 1e-12
    assert all(got[c] == c for c in got.values())


def test_planted_blocks_are_found(spark):
    rng = np.random.default_rng(7)
    edges = [(a, b, 1.0) for a, b in combinations(range(24), 2) if rng.random() < (0.8 if a // 8 == b // 8 else 0.04)]
    got = {r.node: r.community for r in networks.communities(graph(spark, edges)).collect()}
    assert [got[v] for v in range(24)] == [v // 8 * 8 for v in range(24)]
    assert networks.communities(graph(spark, [])).count() == 0


def passed(n, edges):
    """Every shortest path of every pair, written out."""
    near = {v: set() for v in range(n)}
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    out = np.zeros(n)
    for s, t in combinations(range(n), 2):
        found, size, todo = [], None, deque([[s]])
        while todo:
            path = todo.popleft()
            if size and len(path) > size:
                break
            if path[-1] == t:
                found, size = [*found, path], len(path)
                continue
            todo.extend([*path, v] for v in near[path[-1]] if v not in path)
        for path in found:
            for v in path[1:-1]:
                out[v] += 1 / len(found)
    return out / ((n - 1) * (n - 2) / 2)


def test_betweenness_equals_its_definition(spark):
    rng = np.random.default_rng(3)
    edges = random_edges(rng, 11, 0.28) + [(8, 9, 1.0), (9, 10, 1.0), (0, 8, 1.0)]
    edges = sorted({(a, b, 1.0) for a, b, _ in edges})
    nodes = {v for e in edges for v in e[:2]}
    assert nodes == set(range(11))
    want = passed(11, edges)
    for batches in (1, 3):
        got = {r.node: r.betweenness for r in networks.betweenness(graph(spark, edges), batches=batches).collect()}
        assert all(abs(got[v] - want[v]) < 1e-12 for v in range(11))
    assert [r.betweenness for r in networks.betweenness(graph(spark, [(1, 2, 1.0)])).collect()] == [0.0, 0.0]
    some = networks.betweenness(graph(spark, edges), sources=spark.createDataFrame([(v,) for v in range(11)], "node long"))
    assert all(abs(r.betweenness - want[r.node]) < 1e-12 for r in some.collect())


def test_betweenness_in_many_tiles_equals_its_definition(spark, monkeypatch):
    monkeypatch.setattr(networks, "STRIP", 3)
    monkeypatch.setattr(networks, "BLOCK", 6)
    edges = sorted({(a, b, 1.0) for a, b, _ in random_edges(np.random.default_rng(5), 13, 0.2)} | {(v, v + 1, 1.0) for v in range(12)})
    want = passed(13, edges)
    got = {r.node: r.betweenness for r in networks.betweenness(graph(spark, edges)).collect()}
    assert all(abs(got[v] - want[v]) < 1e-12 for v in range(13))
    none = networks.betweenness(graph(spark, edges), sources=spark.createDataFrame([], "node long"))
    assert {r.betweenness for r in none.collect()} == {0.0}


def linkage(n, w, cut):
    """Clusters joined at their least distance, one by one; (heights, clusters at cut)."""
    groups, heights, at_cut = [{v} for v in range(n)], [], None
    while len(groups) > 1:
        d, i, j = min((min(w[a][b] for a in groups[i] for b in groups[j]), i, j) for i, j in combinations(range(len(groups)), 2))
        if at_cut is None and d > cut:
            at_cut = [set(g) for g in groups]
        heights.append(d)
        groups[i] |= groups.pop(j)
    return heights, at_cut or groups


def test_spanning_tree_heights_and_cuts_equal_single_linkage(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(18, 2))
    w = np.round(np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)), 1)
    pairs = graph(spark, [(a, b, w[a][b]) for a, b in combinations(range(18), 2)])
    heights, groups = linkage(18, w, 0.6)
    tree = networks.spanning_tree(pairs).collect()
    assert len(tree) == 17 and sorted(r.w for r in tree) == sorted(heights)
    got = {r.node: r.cluster for r in networks.single_linkage(pairs, 0.6).collect()}
    assert got == {v: min(g) for g in groups for v in g}
    parts = networks.spanning_tree(graph(spark, [(1, 2, 1.0), (2, 3, 2.0), (1, 3, 0.5), (8, 9, 4.0)])).collect()
    assert sorted((r.a, r.b) for r in parts) == [(1, 2), (1, 3), (8, 9)]


def dense(x, eps, least):
    n = len(x)
    near = ((x[:, None] - x) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    name = list(range(n))
    for _ in range(n):
        for i in range(n):
            if core[i]:
                name[i] = min(name[j] for j in range(n) if near[i, j] and core[j])
    return [(i, name[i] if core[i] else min((name[j] for j in range(n) if near[i, j] and core[j]), default=None), bool(core[i])) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_density_clusters_equal_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(networks, "CHUNK", 8)
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 0.25, (60, dims)), rng.normal(2, 0.3, (50, dims)), rng.uniform(-3, 5, (40, dims)), np.zeros((20, dims))])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"c{k} double" for k in range(dims)))
    got = networks.density_clusters(df, [f"c{k}" for k in range(dims)], eps=0.4, least=5, scaled=False)
    assert sorted(tuple(r) for r in got.collect()) == dense(x, 0.4, 5) or sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, dense(x, 0.4, 5)))


def test_density_of_awkward_rows(spark):
    rows = [(i, 1.0, 2.0) for i in range(300)] + [(1000, None, 1.0), (1001, float("nan"), 1.0), (1002, float("inf"), 0.0), (1003, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: (r.cluster, r.core) for r in networks.density_clusters(df, ["x", "y"]).collect()}
    assert all(got[i] == (0, True) for i in range(300)) and all(got[i] == (None, False) for i in (1000, 1001, 1002, 1003))
    assert networks.density_clusters(df.limit(0), ["x", "y"]).count() == 0
