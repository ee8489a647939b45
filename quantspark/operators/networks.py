"""Graphs as edge tables: components, communities, betweenness, spanning trees and their clusters, density clusters.

Every step is a join or an aggregation over edges or nodes; the driver sees counts. Edges are (a, b, w) with a < b, each
once, and nodes are what edges name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.frames import cut

#: Sources in a strip and, about, nodes in a block: a tile of path counts takes two megabytes.
STRIP, BLOCK = 128, 2048


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to. Neighbours are handed to the smallest node that a
    node sees, larger and smaller ones in turn, until nothing moves."""
    state = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = _mark(state)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        state = cut(moved.unionByName(low.select("a", F.col("low").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before, mark = mark, _mark(state)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """The share of edge weight inside communities beyond what degrees alone would put there. members is (node, community)."""
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    if total <= 0:
        return 0.0
    one = edges.join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = one.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] / total
    degrees = _both_ways(edges.where("a <> b")).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    loops = edges.where("a = b").groupBy(F.col("a").alias("node")).agg((2 * F.sum("w")).alias("k"))
    sums = degrees.unionByName(loops).join(members.select("node", "community"), "node").groupBy("community").agg(F.sum("k").alias("k"))
    return float(inside - sums.agg(F.sum((F.col("k") / (2 * total)) * (F.col("k") / (2 * total)))).first()[0])


#: Gain of a round below which a level ends and communities become nodes.
LITTLE = 5e-4


def communities(edges: DataFrame, max_levels: int = 20, max_rounds: int = 12) -> DataFrame:
    """(node, community): communities of high modularity; a community is named by its smallest node.

    Nodes move to the neighbouring community that gains most, by the sums of their edge weights to it, until none gains;
    then communities become nodes and it starts again. In a round half of the nodes move at once, as long as that raises
    the modularity, then a quarter and an eighth; from then on only moves that share no community with a better one
    do, whose gains add up. So modularity never falls. Isolated nodes have no edges and no row; weights are positive.
    """
    graph = cut(edges.where("w > 0").select("a", "b", F.col("w").cast("double").alias("w")))
    total = graph.agg(F.sum("w")).first()[0]
    nodes = cut(graph.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    owner = nodes.select("node", F.col("node").alias("community"))
    if not total:
        return owner
    for _ in range(max_levels):
        moved, gained = _local_moves(graph, total, max_rounds)
        if not gained:
            break
        owner = cut(owner.join(moved.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")))
        one, two = moved.select(F.col("node").alias("a"), F.col("community").alias("ca")), moved.select(F.col("node").alias("b"), F.col("community").alias("cb"))
        graph = cut(graph.join(one, "a").join(two, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
    names = owner.groupBy("community").agg(F.min("node").alias("name"))
    return owner.join(names, "community").select("node", F.col("name").alias("community"))


def _local_moves(graph: DataFrame, total: float, max_rounds: int) -> tuple[DataFrame, bool]:
    links = _both_ways(graph.where("a <> b"))
    loops = graph.where("a = b").select(F.col("a").alias("node"), (2 * F.col("w")).alias("k"))
    degrees = links.select(F.col("a").alias("node"), F.col("w").alias("k")).unionByName(loops).groupBy("node").agg(F.sum("k").alias("k"))
    state = cut(degrees.select("node", "k", F.col("node").alias("community")))
    gained, parts = False, 1

    def worth(members: DataFrame) -> float:
        """The modularity, from one job: inner weights and squared degree sums as two rows."""
        one, two = members.select(F.col("node").alias("a"), F.col("community").alias("ca")), members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
        inside = graph.join(one, "a").join(two, "b").where("ca = cb").agg((F.coalesce(F.sum("w"), F.lit(0.0)) / total).alias("q"))
        sums = members.groupBy("community").agg(F.sum("k").alias("s")).agg((-F.sum(F.col("s") * F.col("s")) / (4 * total * total)).alias("q"))
        return sum(r["q"] for r in inside.unionByName(sums).collect())

    best = worth(state)
    for step in range(max_rounds):
        sums = state.groupBy("community").agg(F.sum("k").alias("s"))
        to = links.join(state.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), F.col("community").alias("next")).agg(F.sum("w").alias("w"))
        own = state.join(to, "node").where(F.col("next") == F.col("community")).select("node", F.col("w").alias("own"))
        rows = to.join(state, "node").where(F.col("next") != F.col("community")).join(own, "node", "left")
        rows = rows.join(sums, "community").withColumnRenamed("s", "leave").join(sums.select(F.col("community").alias("next"), F.col("s").alias("enter")), "next")
        gain = (F.col("w") - F.coalesce("own", F.lit(0.0))) / total - F.col("k") * (F.col("enter") - F.col("leave") + F.col("k")) / (2 * total * total)
        moves = rows.withColumn("gain", gain).where(F.col("gain") > 1e-12).groupBy("node", "community").agg(F.max_by(F.struct("next", "gain"), F.struct("gain", "next")).alias("m"))
        moves = cut(moves.select("node", "community", "m.next", "m.gain"))
        if moves.isEmpty():
            break
        part = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1 << parts)) == 0
        chosen = _apart(moves) if parts > 3 else moves.where(part)
        after = cut(state.join(chosen.select("node", "next"), "node", "left").select("node", "k", F.coalesce("next", "community").alias("community")))
        value = worth(after)
        if value > best + 1e-12:
            little = value - best < LITTLE and parts > 1
            state, best, gained = after, value, True
            if little:
                break
        elif parts > 3:
            break
        else:
            # Fewer at once, in the end only moves whose gains add up.
            parts += 1
    return state.select("node", "community"), gained


def _apart(moves: DataFrame) -> DataFrame:
    """Moves that are the best of both communities they touch: no two of them share one, so their gains add up."""
    rank = F.struct("gain", "node")
    touched = moves.select("node", "gain", F.explode(F.array("community", "next")).alias("c"))
    first = touched.groupBy("c").agg(F.max_by("node", rank).alias("node"))
    return moves.join(first.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("node"), "node", "left_semi")


def _tile(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, width)


def _led(tiles: DataFrame, matrix: DataFrame, own: DataFrame, name: str, combine: Callable[[np.ndarray, list[np.ndarray]], pd.DataFrame | None], width: int, schema: str) -> DataFrame:
    """(s, j, combined) of the tiles (s, j, name) times the matrix (i, j, ends) and the tiles own (s, j, data) at the same place."""
    moved = tiles.select("s", F.col("j").alias("i"), F.col(name).alias("data")).join(matrix, "i").select("s", "j", "data", "ends")
    rows = moved.unionByName(own.select("s", "j", "data", F.lit(None).cast("array<int>").alias("ends")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total, places = np.zeros((STRIP, width)), []
        for data, ends in zip(frame["data"], frame["ends"], strict=True):
            if ends is None:
                places.append(_tile(data, width))
                continue
            block = np.zeros(width * width)
            block[ends] = 1.0
            total += _tile(data, width) @ block.reshape(width, width)
        out = combine(total, places)
        names = [c.split()[0] for c in schema.split(", ")]
        if out is None:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ["s", "j", *names]})
        return pd.DataFrame([(frame["s"].iloc[0], frame["j"].iloc[0], *out)], columns=["s", "j", *names])

    return rows.groupBy("s", "j").applyInPandas(run, f"s int, j int, {schema}")


def betweenness(edges: DataFrame, sources: DataFrame | None = None, batches: int = 1, max_depth: int = 1000) -> DataFrame:
    """(node, betweenness): the share of shortest paths between two others that pass a node, over all pairs of others.

    Sources go level by level at once: a level's path counts are a matrix of sources by nodes, in tiles of STRIP by about
    BLOCK, and the next level's are its product with the links, in blocks of about BLOCK by BLOCK, where no level has been
    before; then the levels are gone back over, adding up what depends on each node. A task holds the tiles of one strip of
    sources and one block of links at a time. All sources cost the nodes cubed in multiplications, whatever the number of
    links; batches bound the tiles held at a time. With given sources (a table of node) the sums are scaled up by the share
    of nodes they are.
    """
    links = cut(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = cut(links.select(F.col("a").alias("node")).distinct())
    n = nodes.count()
    if n < 3:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    places = nodes.withColumn("j", F.pmod(F.xxhash64("node"), F.lit(math.ceil(n / BLOCK))).cast("int"))
    places = cut(places.withColumn("at", F.row_number().over(Window.partitionBy("j").orderBy("node")) - 1))
    width = places.agg(F.max("at") + 1).first()[0]
    ends = [places.select(F.col("node").alias(c), F.col("j").alias(j), F.col("at").alias(f"{c}_at")) for c, j in (("a", "i"), ("b", "j"))]
    matrix = links.join(ends[0], "a").join(ends[1], "b").groupBy("i", "j")
    matrix = cut(matrix.agg(F.collect_list((F.col("a_at") * width + F.col("b_at")).cast("int")).alias("ends")))
    starts = cut(places if sources is None else places.join(sources.select("node").distinct(), "node"))
    used = starts.count()
    strips = math.ceil(width / STRIP)

    def ones(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tiles = []
            for found in frame["ends"]:
                tile = np.zeros(STRIP * width)
                tile[found] = 1.0
                tiles.append(tile.tobytes())
            yield pd.DataFrame({"s": frame["s"], "j": frame["j"], "data": tiles})

    def onward(total: np.ndarray, near: list[np.ndarray]) -> tuple | None:
        for tile in near:
            total[tile > 0] = 0.0
        return (total.tobytes(),) if total.any() else None

    def shares(paths: np.ndarray, part: np.ndarray) -> tuple:
        share = np.divide(1 + part, paths, out=np.zeros_like(paths), where=paths > 0)
        return share.tobytes(), part.sum(axis=0)

    def backward(total: np.ndarray, own: list[np.ndarray]) -> tuple | None:
        return shares(own[0], own[0] * total) if own else None

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [shares(tile, np.zeros_like(tile)) for tile in (_tile(d, width) for d in frame["data"])]
            yield pd.DataFrame({"s": frame["s"], "j": frame["j"], "share": [f[0] for f in found], "part": [f[1] for f in found]})

    sums = None
    for batch in range(batches):
        mine = starts.withColumn("s", (F.col("j") * strips + F.floor(F.col("at") / STRIP)).cast("int")).where(F.pmod("s", F.lit(batches)) == batch)
        first = mine.groupBy("s", "j").agg(F.collect_list(((F.col("at") % STRIP) * width + F.col("at")).cast("int")).alias("ends"))
        levels = [cut(first.mapInPandas(ones, "s int, j int, data binary"))]
        for _ in range(max_depth):
            # Two levels back is enough: an edge leads one level on, to the same level or one back.
            near = levels[-1] if len(levels) < 2 else levels[-1].unionByName(levels[-2])
            level = cut(_led(levels[-1], matrix, near, "data", onward, width, "data binary"))
            if level.isEmpty():
                break
            levels.append(level)
        else:
            raise RuntimeError(f"paths longer than {max_depth}")
        below = cut(levels[-1].mapInPandas(last, "s int, j int, share binary, part array<double>"))
        for level in reversed(levels[:-1]):
            told = below.select("j", F.posexplode("part").alias("at", "part")).groupBy("j", "at").agg(F.sum("part").alias("part"))
            sums = told if sums is None else sums.unionByName(told)
            if level is not levels[0]:
                below = cut(_led(below, matrix, level, "share", backward, width, "share binary, part array<double>"))
    if sums is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    pairs = (n - 1) * (n - 2)
    total = sums.groupBy("j", "at").agg((F.sum("part") * (n / max(used, 1) / pairs)).alias("betweenness"))
    return places.join(total, ["j", "at"], "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(a, b, w): a least spanning tree of each component, equal weights by their nodes. In a round every component takes
    its least edge to another one; components at least halve, so rounds are few."""
    graph = cut(edges.where("a <> b AND w IS NOT NULL").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")))
    tree = graph.limit(0)
    state = cut(graph.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    while not state.isEmpty():
        ends = state.select("a", "b", "w", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to")))).alias("e"))
        first = cut(ends.groupBy("e.c").agg(F.min(F.struct("w", "a", "b", "e.to")).alias("m")).select("c", "m.*"))
        tree = tree.unionByName(first.select("a", "b", "w").distinct())
        # Every component points along its least edge; only the two that share the least edge of all point at each other.
        back = first.select(F.col("c").alias("to"), F.col("to").alias("again"))
        points = first.join(back, "to", "left").select("c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        while True:
            ahead = points.select(F.col("c").alias("to"), F.col("to").alias("far"))
            after = cut(points.join(ahead, "to", "left").select("c", "to", F.coalesce("far", "to").alias("far")))
            points = after.select("c", F.col("far").alias("to"))
            if after.where("far <> to").isEmpty():
                break
        one, two = points.select(F.col("c").alias("ca"), F.col("to").alias("na")), points.select(F.col("c").alias("cb"), F.col("to").alias("nb"))
        state = cut(state.join(one, "ca", "left").join(two, "cb", "left").select("a", "b", "w", F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb")).where("ca <> cb"))
    return tree


def single_linkage(pairs: DataFrame, height: float) -> DataFrame:
    """(node, cluster): what pairs (a, b, w) no farther apart than height link, by their least spanning tree; a cluster is
    named by its smallest node. The tree's weights are the heights at which clusters join."""
    tree = spanning_tree(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    joined = components(tree.where(F.col("w") <= height))
    return nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def correlation_distance(pairs: DataFrame) -> DataFrame:
    """(a, b, corr) as distances (a, b, w): one less the absolute correlation."""
    return pairs.where("a <> b").select("a", "b", (1 - F.abs(F.col("corr"))).alias("w"))


#: Points of a chunk.
CHUNK = 1024


def _chunk_pairs(left: DataFrame, right: DataFrame, radius: int, dims: int, work, told: str) -> DataFrame:
    """What work gives for the chunks of left and of right in its cell and the cells around; work gets two lists of points
    and the rows of both."""
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    cells = F.array(F.array().cast("array<long>"))

    def longer(k: int) -> Column:
        return F.flatten(F.transform(cells, lambda part: F.transform(reach, lambda d: F.concat(part, F.array(F.col("cell")[k] + d)))))

    for k in range(dims):
        cells = longer(k)
    around = left.withColumn("__near", F.explode(cells))
    other = right.select(F.col("cell").alias("__near"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    rows = around.join(other, "__near").drop("__near")
    return rows.mapInPandas(work, told)


def density_clusters(df: DataFrame, features: Sequence[str], eps: float = 0.5, least: int = 5, id_col: str = "id", scaled: bool = True) -> DataFrame:
    """(id, cluster, core): points with at least so many within eps, themselves counted, are cores; cores within eps of each
    other are a cluster, named by the smallest id of its cores; other points join the cluster with the smallest name
    among the cores near them, or none (null).

    Cells are so small that their points are all near each other: a full cell's points are cores without any pair being
    looked at. Pairs of other cells meet in chunks of bounded size, and equal points are one point with a count. One to
    four features; rows with a null or infinite one have no cluster. scaled: by mean and population deviation.
    """
    dims = len(features)
    if not 1 <= dims <= 4:
        raise ValueError("one to four features")
    whole = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)])
    fit = whole.where(_finite(dims))
    if scaled:
        m = fit.agg(*[F.avg(f"f{k}").alias(f"m{k}") for k in range(dims)], *[F.stddev_pop(f"f{k}").alias(f"s{k}") for k in range(dims)]).first()
        fit = fit.select("id", *[((F.col(f"f{k}") - (m[f"m{k}"] or 0.0)) / (m[f"s{k}"] or 1.0)).alias(f"f{k}") for k in range(dims)])
    # A little under the side at which corners are eps apart, so that rounding parts no such pair.
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    radius = math.ceil(math.sqrt(dims) * (1 + 1e-8))
    x = F.array(*[F.col(f"f{k}") + 0.0 for k in range(dims)])
    named = fit.withColumn("x", x)
    points = named.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    points = cut(points.select("x", "n", "low", F.transform("x", lambda v: F.floor(v / side)).alias("cell")))
    sizes = points.groupBy("cell").agg(F.sum("n").alias("inside"), F.count(F.lit(1)).alias("kinds"))
    points = points.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("x"), F.ceil(F.col("kinds") / CHUNK)))

    def chunks(rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy("cell", "chunk").agg(*[F.collect_list(c).alias(c) for c in ("x", "n", *more)])

    def far(a: Sequence, b: Sequence) -> np.ndarray:
        u, v = np.array(list(map(list, a))), np.array(list(map(list, b)))
        return ((u[:, None, :] - v[None, :, :]) ** 2).sum(axis=2) <= eps * eps

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found, near = [], []
            for r in frame.itertuples():
                found += [list(v) for v in r.x]
                near += (far(r.x, r.r_x) * np.array(r.r_n)[None, :]).sum(axis=1).tolist()
            yield pd.DataFrame({"x": pd.Series(found, dtype=object), "near": pd.Series(near, dtype="int64")})

    all_chunks = cut(chunks(points))
    sparse = chunks(points.where(F.col("inside") < least))
    counted = _chunk_pairs(sparse, all_chunks, radius, dims, count, "x array<double>, near long").groupBy("x").agg(F.sum("near").alias("near"))
    judged = points.join(counted, "x", "left").withColumn("core", (F.col("inside") >= least) | (F.coalesce("near", F.lit(0)) >= least))
    judged = cut(judged.select("x", "n", "low", "cell", "chunk", "core"))
    cores = cut(chunks(judged.where("core"), "low"))

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            met = [(r.cell, r.r_cell) for r in frame.itertuples() if tuple(r.cell) < tuple(r.r_cell) and far(r.x, r.r_x).any()]
            yield pd.DataFrame({"p": pd.Series([list(m[0]) for m in met], dtype=object), "q": pd.Series([list(m[1]) for m in met], dtype=object)})

    met = _chunk_pairs(cores, cores, radius, dims, linked, "p array<long>, q array<long>").distinct()
    first = cut(judged.where("core").groupBy("cell").agg(F.min("low").alias("name")))
    # A cell is named by its smallest core, so the smallest name of a component is the cluster's.
    edges = met.join(first.select(F.col("cell").alias("p"), F.col("name").alias("a")), "p").join(first.select(F.col("cell").alias("q"), F.col("name").alias("b")), "q").select("a", "b")
    joined = components(edges)
    cells = cut(first.join(joined, first["name"] == joined["node"], "left").select("cell", F.coalesce("component", "name").alias("cluster")))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found, names = [], []
            for r in frame.itertuples():
                hit = far(r.x, r.r_x).any(axis=1)
                found += [list(v) for v, h in zip(r.x, hit, strict=True) if h]
                names += [r.r_cluster] * int(hit.sum())
            yield pd.DataFrame({"x": pd.Series(found, dtype=object), "cluster": pd.Series(names, dtype=frame["r_cluster"].dtype)})

    kind = dict(cells.dtypes)["cluster"]
    edge = chunks(judged.where("NOT core"))
    told = cores.drop("low").join(cells, "cell")
    border = _chunk_pairs(edge, told, radius, dims, nearest, f"x array<double>, cluster {kind}").groupBy("x").agg(F.min("cluster").alias("cluster"))
    of_cell = judged.where("core").join(cells, "cell").select("x", "cluster", F.lit(True).alias("core"))
    found = of_cell.unionByName(border.select("x", "cluster", F.lit(False).alias("core")))
    out = named.select("id", "x").join(found, "x", "left").select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))
    left = whole.where(~_finite(dims)).select("id", F.lit(None).cast(kind).alias("cluster"), F.lit(False).alias("core"))
    return out.unionByName(left)


def _finite(dims: int) -> Column:
    out = F.lit(True)
    for k in range(dims):
        out = out & F.coalesce(F.abs(f"f{k}") < float("inf"), F.lit(False))
    return out
