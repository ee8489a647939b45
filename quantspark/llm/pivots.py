"""Embedding near-duplicates by a pivot-permutation index.

Reference vectors (pivots) are drawn by hash from each class of the data. A vector is described by its nearest
pivots in order of nearness. Inverted lists hold, for each pivot, the vectors that have it among their first ones; a
vector is looked up in the lists of its very first pivots, shared pivots are counted, and candidates that share
enough are verified by cosine in double precision.

A list that stays long although the label has as many pivots as one task handles gets pivots of its own, from its own
vectors, and so on: lists stay short however large a label is. Lists are cut into chunks of bounded size and a task
compares one pair of chunks as blocks, so a list of vectors that are all alike, which no pivot parts, is spread over
many tasks. Pairs never leave a task: each vector is told how many it links with and whom it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import Scratch, connected_components

MIN_COSINE = 0.93
#: Pivots in a description and those that a vector is looked up by, where a label has few pivots, and pivots that two
#: descriptions must share.
DESCRIBED = 8
LOOKED_UP = 3
SHARED = 2
#: Up to so many pivots are few. Near vectors agree on fewer of their first pivots the more there are, so each
#: GROWTH-fold number of pivots has vectors looked up by one more.
FEW_PIVOTS = 64
GROWTH = 8
#: Vectors for each pivot, at least and at most so many pivots for each label or list.
PER_PIVOT = 64
MIN_PIVOTS = 16
MAX_PIVOTS = 4_096
#: A longer list gets pivots of its own, unless it holds more than SHARE of what it was made from.
LONG = 4_096
SHARE = 0.5
MAX_PIVOT_COSINE = 0.6
#: Vectors that one task describes, and vectors in a chunk of an inverted list.
PART = 8192
CHUNK = 512


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, *further: str) -> DataFrame:
    """(id, label, v) and further columns of the rows that can link: label known, vector neither null, empty, zero nor with components
    that are null or not finite. Single precision stays until the comparison: it is half of what is shuffled."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), *further)
    return rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False)))


def _units(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def depths(pivots: int) -> tuple[int, int]:
    """(pivots that a vector is looked up by, pivots in its description) in a label of so many pivots."""
    looked_up, few = LOOKED_UP, FEW_PIVOTS
    while few < pivots:
        looked_up, few = looked_up + 1, few * GROWTH
    return looked_up, max(DESCRIBED, 4 * (looked_up - 2))


CELL = ("label", "dim", "cell")
VECTOR = ("class", *CELL, "v", "copies", "earlier")


def _describe(frame: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """The ordered nearest pivots of each vector of one label or list, or of a part of it."""
    if not len(frame) or not len(pivots):
        return pd.DataFrame({c: [] for c in (*VECTOR, "perm", "looked_up")})
    x = _units(frame["v"])
    near = x @ np.frombuffer(pivots["pivots"].iloc[0], np.float64).reshape(-1, x.shape[1]).T
    looked_up, described = depths(near.shape[1])
    k = min(described, near.shape[1])
    # Ties go to the pivot of the smaller number: the sort is stable.
    perm = np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int32)
    return frame[list(VECTOR)].assign(perm=list(perm), looked_up=np.int32(looked_up))


def _compare(pivot: int, left: pd.DataFrame, right: pd.DataFrame | None, min_cosine: float) -> pd.DataFrame:
    """What two chunks of one list (or a chunk and itself) say about each vector: how many others it links with, and
    the smallest vector that links within these chunks reach.

    A pair counts where enough pivots are shared and the cosine reaches the bound. A pair that meets in several lists
    counts in the one of the smallest pivot, on every level: earlier names the smaller pivots under which a vector was
    looked up. Pairs themselves never leave the task.
    """
    other = left if right is None else right
    a, b = _units(left["v"]), _units(other["v"])
    first, second = (np.stack(f["perm"].to_numpy()) for f in (left, other))
    known, packed = np.unique(np.concatenate([first.ravel(), second.ravel()]), return_inverse=True)
    packed = packed.reshape(-1, first.shape[1])

    def marks(places: np.ndarray) -> np.ndarray:
        m = np.zeros((len(places), len(known) + 1), np.float32)
        np.put_along_axis(m, places, 1.0, axis=1)
        return m[:, :-1]

    def shares(level: int) -> np.ndarray:
        """Whether vectors of both chunks share an earlier pivot of a level above."""
        sets = [[list(e[level]) for e in f["earlier"]] for f in (left, other)]
        kinds = {p: i for i, p in enumerate(sorted({p for part in sets for e in part for p in e}))}
        m = [np.zeros((len(part), len(kinds)), np.float32) for part in sets]
        for table, part in zip(m, sets, strict=True):
            for i, e in enumerate(part):
                table[i, [kinds[p] for p in e]] = 1.0
        return m[0] @ m[1].T > 0

    p, q = packed[: len(first)], packed[len(first) :]
    hit = (a @ b.T >= min_cosine) & (marks(p) @ marks(q).T >= min(SHARED, first.shape[1]))
    here, looked_up = np.searchsorted(known, pivot), int(left["looked_up"].iloc[0])
    earlier = lambda x: np.where(x[:, :looked_up] < here, x[:, :looked_up], len(known))
    hit &= marks(earlier(p)) @ marks(earlier(q)).T == 0
    for level in range(len(left["earlier"].iloc[0])):
        hit &= ~shares(level)
    if right is None:
        np.fill_diagonal(hit, False)
    ids, others = left["class"].to_numpy(), other["class"].to_numpy()
    low, low_other = ids.copy(), others.copy()
    while True:
        next_low = np.minimum(low, np.where(hit, low_other, low[:, None]).min(axis=1))
        next_other = np.minimum(low_other, np.where(hit, next_low[:, None], low_other).min(axis=0))
        if right is None:
            next_low = next_other = np.minimum(next_low, next_other)
        if (next_low == low).all() and (next_other == low_other).all():
            break
        low, low_other = next_low, next_other
    out = [pd.DataFrame({"class": ids, "linked": hit @ other["copies"].to_numpy(), "root": low})]
    if right is not None:
        out.append(pd.DataFrame({"class": others, "linked": left["copies"].to_numpy() @ hit, "root": low_other}))
    told = pd.concat(out, ignore_index=True)
    return told[told["linked"] > 0]


def _described(cells: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """cells(VECTOR) with perm and looked_up. Cells of many vectors are described in parts, each of which gets the
    pivots, MAX_PIVOTS at most, once."""
    sizes = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*CELL, "n", F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.least(F.lit(MAX_PIVOTS), F.greatest(F.lit(MIN_PIVOTS), F.floor(F.col("n") / PER_PIVOT))).cast("long").alias("m"))
    dealt = cells.join(sizes, list(CELL)).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    # Pivots by hash threshold: a few more than wanted are drawn, so that no list is sorted.
    draw = F.pmod(F.xxhash64("class", "cell"), F.lit(1 << 20))
    drawn = dealt.where(draw * F.col("n") < F.lit(1.2 * (1 << 20)) * F.col("m") + F.lit(1 << 20))
    packed = drawn.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("class").alias("h"), "v")))["v"].alias("vs"))
    packed = packed.mapInPandas(_pack, "label string, dim int, cell string, pivots binary")
    pivots = packed.join(sizes.select(*CELL, "parts"), list(CELL)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = (*CELL, "part")
    kinds = dict(cells.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in VECTOR), "perm array<int>", "looked_up int"])
    both = dealt.select(*VECTOR, "part").groupBy(*keys).cogroup(pivots.select("pivots", *keys).groupBy(*keys))
    return scratch.save(both.applyInPandas(_describe, schema).join(sizes.select(*CELL, F.col("n").alias("made_of")), list(CELL)), name)


def vector_links(classes: DataFrame, scratch: Scratch, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Rows (class, linked, root), several for a class, from distinct vectors (class, label, dim, v, copies): linked
    adds up to the vectors linked with the class, copies included; links (class, root) connect what links connect."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        pivot = int(frame["pivot"].iloc[0])
        if frame["i"].iloc[0] == frame["j"].iloc[0]:
            return _compare(pivot, frame, None, min_cosine)
        first, second = frame[~frame["second"]], frame[frame["second"]]
        if not len(first) or not len(second):
            return pd.DataFrame({"class": [], "linked": [], "root": []}, dtype="int64")
        return _compare(pivot, first, second, min_cosine)

    cells = classes.select("*", F.lit("").alias("cell"), F.array().cast("array<array<int>>").alias("earlier"))
    found, level = None, 0
    while True:
        described = _described(cells.select(*VECTOR), scratch, f"described-{level}")
        # The lists: each vector under every pivot that it is looked up by.
        posted = described.select("*", F.explode(F.slice("perm", F.lit(1), F.col("looked_up"))).alias("pivot"))
        lengths = posted.groupBy(*CELL, "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("made_of").alias("made_of")).where("n > 1")
        long = (F.col("n") > LONG) & (F.col("n") < SHARE * F.col("made_of"))
        lengths = scratch.save(lengths.select(*CELL, "pivot", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), long.alias("long")), f"lengths-{level}")
        listed = posted.drop("made_of").join(lengths, [*CELL, "pivot"])
        # Chunk numbers spread lists. A pair of chunks (i, j), i <= j, meets in one task: chunk i goes to every (i, j) and (k, i).
        short = listed.where(~F.col("long")).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
        pairs = short.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
            "class", "v", "copies", "perm", "looked_up", "earlier", *CELL, "pivot", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).alias("second")
        )
        links = scratch.save(pairs.groupBy(*CELL, "pivot", "i", "j").applyInPandas(compare, "class long, linked long, root long"), f"links-{level}")
        found = links if found is None else found.unionByName(links)
        if lengths.where("long").isEmpty():
            return found
        # Every level makes cells at most half as large as those before, so this ends.
        before = F.filter(F.slice("perm", F.lit(1), F.col("looked_up")), lambda p: p < F.col("pivot"))
        below = listed.where("long").select("class", "label", "dim", F.concat_ws("/", "cell", "pivot").alias("cell"), "v", "copies", F.concat("earlier", F.array(before)).alias("earlier"))
        level += 1
        cells = scratch.save(below, f"cells-{level}")


def _apart(units: np.ndarray, most: float) -> np.ndarray:
    """The pivots, in order, without those nearer than most to an earlier one: a dense group then has one pivot and
    its members agree on it, where several would order themselves differently for each."""
    kept: list[int] = []
    for i in range(len(units)):
        if not kept or (units[kept] @ units[i]).max() < most:
            kept.append(i)
    return units[kept]


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        packed = [_apart(_units(pd.Series(list(vs))), MAX_PIVOT_COSINE).tobytes() for vs in frame["vs"]]
        yield frame[list(CELL)].assign(pivots=packed)


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors of a label form one class and are compared once; n_links counts the other vectors linked
    directly, copies included. Vectors that cannot link (see clean_vectors) and those of other lengths stand alone.
    Rows that repeat an id are vectors of their own. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "pivots")
    named = scratch.save(
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label")).withColumn("row", F.monotonically_increasing_id()), "vectors"
    )
    members = clean_vectors(named.withColumnRenamed("id", "vec_id"), "row", "embedding", "label", "vec_id").withColumn("dim", F.size("v"))
    kind = "float" if dict(members.dtypes)["v"] == "array<float>" else "double"
    # -0.0 and 0.0 are one value: adding 0.0 makes them equal bit by bit. Equal vectors are known by two hashes, 128 bits
    # together, so that vectors are shuffled once and their rows find them without.
    members = members.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind))).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(7), "v")})
    same = ["label", "dim", "h", "g"]
    classes = scratch.save(members.groupBy(*same).agg(F.min("id").alias("class"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "classes")
    owner = members.select("id", *same).join(classes.select(*same, "class"), same).select("id", "class")
    links = vector_links(classes.select("class", "label", "dim", "v", "copies"), scratch, min_cosine)
    degree = links.groupBy("class").agg(F.sum("linked").alias("linked"))
    reached = connected_components(links.select(F.col("class").alias("a"), F.col("root").alias("b")), scratch).select(F.col("node").alias("class"), "component")
    table = classes.select("class", "low", "copies").join(degree, "class", "left").join(reached, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = table.groupBy("component").agg(F.min("low").alias("component_id"))
    table = scratch.save(table.join(lowest, "component").select("class", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "table")
    rows = named.select(F.col("row").alias("id"), F.col("id").alias("vec_id")).join(owner.join(table, "class"), "id", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
