"""Centroid clustering with Elkan's bounds: exact integer k-means that skips most distance calculations.

Vectors become integers. Each row carries an upper bound of the distance to its own centroid and a lower bound for every
centroid, from round to round in a written table. A centroid is skipped if its lower bound, or half of its distance to
the row's centroid, is strictly above the upper bound: it can then neither win nor tie. Bounds are rounded outwards, so
that doubles never prune what integers would keep; distances that are calculated are exact integers, and so are the
sums. Only rows that change their cluster enter the sums of a round. The driver sees k centroids, never a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import Scratch

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
#: Integer components beyond this have squared distances that no long holds.
MAX_COMPONENT = 1 << 27
#: Relative room for the rounding of a root, a sum or a difference of doubles: some units of the last place.
ROOM = 2.0**-50
STATE = "vec_id long, x array<int>, cluster int, previous int, upper double, lower array<double>, calculated long, distance long"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("previous", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("calculated", pa.int64()), ("distance", pa.int64())])


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + ROOM)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - ROOM), 0.0)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from one centroid."""
    apart = x - centre
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class Centroids:
    """k integer centroids with their sums, and how far each moved in the last update (rounded up)."""

    at: np.ndarray
    sums: list[list[int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    moved: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        k, dims = self.at.shape
        self.sums = self.sums or [[0] * dims for _ in range(k)]
        self.counts = self.counts or [0] * k
        self.moved = self.moved if len(self.moved) else np.zeros(k)

    def halves(self) -> np.ndarray:
        """Half of the distances between centroids, rounded down."""
        return np.stack([_down(np.sqrt(squared(self.at, c).astype(float)) / 2) for c in self.at])

    def add(self, changes: list) -> None:
        """Takes rows (cluster, place, change of sum, change of count) into the sums."""
        for cluster, place, total, n in changes:
            self.sums[cluster][place] += int(total)
            if place == 0:
                self.counts[cluster] += int(n)

    def update(self) -> None:
        """Each centroid that has vectors moves to the floor of their mean."""
        new = np.array([[s // n for s in total] if n else list(old) for total, n, old in zip(self.sums, self.counts, self.at.tolist(), strict=True)], np.int64)
        self.moved = _up(np.sqrt(((new - self.at) ** 2).sum(axis=1).astype(float)))
        self.at = new


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, distance calculations) after one assignment; cluster is -1 in rows that have none yet.

    Equal distances go to the smaller number, as in a search of all centroids.
    """
    k, rows = len(centroids.at), len(x)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    calculated = np.zeros(rows, np.int64)
    own = np.zeros(rows, np.int64)
    known = np.zeros(rows, bool)
    halves = centroids.halves()

    def measure(where: np.ndarray, number: int) -> np.ndarray:
        found = squared(x[where], centroids.at[number])
        lower[where, number] = _down(np.sqrt(found.astype(float)))
        calculated[where] += 1
        return found

    fresh = np.flatnonzero(cluster < 0)
    if len(fresh):
        own[fresh] = measure(fresh, 0)
        cluster[fresh], known[fresh] = 0, True
        upper[fresh] = _up(np.sqrt(own[fresh].astype(float)))
    for j in range(k):
        open_ = lambda: (cluster != j) & (lower[:, j] <= upper) & (halves[cluster, j] <= upper)  # noqa: B023, E731
        loose = open_() & ~known
        if loose.any():
            for a in np.unique(cluster[loose]):
                where = np.flatnonzero(loose & (cluster == a))
                own[where] = measure(where, a)
            known |= loose
            upper[loose] = _up(np.sqrt(own[loose].astype(float)))
        where = np.flatnonzero(open_())
        if len(where):
            found = measure(where, j)
            wins = (found < own[where]) | ((found == own[where]) & (j < cluster[where]))
            won = where[wins]
            cluster[won], own[won] = j, found[wins]
            upper[won] = _up(np.sqrt(found[wins].astype(float)))
    return cluster, upper, lower, calculated


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def _round(centroids: Centroids, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.at.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("x")
            x = _matrix(raw, dims).astype(np.int64)
            before = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            upper = batch.column("upper").to_numpy(zero_copy_only=False)
            lower = _matrix(batch.column("lower"), k)
            seen = before >= 0
            upper = np.where(seen, _up(upper + centroids.moved[np.maximum(before, 0)]), upper)
            lower = _down(lower - centroids.moved)
            cluster, upper, lower, calculated = assign(x, before, upper, lower, centroids)
            distance = ((x - centroids.at[cluster]) ** 2).sum(axis=1) if last else np.zeros(len(x), np.int64)
            total = batch.column("calculated").to_numpy(zero_copy_only=False) + calculated
            columns = [batch.column("vec_id"), _lists(x.astype(np.int32), pa.int32()), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), _lists(lower, pa.float64()), pa.array(total), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    return run


def _changes(k: int, dims: int):
    """Sums of a batch: what its changed rows add to their cluster and take from the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims).astype(np.int64)
            sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
            for name, sign in (("cluster", 1), ("previous", -1)):
                number = batch.column(name).to_numpy(zero_copy_only=False)
                for j in np.unique(number[number >= 0]):
                    sums[j] += sign * x[number == j].sum(axis=0)
                    counts[j] += sign * int((number == j).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), _lists(sums, pa.int64()), pa.array(counts)], names=["cluster", "sums", "n"])

    return run


def integers(vector: Column, dims: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null unless the vector has dims components, all finite and of a size whose
    squared distances a long holds."""
    x = vector.cast("array<double>")
    fits = (F.size(vector) == dims) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) * scale < MAX_COMPONENT))
    return F.when(fits, F.transform(x, lambda v: F.floor(v * scale).cast("int")))


def elkan_clusters(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, Centroids]:
    """(vec_id, x, cluster, distance, calculated) for every vector that is kept, and the final centroids.

    calculated counts the distances that its row took over all assignments; a search of all centroids takes
    k * (rounds + 1). Centroids start as the k vectors whose `seed:id` has the smallest SHA-256; repeated ids are told
    apart by their vectors, null ids come last. With fewer than k vectors there are fewer centroids, and none, with no
    rows, for an empty table.
    """
    scratch = Scratch(vectors.sparkSession, "elkan")
    start = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), dims, scale).alias("x")).where("x IS NOT NULL")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = start.orderBy(first.asc_nulls_last(), "x").limit(k).collect()
    if not chosen:
        return start.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("calculated")), Centroids(np.zeros((0, dims), np.int64))
    centroids = Centroids(np.array([row.x for row in chosen], np.int64))
    k = len(chosen)
    blank = [F.lit(-1).alias("cluster"), F.lit(-1).alias("previous"), F.lit(0.0).alias("upper"), F.array_repeat(F.lit(0.0), k).alias("lower"), F.lit(0).cast("long").alias("calculated"), F.lit(0).cast("long").alias("distance")]
    state = start.select("vec_id", "x", *blank)
    for number in range(rounds + 1):
        state = scratch.save(state.mapInArrow(_round(centroids, number == rounds), STATE), f"round-{number}")
        if number:
            scratch.drop(f"round-{number - 1}")
        if number < rounds:
            changed = state.where("cluster <> previous").select("x", "cluster", "previous").mapInArrow(_changes(k, dims), "cluster int, sums array<long>, n long")
            places = changed.select("cluster", "n", F.posexplode("sums").alias("place", "value"))
            # At most k * dims rows, whatever the table's size.
            centroids.add(places.groupBy("cluster", "place").agg(F.sum("value"), F.sum("n")).collect())
            centroids.update()
    return state.select("vec_id", "x", "cluster", "distance", "calculated"), centroids


def centroid_digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and calculated.

    Vectors that are null or empty, have another number of components, hold null or non-finite ones, or one of 131,072 or
    more (no long holds its distances) are left out. Null ids and repeated rows keep a row each; equal vectors share
    their cluster. An inertia beyond a long is null. Other columns are not read. An empty table gives an empty result.
    """
    rows, centroids = elkan_clusters(vectors)
    spark = vectors.sparkSession
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    digests = spark.createDataFrame([(j, centroid_digest(c)) for j, c in enumerate(centroids.at)], "cluster int, centroid_sha256 string")
    total = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))
    # One row per centroid, k at most: a bounded table, safe to broadcast.
    told = sums.join(F.broadcast(digests), "cluster").select("cluster", F.col("cluster_inertia").try_cast("long").alias("cluster_inertia"), total.try_cast("long").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "calculated")

