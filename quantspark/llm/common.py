"""Scratch tables in the shared folder, connected components and text helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, as in tests, a temporary one on a
    local master; on a cluster executors would not see each other's files, so that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quantspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage. They live in the shared folder, so a lost executor costs no recomputation
    of what is already written; the folder goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str, codec: str = "zstd", by: tuple[str, ...] = ()) -> DataFrame:
        """Writes the table, in folders by the columns of by, and returns it as read back."""
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).partitionBy(*by).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table, or a folder of one, that no later step reads."""
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that links reach.

    Alternates two star contractions: each node hands its larger neighbours, then its smaller ones, to the
    smallest node it sees. The edge count never grows, paths shorten geometrically, and the loop stops when
    a round changes nothing. Only counts and checksums reach the driver.
    """
    state = scratch.save(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0"
    )
    mark = _mark(state)
    for step in range(1, max_rounds + 1):
        if mark[0] == 0:
            break
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        moved = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        kept = low.select("a", F.col("low").alias("b"))
        after = scratch.save(moved.unionByName(kept).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        state, before = after, mark
        mark = _mark(state)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
