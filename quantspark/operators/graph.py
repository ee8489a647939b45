"""Interaction edges and PageRank by iterative joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_thread_edges(posts: DataFrame, author: str, by: Sequence[str], min_interactions: int = 1) -> DataFrame:
    """(src, dst, weight): both directions for every two authors of a thread, weighted by shared threads. Authors of
    fewer than min_interactions posts are left out, before pairs are made.

    Authors count once a thread; the pairs of a thread are the result asked for.
    """
    rows = posts.select(*by, F.col(author).alias("a")).where(F.col("a").isNotNull())
    if min_interactions > 1:
        rows = rows.join(rows.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_interactions).select("a"), "a", "left_semi")
    members = rows.distinct()
    other = members.withColumnRenamed("a", "b")
    pairs = members.join(other, list(by)).where("a <> b")
    return pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(node, rank) after a fixed number of rounds; ranks sum to 1, the rank of nodes without edges out is shared by all.

    Lineage is cut by reliable checkpoints where a checkpoint folder is set.
    """
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")).persist()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(out.select(F.col("src").alias("node"), F.lit(True).alias("has_out")), "node", "left").persist()
    n = nodes.count()
    ranks = nodes.select("node", "has_out", F.lit(1.0 / max(n, 1)).alias("rank"))
    reliable = spark.sparkContext.getConf().get("spark.checkpoint.dir") is not None
    for step in range(rounds):
        dangling = ranks.where("has_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        step_ranks = nodes.join(got, nodes["node"] == got["dst"], "left").crossJoin(F.broadcast(dangling))  # one row
        ranks = step_ranks.select("node", "has_out", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / max(n, 1))).alias("rank"))
        if reliable and step % 4 == 3:
            ranks = ranks.checkpoint()
    return ranks.select("node", "rank")


def thread_pagerank(posts: DataFrame, author: str, by: Sequence[str], damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(node, rank) of the co-thread graph without its edges: pagerank(co_thread_edges(...)) from memberships alone.

    An author hands the same share to every other member of each thread, so a thread adds up what its members hand on
    and each gets the sum less its own. A round is two joins over memberships, linear however large a thread is.
    """
    members = posts.select(F.struct(*by).alias("thread"), F.col(author).alias("node")).where("node is not null").distinct()
    sizes = members.groupBy("thread").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = members.join(sizes, "thread").persist()
    ways = linked.groupBy("node").agg(F.sum(F.col("n") - 1).alias("ways")).persist()
    n = ways.count()
    ranks = ways.select("node", "ways", F.lit(1.0 / max(n, 1)).alias("rank"))
    reliable = posts.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") is not None
    for step in range(rounds):
        told = linked.select("thread", "node").join(ranks.select("node", (F.col("rank") / F.col("ways")).alias("x")), "node")
        sums = told.groupBy("thread").agg(F.sum("x").alias("all"))
        got = told.join(sums, "thread").groupBy("node").agg(F.sum(F.col("all") - F.col("x")).alias("in"))
        ranks = ways.join(got, "node").select("node", "ways", (F.lit((1 - damping) / max(n, 1)) + damping * F.col("in")).alias("rank"))
        if reliable and step % 4 == 3:
            ranks = ranks.checkpoint()
    return ranks.select("node", "rank")
