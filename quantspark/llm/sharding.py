"""Sharding by balanced label propagation.

Documents start in shards by hash. Each round joins linked documents with how many of their group every shard holds
and moves them towards the shard that holds most, as far as the quotas of the shards let them. Documents without
links, and the few that overrun a quota, then fill the shards, so that row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import Scratch

SHARDS = 16
#: Rows that one task numbers.
NUMBERED = 50_000
#: Share of a shard's quota below which it counts as full, and by which a block may not be larger.
ROOM, BLOCK = 0.02, 0.125


def numbered(rows: DataFrame, scratch: Scratch, total: int, by: str | None = None, name: str = "number") -> DataFrame:
    """rows(row, ...) with a gapless number from 0, of all rows or within each value of by.

    Rows are numbered within hash buckets of bounded size; a running sum of the bucket counts gives each bucket's
    first number. Only those counts meet in one task.
    """
    buckets = max(1, -(-total // NUMBERED))
    keys = ["bucket"] if by is None else [by, "bucket"]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("row"), F.lit(7)), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = (Window.orderBy("bucket") if by is None else Window.partitionBy(by).orderBy("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    first = scratch.save(counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), name)
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("row")) - 1
    return rows.join(first, keys).withColumn("number", F.col("first") + inside).drop("first", "bucket")


def _chosen(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index.cast("int") + 1)


def _accepted(asked: list[list[int]], free: list[int]) -> list[float]:
    """The share of requests into each shard that keeps every shard within its quota, room left by those who move out
    included. asked[s][t]: rows of s that want to be in t."""
    shards = range(len(free))
    share = [1.0] * len(free)
    for _ in range(4 * len(free)):
        gone = [sum(asked[s][t] * share[t] for t in shards) for s in shards]
        for t in shards:
            come, room = sum(asked[s][t] for s in shards), max(0.0, free[t] + gone[t])
            if come > room:
                share[t] = min(share[t], 0.97 * room / come)
    return share


def propagate(linked: DataFrame, quotas: list[int], scratch: Scratch, max_rounds: int | None = None) -> DataFrame:
    """(row, group, shard) after moves from rows (row, group). Only loads and requests by pairs of shards reach the
    driver.

    A group asks for the shard that holds most of it, one with room before a full one. A group that is large beside
    a quota fills one shard after another: what a full shard holds of it stays, the rest asks for the next.
    """
    shards = len(quotas)
    state = scratch.save(linked.select("row", "group", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")), "labels-0")
    for step in range(1, (max_rounds or shards + 8) + 1):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        free = [q - load.get(s, 0) for s, q in enumerate(quotas)]
        has_room = [int(f > ROOM * q) for f, q in zip(free, quotas, strict=True)]
        held = state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
        order = F.struct(_chosen(has_room, F.col("shard")), F.col("n"), F.xxhash64("group", "shard"))
        goal = held.groupBy("group").agg(F.max_by("shard", order).alias("goal"), F.sum("n").alias("total"))
        block = lambda shard: F.lit(BLOCK) * _chosen(quotas, F.col(shard))
        small = F.col("total") <= block("goal")
        filling = (_chosen(has_room, F.col("goal")) == 1) & ((_chosen(has_room, F.col("shard")) == 1) | (F.col("n") <= block("shard")))
        wish = scratch.save(held.join(goal.hint("merge"), "group").where((F.col("shard") != F.col("goal")) & (small | filling)), f"wish-{step}")
        asked = [[0] * shards for _ in quotas]
        for r in wish.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect():
            asked[r["shard"]][r["goal"]] = r["n"]
        share = _accepted(asked, free)
        if sum(share[t] * row[t] for row in asked for t in range(shards)) < 1:
            break
        # Small blocks move whole; of a block that is large beside a quota, parts move.
        parts = F.ceil(F.col("n") / F.greatest(F.lit(1.0), block("goal")))
        moves = state.join(wish.select("group", "shard", "goal", parts.alias("parts")).hint("merge"), ["group", "shard"], "left")
        part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row", F.lit(step)), F.col("parts") * 64)).otherwise(F.lit(0))
        draw = F.pmod(F.xxhash64("group", "shard", part, F.lit(step)), F.lit(1 << 20)) / float(1 << 20)
        limit = F.element_at(F.array(*[F.lit(float(x)) for x in share]), F.col("goal") + 1)
        after = moves.select("row", "group", F.when(F.col("goal").isNotNull() & (draw < limit), F.col("goal")).otherwise(F.col("shard")).alias("shard"))
        state = scratch.save(after, f"labels-{step}")
        scratch.drop(f"labels-{step - 1}")
    return state


def shard_rows(rows: DataFrame, scratch: Scratch, shards: int = SHARDS) -> DataFrame:
    """(row, shard, slot) from rows (row, group): group null links with nothing. Counts differ by one at most."""
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    # Groups grow with the corpus, so joins with them are shuffled at every size rather than broadcast while they are few.
    # Written first: the join then stands by itself, and adaptive execution may split the rows of a frequent group.
    sizes = rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    sizes = scratch.save(sizes, "sizes")
    linked = rows.join(sizes.hint("merge"), "group", "left_semi")
    placed = propagate(linked.select("row", "group"), quotas, scratch)
    ranked = numbered(placed.select("row", "shard"), scratch, total, "shard", "rank")
    kept = scratch.save(ranked.where(F.col("number") < _chosen(quotas, F.col("shard"))).select("row", "shard"), "kept")
    load = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    pool = numbered(rows.select("row").join(kept.select("row").hint("merge"), "row", "left_anti"), scratch, total, None, "pool")
    shard, upto = F.lit(shards - 1), sum(quotas) - sum(load.values())
    for s in range(shards - 1, -1, -1):
        shard = F.when(F.col("number") < upto, F.lit(s)).otherwise(shard)
        upto -= quotas[s] - load.get(s, 0)
    filled = scratch.save(kept.unionByName(pool.select("row", shard.cast("int").alias("shard"))), "filled")
    return numbered(filled, scratch, total, "shard", "slots").select("row", "shard", F.col("number").cast("long").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts are linked; null texts have size 1 and link with nothing; repeated rows are rows of their own; an
    empty table gives an empty result. The texts are read once.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.col(text_col)
    slim = scratch.save(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("group"),
        ),
        "slim",
    )
    placed = shard_rows(slim.select("row", "group"), scratch, shards)
    return slim.join(placed.hint("merge"), "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
