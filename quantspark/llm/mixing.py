"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a hash in [0, 2^48) of its id and text. A source's share is the documents whose hash lies below the
source's threshold, so choosing them needs no sort and a rerun chooses the same ones. The threshold comes from
histograms: tokens are summed by source and hash bucket, the bucket in which the running sum passes the budget is found,
and only that bucket is split into finer buckets, level by level.

Rows that repeat an id with its text share a hash. Where several lie at a threshold, the same search runs once more among
them, by a hash of each row's place in a written table, so that as many are taken as the budget wants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import WORD, Scratch, free_name

HASH_BITS = 48
#: Bits that each histogram level resolves; together HASH_BITS. The last level holds single hash values.
LEVELS = (12, 12, 12, 12)


def word_count(text: Column) -> Column:
    """Words of a text as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(*keys: Column) -> Column:
    """A hash of the keys with HASH_BITS bits. A null key leaves it to the others."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - HASH_BITS)


def row_hash() -> Column:
    """A hash of the place of a row in the Parquet files that it is read from, which outlasts a lost task."""
    return document_hash(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Weights repeat over the sources by code point, null last. Each source is due share x all sizes by weight, at
    most max_repeat x its own size; what is above is shared again by weight among the rest. That fixed point is
    found in one pass over the sources ordered by limit over weight: the first ones are filled, the rest share
    what is left. Only one row for each source reaches the single-task window.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = F.lit(float(max_repeat)) * F.col("source_size")
    fill = Window.orderBy(F.col("level"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("limit", limit)
        .withColumn("level", F.col("limit") / F.col("weight"))
        .withColumn("due", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("filled", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("rate", (F.col("due") - F.col("filled")) / F.col("rest"))
        .withColumn("open", F.col("rate") < F.col("level"))
    )
    # The rate is largest at the first source that stays open: every further one counts as filled beyond its share.
    rate = F.max(F.when(F.col("open"), F.col("rate"))).over(Window.partitionBy())
    return levels.withColumn("final", rate).select(
        "source",
        "source_size",
        F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * F.col("final"))).alias("target"),
    )


def boundaries(hashed: DataFrame, goal: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(source, at, left, size, n): the hash at which the running size of a source passes its budget, what is left of the
    budget there, and size and number of the rows with a size there; at is 2^HASH_BITS if the budget is never passed.

    hashed: (source, size, hash), goal: (source, left).
    """
    goal = goal.select("source", "left", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("n"))
    used = 0
    for level, bits in enumerate(LEVELS):
        used += bits
        width = 1 << (HASH_BITS - used)
        span = width << bits
        inside = hashed.alias("d").join(goal.select("source", "low").alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        inside = inside.where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(span)) & (F.col("size") > 0))
        counts = inside.groupBy(F.col("d.source").alias("source"), F.floor(F.col("hash") / F.lit(width)).cast("long").alias("bucket")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("upto", F.sum("size").over(running))
        cut = (
            counts.alias("c")
            .join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
            .where(F.col("upto") > F.col("left"))
            .groupBy(F.col("g.source").alias("source"))
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("c.size")).alias("below"), F.col("c.size").alias("size"), F.col("c.n").alias("n"))).alias("cut"))
        )
        joined = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
        goal = scratch.save(
            joined.select(
                F.col("g.source").alias("source"),
                (F.col("left") - F.coalesce(F.col("cut.below"), F.lit(0))).alias("left"),
                F.coalesce(F.col("cut.bucket") * F.lit(width), F.col("low") + F.lit(span)).cast("long").alias("low"),
                F.coalesce(F.col("cut.size"), F.lit(0)).cast("long").alias("size"),
                F.coalesce(F.col("cut.n"), F.lit(0)).cast("long").alias("n"),
            ),
            f"{name}-{level}",
        )
    return goal.withColumnRenamed("low", "at")


def nearer() -> Column:
    """The threshold on that side of the hash `at` which lies nearer to the budget."""
    return F.col("at") + F.when(F.col("left") > F.col("size") / 2, F.lit(1)).otherwise(F.lit(0))


def hash_thresholds(hashed: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, copies, threshold, tie, due) from rows (source, size, hash) and the targets.

    copies whole copies of a source are taken, and once more each document with hash < threshold. Of the two cuts beside
    the budget, the nearer one is taken. Where several rows share the hash at the cut, tie is this hash and due what is
    left of the budget for them; else both are null.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets.withColumn("copies", whole).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    cuts = boundaries(hashed, goal, scratch, "cut")
    cuts = cuts.withColumn("several", F.col("n") > 1).select(
        F.col("source").alias("s"),
        F.when(F.col("several"), F.col("at")).otherwise(nearer()).alias("threshold"),
        F.when(F.col("several"), F.col("at")).alias("tie"),
        F.when(F.col("several"), F.col("left")).alias("due"),
    )
    return scratch.save(goal.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "copies", "threshold", "tie", "due"), "thresholds")


def tie_thresholds(rows: DataFrame, cuts: DataFrame, scratch: Scratch) -> DataFrame:
    """cuts with tie_threshold, below which a row's place must hash if its own hash is the tie. rows: (source, size, hash, place).

    Only rows at a tie are searched; without any, no job runs on the rows.
    """
    ties = cuts.where("tie IS NOT NULL").select(F.col("source").alias("s"), "tie", "due")
    if ties.isEmpty():
        return cuts.withColumn("tie_threshold", F.lit(None).cast("long"))
    tied = rows.join(ties, F.col("source").eqNullSafe(F.col("s"))).where("hash = tie").select("source", "size", F.col("place").alias("hash"))
    found = boundaries(tied, ties.select(F.col("s").alias("source"), F.col("due").alias("left")), scratch, "tie")
    found = found.select(F.col("source").alias("s"), nearer().alias("tie_threshold"))
    return scratch.save(cuts.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "ties")


def mix_plan(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeat: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized rows (id, source, size, hash), thresholds by source).

    The texts are read once: what remains is a slim table in the shared folder. Null texts have size 0, null sources form
    one source, rows of null or equal ids are told apart by their texts, an empty table gives empty results.
    """
    slim = scratch.save(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            document_hash(F.col(id_col), F.col(text_col)).alias("hash"),
        ),
        "sized",
    )
    targets = scratch.save(source_targets(slim, weights, share, max_repeat), "targets")
    return slim, hash_thresholds(slim, targets, scratch)


def taken_copies(copies: Column, threshold: Column, hashed: Column) -> Column:
    """How often a document is taken: the whole copies, and one more below the threshold."""
    return (F.coalesce(copies, F.lit(0)) + F.when(hashed < threshold, F.lit(1)).otherwise(F.lit(0))).cast("int")


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Of rows that repeat an id with its text as many are taken as the target wants; which of them is of no account.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    slim, cuts = mix_plan(docs, scratch, **options)
    placed = slim.select("*", row_hash().alias("place"))
    cuts = tie_thresholds(placed, cuts, scratch)
    rows = placed.alias("d").join(cuts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    copies = F.when(F.col("hash") == F.col("tie"), taken_copies(F.col("copies"), F.col("tie_threshold"), F.col("place"))).otherwise(taken_copies(F.col("copies"), F.col("threshold"), F.col("hash")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus with the columns of docs: rows not taken go, rows taken twice come twice.

    Rows at a tie, if there are any, are written apart and read again, so that each has a place.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    _, cuts = mix_plan(docs, scratch, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    source, copies, threshold, tie, take, hashed, place, size = (free_name(docs, f"__{n}") for n in ("source", "copies", "threshold", "tie", "take", "hash", "place", "size"))
    by_source = lambda c, *more: c.select(F.col("source").alias(source), F.col("copies").alias(copies), *more)
    rows = docs.withColumn(hashed, document_hash(docs[id_col], docs[text_col]))
    at_tie = by_source(cuts, F.col("threshold").alias(threshold), F.col("tie").alias(tie))
    rows = rows.join(at_tie, rows[source_col].cast("string").eqNullSafe(F.col(source)), "left")
    taken = lambda df, below, key: df.withColumn(take, taken_copies(F.col(copies), F.col(below), F.col(key))).where(F.col(take) > 0).select(*docs.columns, take)
    tied = F.coalesce(F.col(hashed) == F.col(tie), F.lit(False))
    out = taken(rows.where(~tied), threshold, hashed)
    if not cuts.where("tie IS NOT NULL").isEmpty():
        alike = scratch.save(rows.where(tied).select(*docs.columns, hashed), "tied")
        alike = alike.select("*", row_hash().alias(place), word_count(F.col(text_col)).alias(size))
        plain = alike.select(F.col(source_col).cast("string").alias("source"), F.col(size).alias("size"), F.col(hashed).alias("hash"), F.col(place).alias("place"))
        among = by_source(tie_thresholds(plain, cuts, scratch), F.col("tie_threshold").alias(threshold))
        out = out.unionByName(taken(alike.join(among, alike[source_col].cast("string").eqNullSafe(F.col(source)), "left"), threshold, place))
    return out.withColumn(take, F.explode(F.sequence(F.lit(1), F.col(take)))).select(*docs.columns)
