"""SimHash near-duplicates found by multi-index hashing.

Two fingerprints of 64 bits within two bits of each other, cut into two halves, differ by at most one bit in the
upper half or agree in the lower one. So each half has a table; the upper half is looked up with its Hamming ball
of radius 1, the lower half as it is, and every match is verified on all 64 bits. Exact copies share a fingerprint
and are looked up once.

A half that very many fingerprints share would give all pairs among them. Fingerprints that look up such a crowded
entry are linked through the ball of radius 1 around the whole value instead: two values lie within two bits
exactly if these balls meet, so linking each value to the smallest one around every ball point loses no link and
needs 65 rows a value, however crowded the entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import Scratch, connected_components, free_name

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints under one table entry up to which its pairs are listed.
CROWDED = 32


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes.

    Null, empty and blank texts have fingerprint 0; texts of fewer words than a shingle are one shingle.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return int(np.uint64(hashed(b" ".join(words), SEED)).astype(np.int64))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    counts, total = np.zeros(64, np.int64), len(begins)
    for at in range(0, total, 1 << 16):
        block = [hashed(joined[a:b], SEED) for a, b in zip(begins[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)]
        bits = np.unpackbits(np.array(block, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * counts > total).astype(np.uint8), bitorder="little").view("<u8")
    return int(packed.astype(np.int64)[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(x) for x in batch], dtype="int64")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    return docs.withColumn(out_col, F.pandas_udf(_fingerprints, "long")(F.col(text_col)))


def _upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _ball(value: Column, bits: int) -> Column:
    """The value and every value that differs from it in one of its low bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(bits)])
    return F.transform(flips, lambda f: value.bitwiseXOR(f))


def near_fingerprints(distinct: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between the fingerprints of distinct(fp), each once: every pair within max_bits (1 or 2) bits is
    joined by a link or a path of links, and no link is longer."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    upper, lower = _upper(F.col("fp")), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = F.array(F.struct(F.lit(0).alias("half"), upper.alias("key")), F.struct(F.lit(1).alias("half"), lower.alias("key")))
    entries = scratch.save(distinct.select("fp", F.explode(halves).alias("e")).select("fp", "e.half", "e.key"), "entries")
    # A pair that differs in one upper bit meets once: only the value with the 0 looks up the one with the 1.
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])
    raised = F.transform(F.filter(masks, lambda m: upper.bitwiseAND(m) == 0), lambda m: upper.bitwiseOR(m))
    probes = distinct.select("fp", F.lit(0).alias("half"), F.explode(raised).alias("key")).unionByName(entries)
    hot = scratch.save(entries.groupBy("half", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("half", "key"), "hot")

    listed = entries.join(hot, ["half", "key"], "left_anti").withColumnRenamed("fp", "other")
    once = ((F.col("half") == 0) & (_upper(F.col("fp")) != _upper(F.col("other")))) | (F.col("fp") < F.col("other"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    pairs = probes.join(listed, ["half", "key"]).where(once & near).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))

    touching = scratch.save(probes.join(hot, ["half", "key"], "left_semi").select("fp").distinct(), "touching")
    around = touching.select("fp", F.explode(_ball(F.col("fp"), 64)).alias("point"))
    if max_bits == 1:
        centre = touching.select(F.col("fp").alias("point"))
        stars = around.where("fp <> point").join(centre, "point", "left_semi").select(F.least("fp", "point").alias("a"), F.greatest("fp", "point").alias("b"))
    else:
        least = around.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("point", "low")
        stars = around.join(least, "point").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def _classes(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, low, class) of the distinct fingerprints of prints(id, fp): their smallest id, and a number of their component."""
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    links = scratch.save(near_fingerprints(distinct.select("fp"), scratch), "links")
    reached = connected_components(links, scratch)
    return distinct.join(reached, distinct["fp"] == reached["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("class"))


def simhash_components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for every row: component is the smallest id that links of fingerprints reach.

    Repeated rows and repeated ids are kept; a null id is left out of the minimum. The texts are read once.
    """
    prints = scratch.save(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "fp"), "prints")
    classes = _classes(prints, scratch)
    lowest = classes.groupBy("class").agg(F.min("low").alias("component"))
    named = scratch.save(classes.join(lowest, "class").select("fp", "component"), "named")
    return prints.join(named, "fp").select("id", "fp", "component")


def simhash_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the fingerprint as 16 hex digits, component_id.

    Null, empty and blank texts have fingerprint 0 and link like any other. Null ids and repeated rows keep a row each;
    a component of null ids alone has a null component_id. Texts of any length are read whole; an empty table gives an
    empty result.
    """
    rows = simhash_components(docs, Scratch(docs.sparkSession, "simhash"), id_col, text_col)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: the one of the smallest id (null ids last), then of the smallest
    fingerprint. Of rows that agree on both one stays. Other columns stay as they are; an empty table stays empty."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fp, key = free_name(docs, "__fp"), free_name(docs, "__id")
    rows = scratch.save(with_fingerprint(docs, text_col, fp), "rows")
    prints = rows.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    order = F.struct(F.col("low").isNull(), "low", "fp")
    chosen = _classes(prints, scratch).groupBy("class").agg(F.min_by(F.struct("low", "fp"), order).alias("first")).select(F.col("first.low").alias("low"), F.col("first.fp").alias("first"))
    same = lambda one, other: one["low"].eqNullSafe(other["id"]) & (one["first"] == other["fp"])
    # Ids grow with the corpus, so these joins are shuffled at every size rather than broadcast while they are few.
    counted = prints.groupBy("id", "fp").agg(F.count(F.lit(1)).alias("n"))
    firsts = scratch.save(counted.join(chosen.hint("merge"), same(chosen, counted), "left_semi").select(F.col("id").alias(key), F.col("fp").alias(f"{fp}_"), "n"), "firsts")

    def kept(part: DataFrame) -> DataFrame:
        part = part.drop("n").hint("merge")
        return rows.join(part, rows[id_col].eqNullSafe(part[key]) & (rows[fp] == part[f"{fp}_"]), "left_semi")

    repeated = firsts.where("n > 1")
    once = kept(firsts.where("n = 1"))
    return (once if repeated.isEmpty() else once.unionByName(kept(repeated).dropDuplicates([id_col, fp]))).select(*docs.columns)
