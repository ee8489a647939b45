from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantspark.llm import mixing

from .helpers import awkward, documents, words


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Shares by weight; what is above twice a source's size is shared again among the rest."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), list(order)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in order)
        target = {s: min(target[s], cap * sizes[s]) for s in order}
        open_ = [s for s in order if target[s] < cap * sizes[s] - 1e-12]
    return target


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.dictionaries(st.sampled_from(["a", "B", "src10", "src2", "é", None, "z"]), st.integers(0, 500), min_size=1))
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows, (5, 2, 1), 1.5, 2.0).collect()}
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(got[s] - want[s]) < 1e-6 * max(1, want[s])


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    rng = random.Random(4)
    texts = ["w " * rng.randint(0, 60) for _ in range(3000)]
    docs = documents(spark, texts, [rng.choice(["src0", "src1", "src2", "src3", None]) for _ in texts])
    rows = mixing.mix_digest(docs).toPandas()
    again = mixing.mix_digest(docs.repartition(9)).toPandas()
    assert dict(zip(rows.doc_id, rows.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    assert (rows["size"] == [len(words(texts[i])) for i in rows.doc_id]).all()
    assert (rows.taken <= 2 * rows["size"]).all()
    for _, part in rows.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 60
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    counts = mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    copies = rows.set_index("doc_id").copies
    assert counts.reindex(copies.index).fillna(0).astype(int).equals(copies.astype(int))


def test_one_document_sources(spark):
    rows = mixing.mix_digest(documents(spark, ["a b c", "d"], ["x", "y"])).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert mixing.mix_digest(docs).count() == docs.count()
    assert mixing.mix_sources(docs).columns == docs.columns
    assert mixing.mix_sources(docs).count() >= 1
    assert mixing.mix_digest(docs.limit(0)).count() == 0


def near_targets(rows, longest):
    for _, part in rows.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= longest


def test_null_and_repeated_ids_come_near_targets(spark):
    """All ids null; one id with one text on a third of the rows, further columns unlike."""
    rng = random.Random(8)
    texts = [" ".join(str(rng.randint(0, 9)) for _ in range(rng.randint(1, 50))) for _ in range(2400)]
    sources = [rng.choice(["src0", "src1", "src2", None]) for _ in texts]
    docs = documents(spark, texts, sources)
    third = "doc_id % 3 = 0"
    repeats = docs.withColumn("text", F.expr(f"IF({third}, 'all these rows are alike', text)")).withColumn("doc_id", F.expr(f"IF({third}, 7, doc_id)"))
    for frame in (docs.withColumn("doc_id", F.lit(None).cast("long")), repeats):
        rows = mixing.mix_digest(frame).fillna(-1).toPandas()
        near_targets(rows, 50)
    again = mixing.mix_digest(repeats.repartition(5)).fillna(-1).toPandas()
    columns = ["doc_id", "size", "target", "taken"]
    assert rows[columns].value_counts().to_dict() == again[columns].value_counts().to_dict()
    mixed = mixing.mix_sources(repeats)
    assert mixed.columns == repeats.columns
    sized = mixed.select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").sum("n").collect()
    assert sum(r[1] for r in sized) == rows.taken.sum()
    goal = {r.source: r.target for r in mixing.source_targets(repeats.select("source", mixing.word_count(F.col("text")).alias("size")), (5, 2, 1), 1.5, 2.0).collect()}
    assert all(abs(r[1] - goal[r.source]) <= 50 for r in sized)


def test_one_text_only(spark):
    """A source of one text without ids is taken in part, not whole or not at all."""
    docs = documents(spark, ["a b c"] * 600 + ["d e f"] * 200, ["x"] * 600 + ["y"] * 200).withColumn("doc_id", F.lit(None).cast("long"))
    rows = mixing.mix_digest(docs).toPandas()
    near_targets(rows, 3)
    assert mixing.mix_sources(docs).count() == rows.copies.sum()
