from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import decision_list, queries, rule_ensemble

from .helpers import documents

GOOD = "The quick brown fox jumps over a lazy dog near the river bank while seven old men watch it go by in number {}. "


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def value(name, counts):
    top, bottom = decision_list.FEATURES[name]
    at = dict(zip(decision_list.COUNTS, counts, strict=True))
    return at[top] / max(at[bottom], 1.0)


def brute(ensemble, text):
    """The score by walking over the rules."""
    counts = decision_list.text_stats(text)
    total = ensemble.bias
    for rule in ensemble.rules:
        if all((value(c.feature, counts) >= c.threshold) == c.above for c in rule.conditions):
            total += rule.weight
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    texts, quality = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = "".join(GOOD.format(rng.integers(1e6)) for _ in range(rng.integers(1, 5)))
        if bad:
            text = text.upper() + "!! " if i % 8 else " $$$ ".join(text.split())
        texts.append(text)
        quality.append(0 if bad else 1)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)], "doc_id long, quality int, toxic int")
    return documents(spark, texts), labels, texts, quality


def test_held_out_rows_are_told_apart_and_scores_are_those_of_the_rules(spark, corpus):
    docs, labels, texts, quality = corpus
    rows, ensemble = rule_ensemble.score_quality(docs, labels)
    got = {r.id: r for r in rows.collect()}
    assert ensemble.rules and len(ensemble.rules) < 60
    assert all(got[i].held_out == held(i) for i in range(600))
    assert all(abs(got[i].score - brute(ensemble, texts[i])) < 1e-12 for i in range(600))
    out = [i for i in range(600) if held(i)]
    assert sum((got[i].score >= rule_ensemble.THRESHOLD) == quality[i] for i in out) >= 0.97 * len(out)
    assert all("quality" not in str(r) and "doc_id" not in str(r) for r in ensemble.rules)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, corpus):
    docs, labels, *_ = corpus
    flipped = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.col("doc_id").cast("string")).withColumn("stats", F.lit(1)).withColumn("score", F.lit(2.0))
    one = {r.doc_id: r.score for r in rule_ensemble.classifier_digest(docs, labels).collect()}
    two = {r.doc_id: r.score for r in rule_ensemble.classifier_digest(other, flipped).collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)


def test_tree_paths_cover_what_the_tree_covers(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a > 0.3 and b < 0.6), float(a), float(b)) for a, b in rng.random((400, 2))]
    train = spark.createDataFrame(rows, "label double, a double, b double")
    ensemble = rule_ensemble.learn_ensemble(train, ["a", "b"], trees=6, depth=2, penalty=0.001)
    assert any({c.feature for c in r.conditions} == {"a", "b"} for r in ensemble.rules)
    for r in ensemble.rules:
        for one in r.conditions:
            assert sum((c.feature, c.above) == (one.feature, one.above) for c in r.conditions) == 1
    total = F.lit(ensemble.bias)
    for r in ensemble.rules:
        total = total + F.lit(r.weight) * rule_ensemble._hit(r.conditions)
    wrong = train.where((F.lit(1.0) / (1 + F.exp(-total)) >= 0.5) != (F.col("label") == 1)).count()
    assert wrong <= 12


def test_a_stronger_penalty_keeps_fewer_rules(spark):
    rng = np.random.default_rng(6)
    rows = [(float(rng.random() < 0.2 + 0.6 * (a > 0.5)), float(a), float(b)) for a, b in rng.random((500, 2))]
    train = spark.createDataFrame(rows, "label double, a double, b double")
    many, few, none = (len(rule_ensemble.learn_ensemble(train, ["a", "b"], penalty=p).rules) for p in (1e-4, 0.03, 10.0))
    assert many > few > none == 0


def test_without_use_for_rules_the_score_is_the_smoothed_share(spark):
    docs = documents(spark, ["a b c", None, "", "x " * 50_000])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    learned = [i for i in range(4) if not held(i)]
    scores = lambda ls: {round(r.score, 12) for r in rule_ensemble.classifier_digest(docs, ls).collect()}
    assert scores(labels([])) == {0.5}
    assert scores(labels([(None, 1, 0), (1, None, 0), (2, 7, 0)])) == {0.5}
    assert scores(labels([(i, 1, 0) for i in learned])) == {round((len(learned) + 1) / (len(learned) + 2), 12)}
    assert rule_ensemble.classifier_digest(docs.limit(0), labels([(1, 1, 0)])).count() == 0
    same = documents(spark, ["a b c"] * 30)
    mixed = labels([(i, i % 2, 0) for i in range(30)])
    assert len({r.score for r in rule_ensemble.classifier_digest(same, mixed).collect()}) == 1


def test_learning_takes_about_as_many_rows_as_its_bound(spark, corpus):
    docs, labels, *_ = corpus
    stats = decision_list.with_stats(docs.select(F.col("doc_id").alias("id"), "text")).select("id", F.col("__stats").alias("stats"))
    assert 60 < rule_ensemble.labelled_rows(stats, labels, max_rows=100).count() < 140
    assert rule_ensemble.labelled_rows(stats, labels).count() == sum(not held(i) for i in range(600))


def test_query_over_the_given_tables(spark):
    path = "/root/testdata/sf0.01"
    rows = queries.op12_rule_ensemble(spark, path).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in out) >= 0.95 * len(out)
