from __future__ import annotations

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quantspark.llm import decision_list as dl

from .helpers import awkward, documents, words


def brute_stats(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = Counter(windows)
    marked = {k for i, x in enumerate(windows) if counts[x] > 1 for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(marked))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "a\n", "é", "#|", " x", "b \t"]), max_size=60))
def test_counts_match_brute_force(parts):
    text = " ".join(parts)
    assert dl.text_stats(text)[:5] == brute_stats(text)


def labelled(spark, n=240):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(400)]
    good = [" ".join(rng.choice(vocabulary, 80)) for _ in range(n // 2)]
    bad = [" ".join(w + "%%%" for w in rng.choice(vocabulary, 80)) for _ in range(n // 4)] + [" ".join(rng.choice(vocabulary, 80)).upper() + "!!!!" for _ in range(n // 4)]
    docs = documents(spark, [*good, *bad])
    labels = spark.createDataFrame([(i, int(i < n // 2), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_learned_list_separates_and_keeps_clean(spark):
    docs, labels = labelled(spark)
    rules = dl.fit(docs, labels)
    assert rules
    rows = dl.quality_digest(docs, labels).toPandas().set_index("doc_id")
    assert rows.kept[rows.index < 120].all()
    assert not rows.kept[rows.index >= 120].any()
    fresh = documents(spark, ["unseen clean text " + " ".join(f"new{i}" for i in range(3000))])
    assert dl.keep_good(fresh, labels.limit(0)).count() == 1


def test_list_holds_on_rows_it_was_not_fitted_on(spark):
    docs, labels = labelled(spark)
    rows = dl.quality_digest(docs, labels.where("doc_id % 2 = 0")).where("doc_id % 2 = 1").toPandas().set_index("doc_id")
    assert rows.kept[rows.index < 120].mean() > 0.95 and rows.kept[rows.index >= 120].mean() < 0.1


def test_training_bound_and_repeatability(spark):
    docs, labels = labelled(spark)
    assert len(dl.training_rows(docs, labels, max_rows=50)) == 50
    assert list(map(str, dl.fit(docs, labels))) == list(map(str, dl.fit(docs.repartition(7), labels.repartition(3))))


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 0, 0), (3, 1, None), (None, 0, 0), (4, None, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    docs = awkward(spark)
    rows = dl.quality_digest(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(tuple(r)[1:6] == brute_stats(t.text) for r, t in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.n_words)), sorted(docs.collect(), key=lambda r: (str(r.doc_id), len(words(r.text)))), strict=True))
    assert dl.keep_good(docs, labels).columns == docs.columns
    assert dl.quality_digest(docs.limit(0), labels.limit(0)).count() == 0


def test_rule_column_orders_rules(spark):
    rules = [dl.Rule((dl.Condition("symbols_per_word", True, 0.5),), 1.0, 1), dl.Rule((dl.Condition("upper_per_char", True, 0.5),), 1.0, 1)]
    docs = documents(spark, ["a# b#", "AB CD", "A# B#", "plain"])
    got = dl.with_stats(docs).select(dl.rejected_by(rules, dl.F.col("__stats")).alias("r")).collect()
    assert [x.r for x in got] == [1, 2, 1, None]
