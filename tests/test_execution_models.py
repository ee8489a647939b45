from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series
from quantspark.operators import execution as ex
from quantspark.operators import market as mk
from quantspark.operators import models, statistics, text
from quantspark.operators.graph import co_thread_edges, pagerank


def test_costs_with_unknown_volatility(spark):
    rows = spark.createDataFrame([(100.0, 10_000.0, 4.0, 0.02), (-100.0, 10_000.0, 4.0, None), (100.0, 0.0, 4.0, 0.02)], "order_size double, avg_daily_volume double, spread_bps double, volatility double")
    out = ex.transaction_costs(rows).collect()
    assert out[0].total_bps == pytest.approx(1 + 2 + 1e4 * 0.1 * 0.02 * math.sqrt(0.01))
    assert out[1].total_bps == pytest.approx(3) and out[1].cost == pytest.approx(0.03)
    assert out[2].participation == 0
    assert ex.transaction_costs(rows.limit(0)).columns == ex.transaction_costs(rows).columns


def test_schedule_adds_up(spark):
    rows = spark.createDataFrame([(1, 1000.0)], "id int, size double")
    parts = ex.execution_schedule(rows, "id", "size", 5, 0.7).collect()
    assert sum(r.slice_size for r in parts) == pytest.approx(1000) and parts[0].slice_size > parts[4].slice_size


def test_turnover_counts_keys_that_come_and_go(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5), (2, "c", 0.5)], "at int, k string, weight double")
    assert [(r.at, r.turnover) for r in ex.turnover(rows, "at", "k").collect()] == [(2, 0.5)]


def test_kelly_is_never_negative(spark):
    rows = spark.createDataFrame([(0.6, 2.0), (0.2, 1.0)], "w double, p double")
    got = [r[0] for r in rows.select(ex.kelly_fraction(F.col("w"), F.col("p"))).collect()]
    assert got == [pytest.approx(0.5 * (0.6 - 0.4 / 2)), 0.0]


def test_cooldown_and_confirmation(spark):
    rows = spark.createDataFrame([("a", i, 0, s) for i, s in enumerate([1, 1, 0, -1, -1, -1])], "asset string, ts int, tie int, signal int")
    assert [r.cooled for r in ex.cooldown(rows, TICKS, "signal", 2).orderBy("ts").collect()] == [1, 0, 0, 0, 0, 0]
    assert [r.confirmed for r in ex.confirmed_signal(rows, TICKS, "signal", 2).orderBy("ts").collect()] == [0, 1, 0, 0, -1, -1]


def test_confusion_and_calibration(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (None, True)], "p boolean, a boolean")
    r = models.confusion(rows, "p", "a").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy, r.f1) == (1, 1, 1, 1, 0.5, 0.5)
    probs = spark.createDataFrame([(0.95, 1.0), (1.0, 1.0), (0.05, 0.0)], "prob_up double, label double")
    assert {r.bin: r.n for r in models.calibration(probs).collect()} == {9: 2, 0: 1}


def test_label_stays_within_the_series(spark):
    rows = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 2, 0, 2.0), ("b", 1, 0, 5.0), ("b", 2, 0, 4.0)], "asset string, ts int, tie int, price double")
    got = {(r.asset, r.ts): r.label for r in models.with_direction(rows, TICKS).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): None, ("b", 1): 0.0, ("b", 2): None}


def test_informative_feature_matters_most(spark):
    rows = spark.range(600).selectExpr("(id * 7919 % 600) / 600.0 AS x", "(id * 104729 % 600) / 600.0 AS noise").withColumn("label", (F.col("x") > 0.5).cast("double"))
    model = models.fit_direction(rows, ["x", "noise"])
    found = {r.feature: r.importance for r in models.permutation_importance(model, rows, ["x", "noise"]).collect()}
    assert found["x"] >= found["noise"]


def test_search_finds_the_better_parameters(spark):
    rows = spark.createDataFrame([("a", i, 0, 100 + 10 * math.sin(i / 6)) for i in range(120)], "asset string, ts int, tie int, price double")
    scores = models.parameter_search(rows, TICKS, {"fast": (2, 15), "slow": (5, 30)})
    best = models.best_parameters(scores, [], ["fast", "slow"]).first()
    assert (best.fast, best.slow) == (2, 5) and scores.count() == 4


def test_normal_cdf_and_put_call_parity(spark):
    xs = [-4.0, -1.0, 0.0, 0.5, 3.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", statistics.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-7 for r in rows)
    one = spark.range(1).select(*[v.alias(k) for k, v in statistics.black_scholes(F.lit(100.0), F.lit(95.0), F.lit(0.5), 0.03, 0.2).items()]).first()
    assert one.call - one.put == pytest.approx(100 - 95 * math.exp(-0.015), abs=1e-4)


def test_near_copies_first_wins(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(1, base), (2, base.replace("w150", "other")), (3, "quite another text here"), (4, base), (5, None), (6, None)], "id long, text string")
    got = {r.id: r.first_id for r in text.near_copies(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}


def test_near_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(text, "NEAR_BLOCK", 16, raising=False)
    rng = np.random.default_rng(5)
    made = []
    for k in range(60):
        own = {int(i): f"v{k}_{i}" for i in rng.choice(300, 15, replace=False)}
        made.append([own.get(i, f"w{i}") for i in range(300)])
    for k in range(20):
        at = int(rng.integers(300))
        made.append([f"u{k}" if abs(i - at) < k % 5 else w for i, w in enumerate(made[-1 - k])])
    for k in range(200):
        words = [f"p{k}_{i}" for i in range(100)]
        made += [words, words[:91] + [f"q{k}_{i}" for i in range(9)]]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)] + [(1000, " ".join(made[30]))], "id long, text string")
    signed = {r.id: np.array(r.signature) for r in text.minhash_signatures(rows).collect()}
    want = {i: min(j for j in signed if j == i or j < i and (signed[i] == signed[j]).mean() >= 0.8) for i in signed}
    assert len([i for i in want if want[i] != i]) >= 10
    assert {r.id: r.first_id for r in text.near_copies(rows).collect()} == want


def test_pagerank_of_a_star(spark):
    posts = spark.createDataFrame([("t1", "hub"), ("t1", "a"), ("t2", "hub"), ("t2", "b"), ("t3", "hub"), ("t3", "c")], "thread string, author string")
    ranks = {r.node: r.rank for r in pagerank(co_thread_edges(posts, "author", ["thread"]), rounds=20).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["hub"] > 0.4 and ranks["a"] == pytest.approx(ranks["b"])


def test_last_rows_and_strength(spark):
    rows = spark.createDataFrame([("a", i, 0, float(i)) for i in range(5)], "asset string, ts int, tie int, price double")
    assert sorted(r.ts for r in mk.last_rows(rows, Series(), 2).collect()) == [3, 4]
    flat = spark.createDataFrame([("a", 1, 0.1, 0.0), ("b", 1, 0.1, 0.0)], "asset string, ts int, m double, s double")
    assert {r.strength for r in mk.relative_strength(flat, "ts", "m", "s").collect()} == {0.0}


def test_crossovers_are_scored_without_python(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, 0, p) for k, n in (("a", 60), ("b", 20), ("c", 9)) for i, p in enumerate(np.round(100 + rng.normal(size=n).cumsum(), 2).tolist())]
    rows[7], rows[12], rows[30] = ("a", 7, 0, None), ("a", 12, 0, float("nan")), ("a", 30, 0, 0.0)
    df = spark.createDataFrame(rows, "asset string, ts long, tie long, price double")
    grid = {"slow": (5, 8), "fast": (2, 3)}
    found = models.parameter_search(df, TICKS, grid)
    assert "Pandas" not in found._jdf.queryExecution().toString()
    plain = models.parameter_search(df, TICKS, grid, score=lambda prices, fast, slow: models.crossover_score(prices, fast, slow))
    assert found.columns == plain.columns and found.dtypes == plain.dtypes
    got, want = ({tuple(r)[:3]: r.score for r in d.collect()} for d in (found, plain))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_signatures_are_least_hashes_of_words(spark):
    text_ = "B a c a\tb d " + " ".join(f"w{i}" for i in range(5000))
    got = text.minhash_signatures(spark.createDataFrame([(1, text_)], "id long, text string"), size=8).first()["signature"]
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 61, 8, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 61, 8, dtype=np.uint64)
    hashed = pd.util.hash_array(np.array(sorted(set(text_.lower().split())), dtype=object)).astype(np.uint64)
    assert got == ((hashed[:, None] * a + b) >> np.uint64(2)).min(axis=0).astype(np.int64).tolist()
