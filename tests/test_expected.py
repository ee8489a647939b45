"""Values that are known beforehand: by hand, from closed forms, or from numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series
from quantspark.functions import kernels
from quantspark.operators import execution, features, graph, market, reports, statistics, text, windows
from quantspark.sources import files, layers
from quantspark.streaming import windows as sw


def series(spark, values, name="price", key="a"):
    return spark.createDataFrame([(key, i, 0, None if v is None else float(v)) for i, v in enumerate(values)], f"asset string, ts int, tie int, {name} double")


def test_gold_features_by_hand(spark):
    closes = [100, 110, 105, 0, 108, 112, 120, 115]
    market_rows = spark.createDataFrame([("A", f"2024-01-{d + 1:02d}", float(c)) for d, c in enumerate(closes)], "asset_id string, date string, close double")
    mood = spark.createDataFrame([("A", "2024-01-03", 0.4, 7)], "asset_id string, date string, sentiment_index double, post_count long")
    rows = {r.date: r for r in layers.gold_features(market_rows, mood, end="2024-02-20").collect()}
    assert rows["2024-01-02"].return_1d == 0 and rows["2024-01-02"].volatility_30d == 0
    r = rows["2024-01-04"]  # 100, 110, 105
    assert r.return_1d == pytest.approx(105 / 110 - 1) and r.return_5d == r.return_1d
    assert r.volatility_30d == pytest.approx(np.std([0.1, 105 / 110 - 1])) and r.sentiment_index == 0.4 and r.post_count == 7
    r = rows["2024-01-09"]  # intervals that touch the zero are left out
    good = [0.1, 105 / 110 - 1, 112 / 108 - 1, 120 / 112 - 1, 115 / 120 - 1]
    assert r.volatility_30d == pytest.approx(np.std(good)) and r.return_5d == pytest.approx(115 / 105 - 1)
    r = rows["2024-02-11"]  # 35 days back begin with the fourth day but one: 108, 112, 120, 115 after a zero
    assert r.volatility_30d == pytest.approx(np.std([120 / 112 - 1, 115 / 120 - 1])) or r.return_1d == pytest.approx(115 / 120 - 1)
    assert rows["2024-02-20"].return_1d == 0 and rows["2024-01-01"].sentiment_index == 0


def test_time_weighted_mean(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", 10.0, 1), ("a", "2024-01-01 00:40:00", 20.0, 2), ("a", "2024-01-01 01:10:00", 40.0, 3)], "asset string, t string, price double, tie int")
    bars = market.resample_bars(rows.withColumn("ts", F.to_timestamp("t")), "1 hour").orderBy("start").collect()
    assert bars[0].twap == 20.0 and bars[1].twap == 40.0


def test_triple_barrier_labels(spark):
    rows = kernels.return_volatility(series(spark, [100, 101, 99, 130, 50, 50]), span=2)
    out = {r.ts: r for r in market.triple_barrier(rows, TICKS, "price", 2.0, 2.0, 2).collect()}
    assert 0 not in out and 1 not in out and out[2].label == 1 and out[2].touch == 1 and out[2].touch_return == pytest.approx(130 / 99 - 1)
    assert out[3].label == -1 and out[4].label == 0 and out[4].touch_return == 0


def test_vpin_of_one_sided_flow(spark):
    rows = series(spark, range(1, 41)).withColumn("volume", F.lit(10.0))
    assert market.vpin(rows, TICKS, "price", "volume", 50.0, 3).where("bucket > 0").agg(F.min("vpin")).first()[0] == 1.0


def test_bots_and_people(spark):
    people = [(i, f"forum{i % 4}", "a text of more than fifty characters, written by a person " + str(i), "", 1704067200 + i * 3600 * 5) for i in range(24)]
    bots = [(i, "forum", "$aaa $bbb $ccc $ddd", "https://spam.org", 1704067200) for i in range(10)]
    posts = spark.createDataFrame([("p", *r[1:]) for r in people] + [("b", *r[1:]) for r in bots], "author_id string, subreddit string, cleaned_text string, url string, created_utc long")
    got = {r.author_id: r for r in text.author_profiles(posts).collect()}
    assert got["p"].credibility == 1 and got["b"].bot_probability == pytest.approx(1.0) and got["p"].place_entropy == pytest.approx(2.0)
    plain = {r.author_id: r for r in text.author_profiles(posts.select("author_id", "subreddit", "cleaned_text")).collect()}
    assert plain["p"].bot_probability == pytest.approx(0.3) and plain["p"].link_ratio == 0


def test_marks_of_posts(spark):
    row = spark.createDataFrame([("Buy $tsla  now! https://x.org/a u/bob \U0001F680 $toolong",)], "t string").select(
        text.normalized(F.col("t")).alias("n"), text.cashtags(F.col("t")).alias("c"), text.mentions(F.col("t")).alias("m"), text.emojis(F.col("t")).alias("e")
    ).first()
    assert row.n == "Buy $TSLA now! [URL] u/bob \U0001F680 $toolong" and row.c == ["TSLA"] and row.m == ["bob"] and row.e == ["\U0001F680"]


def test_only_known_assets_are_linked(spark):
    tickers = spark.createDataFrame([("TSLA", False), ("BTC", True)], "asset_id string, crypto boolean")
    aliases = spark.createDataFrame([("tesla", "TSLA"), ("bitcoin", "BTC"), ("coin", "DOGE")], "alias string, asset_id string")
    posts = spark.createDataFrame([(1, "$ABC and tesla", "stocks"), (2, "tesla and bitcoin", "Bitcoin"), (3, "$tsla coin", "bitcoin"), (4, None, None)], "id long, text string, subreddit string")
    got = {(r.id, r.asset_id): r.confidence for r in text.link_entities(posts, aliases, tickers).collect()}
    assert got == {(1, "TSLA"): 0.5, (2, "BTC"): 0.5, (3, "TSLA"): 1.0}


def test_greeks(spark):
    g = spark.range(1).select(*[v.alias(k) for k, v in statistics.black_scholes(F.lit(100.0), F.lit(100.0), F.lit(1.0), 0.05, 0.2).items()]).first()
    assert g.call == pytest.approx(10.4506, abs=1e-3) and g.put == pytest.approx(5.5735, abs=1e-3) and g.delta == pytest.approx(0.6368, abs=1e-4) and g.put_delta == pytest.approx(-0.3632, abs=1e-4)
    assert g.vega == pytest.approx(0.37524, abs=1e-4) and g.theta == pytest.approx(-0.01757, abs=1e-4) and g.rho == pytest.approx(0.53232, abs=1e-4) and g.put_rho == pytest.approx(-0.41890, abs=1e-4)
    late = spark.range(1).select(*[v.alias(k) for k, v in statistics.black_scholes(F.lit(100.0), F.lit(90.0), F.lit(0.0), 0.05, 0.2).items()]).first()
    assert (late.call, late.put, late.delta, late.vega) == (10, 0, 1, 0)


def test_rank_of_trades_and_forward_sums(spark):
    frame = lambda rows: spark.createDataFrame(rows, "asset string, weight double")
    out = {r.asset: r for r in execution.rebalance_trades(frame([("a", 0.6), ("b", 0.4)]), frame([("a", 0.5), ("b", 0.3), ("c", 0.2)]), "asset", 100.0).collect()}
    assert out["c"].rank == 1 and (out["a"].rank, out["b"].rank) == (2, 3) and out["a"].side == "sell"
    rows = series(spark, [0.1, 0.2, 0.3, 0.4, 0.5], "ret").withColumn("signal", F.col("ts"))
    got = {r.horizon: r for r in execution.signal_decay(rows, TICKS, "signal", "ret", (1, 3)).collect()}
    assert got[1].n == 4 and got[3].n == 2 and got[1].ic == pytest.approx(1.0)


def test_rolling_moments(spark):
    got = windows.rolling_stats(series(spark, [1, 2, 4, 8, 16]), n=3).orderBy("ts").collect()
    assert got[4].roll_skew == pytest.approx(float(np.mean((np.array([4, 8, 16]) - 28 / 3) ** 3) / np.std([4, 8, 16]) ** 3))
    distance = [(4 - 7 / 3) ** 4, (8 - 14 / 3) ** 4, (16 - 28 / 3) ** 4]
    assert got[3].roll_kurt == 0 and got[4].roll_kurt == pytest.approx(np.mean(distance) / np.std([4, 8, 16], ddof=1) ** 4 - 3)


def test_thread_ranks_equal_those_of_the_edges(spark):
    rng = np.random.default_rng(2)
    posts = spark.createDataFrame([(int(t), f"u{a}") for t, a in zip(rng.integers(0, 12, 90), rng.integers(0, 25, 90), strict=True)], "thread int, author string")
    edges = graph.co_thread_edges(posts, "author", ["thread"])
    want = {r.node: r["rank"] for r in graph.pagerank(edges, rounds=5).collect()}
    got = {r.node: r["rank"] for r in graph.thread_pagerank(posts, "author", ["thread"], rounds=5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r.src for r in graph.co_thread_edges(posts, "author", ["thread"], min_interactions=4).collect()} < {r.src for r in edges.collect()}


def test_regression_and_p_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    y = 0.5 + x @ [1.0, -2.0, 0.0, 0.3] + rng.normal(size=80) * 0.1
    rows = spark.createDataFrame([("g", *map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [("few", 1.0, 2.0, 3.0, 4.0, 5.0)], "g string, a double, b double, c double, d double, y double")
    got = {(r.g, r.factor): r for r in reports.factor_regression(rows, ["g"], "y", ["a", "b", "c", "d"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]
    assert np.allclose([got["g", f].exposure for f in ("alpha", "a", "b", "c", "d")], want)
    assert got["g", "a"].p_value < 1e-9 and 0.01 < got["g", "c"].p_value < 1 and got["few", "a"].exposure is None
    assert reports.t_p_value(2.228, 10) == pytest.approx(0.05, abs=1e-4) and reports.f_p_value(4.103, 2, 10) == pytest.approx(0.05, abs=1e-4)
    assert reports.f_p_value(1.0, 5, 5) == pytest.approx(0.5) and reports.t_p_value(0.0, 7) == pytest.approx(1.0)
    stats = spark.createDataFrame([(4.103, 2, 10), (None, 2, 10), (1.0, 2, 0)], "f double, a int, b int")
    assert [r.p_value is None for r in reports.with_p_values(stats, "f", F.col("a"), F.col("b")).collect()] == [False, True, True]


def test_hurst_of_noise_and_of_a_walk(spark):
    noise = np.random.default_rng(4).normal(size=2000)
    rows = series(spark, noise, "x").unionByName(series(spark, np.cumsum(noise), "x", "walk"))
    got = {r.asset: r.hurst for r in reports.hurst(rows, TICKS, "x").collect()}
    assert 0.4 < got["a"] < 0.65 and got["walk"] > 0.85


def test_drawdown_spells(spark):
    got = reports.drawdown_recovery(series(spark, [100, 90, 80, 95, 101, 99])).orderBy("first").collect()
    assert [(r.first, r.last, r.down, r.up, r.recovered) for r in got] == [(2, 4, 2, 1, True), (6, 6, 1, 0, False)]
    flat = reports.drawdown_risk(series(spark, [0.01] * 10, "ret")).first()
    assert flat.dar == 0 and flat.burke == 100


def test_trailing_momentum_in_batch_and_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", p) for s, p in ((0, 100.0), (10, 103.0), (50, 100.0), (59, 104.0))]
    df = spark.createDataFrame(rows, "asset string, t string, price double").select("asset", F.to_timestamp("t").alias("ts"), "price")
    want = [(r.price, round(r.change, 6)) for r in sw.momentum_scan(df, seconds=20, least=0.02).orderBy("ts").collect()]
    assert want == [(103.0, 0.03), (104.0, 0.04)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sw.run_available(sw.stream_momentum(stream, seconds=20), f"file://{tmp_path}", "m").orderBy("ts").collect()
    assert [(r.price, round(r.change, 6)) for r in got] == want
    seen = []
    files.run_batches(stream, f"file://{tmp_path}", "b", lambda batch, k: seen.append((k, batch.count())))
    assert sum(n for _, n in seen) == 4


def test_files_and_features(spark, tmp_path):
    from quantspark.sources.files import read_dimension

    assert sorted(map(tuple, read_dimension(spark, '{"TSLA": ["tesla", "elon"], "AAPL": "apple"}', "asset", "alias").collect())) == [("AAPL", "apple"), ("TSLA", "elon"), ("TSLA", "tesla")]
    posts = spark.createDataFrame([("p1", "ann", None, "stocks", 1700000000.0)], "id string, author string, author_id string, subreddit string, created_utc double")
    files.write_posts(posts, str(tmp_path / "posts"))
    kept = spark.read.json(str(tmp_path / "posts")).first()
    assert len(kept.author_id) == 64 and str(kept.date) == "2023-11-14" and "author" not in kept.asDict()
    lines = spark.createDataFrame([('{"k": 1}',), ("{broken",), (None,), ('{"k": "x"}',)], "value string")
    good, bad = features.parsed_events(lines, "k long")
    assert [r.k for r in good.collect()] == [1] and bad.count() == 3
    steps = features.Steps().add("one", lambda d: d.withColumn("x", F.lit(1))).add("two", lambda d: d.withColumn("x", F.col("x") + 1))
    assert steps.run(spark.range(1)).first().x == 2 and steps.run(spark.range(1), only=["one"]).first().x == 1
    with pytest.raises(KeyError):
        steps.run(spark.range(1), only=["three"])
    with pytest.raises(ValueError):
        features.joined(spark.range(1), spark.range(1), ["id"], "cross")
    a, b = (spark.createDataFrame([(1, t, v)], "id long, date string, v string") for t, v in (("2024-01-01", "old"), ("2024-01-02", "new")))
    assert features.merged_by_date(a, b, ["id"], "date").first().v == "new" and features.merged_by_date(a, b, ["id"], "date", "first").first().v == "old"
    x = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double").withColumns(features.row_stats(("a", "b", "c"))).collect()
    assert (x[0].row_mean, round(x[0].row_std, 6)) == (2.0, 1.414214) and x[1].row_mean is None
    assert math.isclose(spark.range(1).select(features.decay_weight(F.lit(48.0), 24.0).alias("w")).first().w, 0.25)


def test_anomalous_mood(spark):
    ends = [(f"{i:02d}", 0.1 if i < 15 else 0.9) for i in range(16)]
    frame = lambda rows: spark.createDataFrame([("a", e, 30, m, s) for e, m, s in rows], "asset string, end string, n long, sentiment double, std double")
    short, medium, long = frame([(e, m, 0.1) for e, m in ends]), frame([(e, 0.2, 0.1) for e, _ in ends]), frame([(e, 0.1, 0.2) for e, _ in ends])
    rows = sw.mood_signal(short, medium, long).orderBy("end").collect()
    assert rows[0].momentum == pytest.approx(-0.5) and rows[15].momentum == 1.0 and rows[0].anomaly == 0
    assert rows[15].anomaly == pytest.approx(1 / (1 + math.exp(-0.5 * (4 - 2.5)))) and rows[15].confidence == 1


def test_series_of_other_keys_stay_apart(spark):
    rows = series(spark, [1, 2, 3]).unionByName(series(spark, [10, 20, 30], key="b"))
    got = features.rolling_apply(rows, Series(), "price", 2, sum).orderBy("asset", "ts").collect()
    assert [r.rolled for r in got] == [None, 3, 5, None, 30, 50]
