from __future__ import annotations

import json

from quantspark.operators import portfolio
from quantspark.sources import layers
from quantspark.streaming import windows


def post(i, **more):
    return {"id": f"p{i}", "author_id": f"u{i % 2}", "created_utc": 1700000000.0 + 86400 * (i // 3), "retrieved_at": "2023", "subreddit": "stocks", "title": f"Buy $TSLA post {i} first{i} second{i} third{i}", "selftext": "great and good", "score": 1, "num_comments": 0, "url": "", "permalink": ""} | more


def test_layers_round_trip(spark, tmp_path):
    raw = tmp_path / "raw" / "stocks"
    raw.mkdir(parents=True)
    for i in range(6):
        (raw / f"p{i}.json").write_text(json.dumps(post(i)))
    (raw / "again.json").write_text(json.dumps(post(0, retrieved_at="2024", title="Sell $AAPL")))
    (raw / "copy.json").write_text(json.dumps(post(9, title="Buy  $TSLA post 1 first1 second1 third1")))
    (raw / "broken.json").write_text("{not json")
    posts, corrupt = layers.read_posts(spark, str(tmp_path / "raw"))
    assert corrupt.count() == 1
    bronze = layers.bronze_posts(posts)
    assert bronze.count() == 7 and bronze.where("id = 'p0'").first().title == "Sell $AAPL"
    layers.write_days(bronze, str(tmp_path / "bronze"))
    layers.write_days(bronze.where("date = '2023-11-14'"), str(tmp_path / "bronze"))
    bronze = layers.read_days(spark, str(tmp_path / "bronze"))
    assert bronze.count() == 7
    aliases = spark.createDataFrame([("tesla", "TSLA")], "alias string, asset_id string")
    tickers = spark.createDataFrame([("TSLA", False), ("AAPL", False)], "asset_id string, crypto boolean")
    silver = layers.silver_posts(bronze, aliases, tickers)
    assert silver.count() == 6
    lexicon = spark.createDataFrame([("great", 1.0), ("good", 0.5)], "word string, score double")
    weights = spark.createDataFrame([("u0", 2.0)], "author_id string, weight double")
    daily = {(r.date, r.asset_id): (round(r.sentiment_index, 6), r.post_count) for r in layers.daily_sentiment(silver, lexicon, weights).collect()}
    assert daily[("2023-11-14", "AAPL")] == (0.75, 1) and daily[("2023-11-14", "TSLA")] == (0.75, 2)
    market = spark.createDataFrame([("TSLA", f"2023-11-{d:02d}", 100.0 + d) for d in range(10, 20)], "asset_id string, date string, close double")
    gold = {r.date: r for r in layers.gold_features(market, layers.daily_sentiment(silver, lexicon, weights)).collect()}
    assert gold["2023-11-13"].sentiment_index == 0.0 and gold["2023-11-14"].sentiment_index == 0.75
    assert gold["2023-11-12"].return_1d == 111 / 110 - 1 and gold["2023-11-12"].related_return_1 == 0
    assert gold["2023-11-11"].return_1d == 0 and gold["2023-11-20"].return_5d == 119 / 114 - 1 and len(gold) == 11


def test_stream_gives_the_batch_windows(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", 0.1 * (m % 5), 1.0) for m in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "asset string, ts string, sentiment double, weight double").selectExpr("asset", "to_timestamp(ts) AS ts", "sentiment", "weight")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = windows.run_available(windows.sentiment_windows(stream, 15, 5), f"file://{tmp_path}", "w")
    batch = windows.sentiment_windows(df, 15, 5)
    want = {(r.asset, r.start): (r.n, r.sentiment) for r in batch.collect()}
    seen = {(r.asset, r.start): (r.n, r.sentiment) for r in got.collect()}
    assert seen and all(want[k] == v for k, v in seen.items())
    assert len(seen) >= len(want) - 6


def test_stop_state_carries_over_triggers(spark, tmp_path):
    prices = [100.0, 120.0, 107.0, 130.0]
    df = spark.createDataFrame([("a", f"2024-01-01 00:00:{i:02d}", p) for i, p in enumerate(prices)], "asset string, ts string, price double").selectExpr("asset", "to_timestamp(ts) AS ts", "price")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    rows = windows.run_available(windows.stop_states(stream), f"file://{tmp_path}", "s").orderBy("ts").collect()
    assert [round(r.stop, 6) for r in rows] == [90, 108, 108, 117] and [r.hit for r in rows] == [False, False, True, False]


def test_allocations_and_monte_carlo(spark):
    rows = [(a, t, x * (1 + 0.5 * k)) for k, a in enumerate("abc") for t, x in enumerate([0.01, -0.02, 0.015, 0.007, -0.01 * (k + 1)])]
    out = portfolio.allocations(spark, spark.createDataFrame(rows, "asset string, ts int, ret double")).toPandas()
    for c in ("minimum_variance", "risk_parity", "hierarchical"):
        assert abs(out[c].sum() - 1) < 1e-9
    a = portfolio.monte_carlo(spark, 0.0, 0.01, paths=2500, horizon=20)
    assert a.count() == 2500
    assert a.orderBy("path").limit(5).collect() == portfolio.monte_carlo(spark, 0.0, 0.01, paths=2500, horizon=20).repartition(3).orderBy("path").limit(5).collect()
