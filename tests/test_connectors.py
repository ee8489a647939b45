from __future__ import annotations

import pytest

from quantspark.sources import connectors


def test_bars(spark):
    spark.dataSource.register(connectors.BarSource)
    rows = spark.read.format("bars").options(provider="tests.fake_provider:bars", symbols="A, FLAKY", start="2024-01-01", end="2024-01-02", wait="0.01").load().collect()
    assert sorted((r.symbol, r.date, r.close) for r in rows) == [("A", "2024-01-01", 1.5), ("A", "2024-01-02", 2.0), ("FLAKY", "2024-01-01", 1.5), ("FLAKY", "2024-01-02", 2.0)]


def test_retries_end():
    def fails():
        raise OSError("no")

    with pytest.raises(OSError):
        connectors.with_retries(fails, wait=0.001)


def test_posts_stop_at_the_last_one_seen():
    stream = connectors._PostStream({"provider": "tests.fake_provider:posts", "subreddits": "stocks,bitcoin"})
    rows, end = stream.read(stream.initialOffset())
    assert len(list(rows)) == 10 and end == {"stocks": 105.0, "bitcoin": 105.0}
    rows, again = stream.read(end)
    assert list(rows) == [] and again == end
    assert sorted(r[0] for r in stream.readBetweenOffsets({"stocks": 103.0, "bitcoin": 105.0}, end)) == ["stocks4", "stocks5"]
