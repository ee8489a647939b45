"""Series in pieces give what windows over whole series give."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quantspark import pieces
from quantspark.frames import Series
from quantspark.operators import breaks, diagnostics, joins, market, reports, risk

S = Series(("who",), ("ts", "tie"))


@pytest.fixture
def trades(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, n in (("a", 400), ("b", 90), ("c", 7), (None, 130)):
        # Gaps and crowds in time, so that pieces are of all sizes, some of a row or two.
        at = np.sort(np.concatenate([rng.integers(0, 400_000, n - n // 3), rng.integers(399_000, 400_000, n // 3)]))
        scale = np.where(np.arange(n) < n // 2, 1.0, 4.0)
        for i in range(n):
            pnl = None if rng.random() < 0.05 else float(np.round(rng.normal() * scale[i]))
            rows.append((k, int(at[i]), i, float(rng.integers(1, 50)), float(np.round(100 + rng.normal())), pnl))
    rows += [("a", None, -1, 3.0, 101.0, 1.0), ("a", None, -2, 4.0, 99.0, -1.0)]
    df = spark.createDataFrame(rows, "who string, sec long, tie long, quantity double, price double, pnl double")
    return df.selectExpr("who", "timestamp_seconds(sec) AS ts", "tie", "quantity", "price", "pnl").repartition(5).cache()


JOBS = {
    "volume_bars": lambda d: reports.volume_bars(d, S, "price", "quantity", 200.0),
    "spearman": lambda d: joins.spearman(d, ["who"], "quantity", "pnl"),
    "hurst": lambda d: reports.hurst(d, S, "price"),
    "trade_habits": lambda d: diagnostics.trade_habits(d, S),
    "streaks": lambda d: risk.streaks(d, S),
    "variance_breaks": lambda d: breaks.variance_breaks(d, S, "pnl", min_segment=12),
    "variance_segments": lambda d: breaks.variance_segments(d, S, "pnl", min_segment=12),
    "extreme_tail": lambda d: breaks.extreme_tail(d, S, "pnl", confidence=0.95, block=5),
    "order_imbalance": lambda d: market.order_imbalance(d, S, "price", "quantity", 10),
    "vpin": lambda d: market.vpin(d, S, "price", "quantity", 200.0, 5),
    "runs_test": lambda d: diagnostics.runs_test(d, S, "pnl"),
    "kyle_lambda": lambda d: market.kyle_lambda(d, S, "price", "quantity"),
}


def told(df):
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    return sorted(rows, key=lambda r: [(v is None, str(round(v, 6) if isinstance(v, float) else v)) for v in r])


def near(a, b, least=1e-6):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= least * max(1.0, abs(b))
    return a == b


@pytest.mark.parametrize("name", JOBS)
def test_pieces_give_what_whole_series_give(spark, trades, monkeypatch, name):
    want = told(JOBS[name](trades))
    monkeypatch.setattr(pieces, "PIECE", 40)
    monkeypatch.setattr(joins, "COMMON", 12)
    monkeypatch.setattr(reports, "CHUNK", 20)
    got = told(JOBS[name](trades))
    assert want and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        # A fit ends where its steps are small, which depends on the order of sums.
        assert all(near(u, v, 1e-4 if name == "extreme_tail" else 1e-6) for u, v in zip(a, b, strict=True)), (a, b)


def test_no_window_holds_a_long_series(spark, trades, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", 40)
    d = pieces.dealt(trades, S).lag(before="price").past(9)
    sizes = {(r["who"], r["__piece"]): r["count"] for r in d.rows.where("NOT __past").groupBy("who", "__piece").count().collect()}
    assert sum(sizes.values()) == trades.count() and max(sizes.values()) < 120
    assert len([k for k, _ in sizes if k == "a"]) > 5 and [p for k, p in sizes if k == "c"] == [0]
    assert pieces.dealt(trades.limit(0), S).lag(before="price").rows.count() == 0


def test_numbers_and_totals_cross_pieces(spark, trades, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", 40)
    rows = pieces.dealt(trades.where("who = 'a'"), S).number("n").total("t", "pnl").lag(before="price").last_known("known", "pnl").rows.orderBy("n").collect()
    assert [r.n for r in rows] == list(range(402))
    sum_, known = None, None
    for i, r in enumerate(rows):
        if r.pnl is not None:
            sum_, known = (sum_ or 0.0) + r.pnl, r.pnl
        assert (r.t, r.known) == (sum_, known)
        assert r.before == (rows[i - 1].price if i else None)
