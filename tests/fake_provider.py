"""Providers for the connector tests."""

from __future__ import annotations

CALLS = {"n": 0}


def bars(symbol, start, end):
    CALLS["n"] += 1
    if symbol == "FLAKY" and CALLS["n"] < 2:
        raise OSError("try again")
    return [(start, 1, 2, 0.5, 1.5, 100), (end, 1.5, 2.5, 1, 2, 200)]


def posts(place, limit):
    return [{"id": f"{place}{i}", "author_id": "a", "subreddit": place, "title": "t", "selftext": "", "created_utc": 100.0 + i} for i in range(5, 0, -1)][:limit]
