"""Python data sources for bar providers and post listings. The provider is a function named in an option, so that no
network library or credential is part of the engine.

    spark.dataSource.register(BarSource)
    spark.read.format("bars").option("provider", "my_module:fetch").option("symbols", "A,B").option("start", "2024-01-01").load()
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

BAR_SCHEMA = "symbol string, date string, open double, high double, low double, close double, volume double"
POST_SCHEMA = "id string, author_id string, subreddit string, title string, selftext string, created_utc double"
TRIES = 3


def provider(name: str) -> Callable:
    """module:function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def with_retries(call: Callable, *args, tries: int = TRIES, wait: float = 0.5):
    """Tries again after 1, 2, 4 ... times wait; the last error is raised."""
    for k in range(tries):
        try:
            return call(*args)
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    return None


class BarSource(DataSource):
    """Daily bars, one partition per symbol: provider(symbol, start, end) -> rows of (date, open, high, low, close, volume)."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return BAR_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BarReader(self.options)


class _Symbol(InputPartition):
    def __init__(self, symbol: str) -> None:
        self.symbol = symbol


class _BarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[_Symbol]:
        return [_Symbol(s.strip()) for s in self.options.get("symbols", "").split(",") if s.strip()]

    def read(self, partition: _Symbol) -> Iterator[tuple]:
        fetch = provider(self.options["provider"])
        rows = with_retries(fetch, partition.symbol, self.options.get("start"), self.options.get("end"), wait=float(self.options.get("wait", 0.5)))
        for date, *values in rows:
            yield (partition.symbol, str(date), *map(float, values))


class PostSource(DataSource):
    """Posts newer than the last one seen: provider(subreddit, limit) -> dicts, newest first. The offset of a stream is
    the latest created_utc of each place, so that reading stops at the first known post."""

    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> str:
        return POST_SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PostStream(self.options)


class _PostStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.places = [p.strip() for p in self.options.get("subreddits", "").split(",") if p.strip()]

    def initialOffset(self) -> dict:
        return {p: 0.0 for p in self.places}

    def _fetch(self, place: str) -> list[dict]:
        return with_retries(provider(self.options["provider"]), place, int(self.options.get("limit", 1000)), wait=float(self.options.get("wait", 0.5)))

    def _rows(self, place: str, after: float, upto: float = float("inf")) -> list[tuple]:
        out = []
        for post in self._fetch(place):
            if post["created_utc"] <= after:
                break
            if post["created_utc"] <= upto:
                out.append(tuple(post.get(c.split()[0]) for c in POST_SCHEMA.split(", ")))
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for place in self.places:
            found = self._rows(place, start.get(place, 0.0))
            rows += found
            end[place] = max([start.get(place, 0.0), *(r[-1] for r in found)])
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for place in self.places:
            yield from self._rows(place, start.get(place, 0.0), end.get(place, 0.0))

    def commit(self, end: dict) -> None:
        json.dumps(end)  # offsets are plain numbers; Spark keeps them in the stream's checkpoint
