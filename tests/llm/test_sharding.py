from __future__ import annotations

import zlib
from collections import Counter

from quantspark.llm import sharding
from quantspark.llm.common import Scratch

from .helpers import awkward, documents


def check(rows, shards=16):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)


def test_sizes_slots_and_groups(spark):
    texts = [f"group {i // 5}" if i < 600 else f"single {i}" for i in range(1505)]
    rows = sharding.shard_digest(documents(spark, texts)).collect()
    check(rows)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    places = {}
    for r in rows:
        places.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(p) == 1 for p in places.values())


def test_group_larger_than_a_shard_spreads_over_few(spark):
    texts = ["copy"] * 700 + [f"pair {i // 2}" for i in range(300)] + [f"single {i}" for i in range(1000)]
    rows = sharding.shard_digest(documents(spark, texts)).collect()
    check(rows)
    held = Counter(r.shard for r in rows if r.doc_id < 700)
    assert len(held) <= 9
    pairs = {}
    for r in rows:
        if 700 <= r.doc_id < 1000:
            pairs.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(p) > 1 for p in pairs.values()) <= 15


def test_everything_linked(spark):
    rows = sharding.shard_digest(documents(spark, [f"pair {i // 2}" for i in range(640)])).collect()
    check(rows)
    places = {}
    for r in rows:
        places.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 32


def test_numbers_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 7)
    rows = spark.range(100).withColumnRenamed("id", "row").withColumn("by", sharding.F.col("row") % 3)
    got = sharding.numbered(rows, Scratch(spark, "test"), 100, "by").collect()
    for k in range(3):
        assert sorted(r.number for r in got if r.by == k) == list(range(len([r for r in got if r.by == k])))


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = sharding.shard_digest(docs).collect()
    assert len(rows) == docs.count()
    check(rows)
    assert [r.size for r in rows if r.doc_id == 0] == [1] and [r.text_crc32 for r in rows if r.doc_id == 0] == [0]
    assert sharding.shard_digest(docs.limit(0)).count() == 0
