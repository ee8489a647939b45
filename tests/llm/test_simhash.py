from __future__ import annotations

import random

import xxhash

from quantspark.llm import simhash
from quantspark.llm.common import Scratch, connected_components

from .helpers import FOLD, awkward, documents, words


def brute_fingerprint(text):
    w = words((text or "").translate(FOLD))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """{id: smallest id reachable} over links of two bits at most, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(40):
        w = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(120)]
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v).upper())
    texts += ["", None, " ", "A b", "a  B", texts[0], "one"]
    rows = simhash.simhash_digest(documents(spark, texts)).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert prints == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in rows} == components(prints)
    kept = {r.doc_id for r in simhash.keep_one_per_group(documents(spark, texts)).collect()}
    assert kept == set(components(prints).values())


def linked(spark, values, bits, crowded):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    scratch = Scratch(spark, "test")
    links = simhash.near_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), scratch, bits, crowded).collect()
    for r in links:
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= bits and r.a < r.b
    root = {v: v for v in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        root[find(r.a)] = find(r.b)
    return signed, find


def test_no_link_is_lost_however_crowded(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {0, (1 << 64) - 1, 1 << 63, 1 << 31, 1 << 32}
    for bits in (1, 2):
        for crowded in (0, 5, 1000):
            signed, find = linked(spark, values, bits, crowded)
            for k, a in enumerate(signed):
                for b in signed[k + 1 :]:
                    if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits:
                        assert find(a) == find(b)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1100)) and 5000 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert simhash.simhash_digest(docs).count() == docs.count()
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [0, 3, 4, 5] and None in ids
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0
