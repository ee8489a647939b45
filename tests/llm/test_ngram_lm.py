from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quantspark.llm import elias_fano, ngram_lm

from .helpers import FOLD, awkward, documents, words

numbers = st.lists(st.one_of(st.integers(0, 200), st.integers(0, 1 << 40)), min_size=1, max_size=200).map(sorted)


@settings(max_examples=150, deadline=None)
@given(numbers, st.lists(st.one_of(st.integers(0, 210), st.integers(0, 1 << 41)), min_size=1, max_size=60))
def test_sequence(values, targets):
    ef = elias_fano.EliasFano.build(np.array(values))
    assert ef.access(np.arange(len(values))).tolist() == values
    want = np.searchsorted(values, targets + values, side="left")
    equals = [i < len(values) and values[i] == t for i, t in zip(want, targets + values, strict=True)]
    place, equal = ef.successor(np.array(targets + values))
    assert place.tolist() == want.tolist() and equal.tolist() == equals
    # One at a time, which never reads a long sequence whole.
    ef = elias_fano.EliasFano.build(np.array(values))
    told = [ef.successor(np.array([t])) for t in targets + values]
    assert [int(p[0]) for p, _ in told] == want.tolist() and [bool(e[0]) for _, e in told] == equals


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(1, 40), st.integers(1, 300)), st.floats(-9, 0), min_size=0, max_size=300))
def test_trie_level(tmp_path_factory, pairs):
    folder = str(tmp_path_factory.mktemp("trie"))
    keys = sorted(pairs)
    c, w = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    logs = np.array([pairs[k] for k in keys])
    elias_fano.TrieLevel.write(folder, "x", c, w, logs)
    level = elias_fano.TrieLevel.open(folder, "x")
    asked = sorted({*keys, *((a, b) for a in range(0, 42, 3) for b in range(0, 320, 17))})
    place, above = level.find(np.array([a for a, _ in asked]), np.array([b for _, b in asked]))
    assert [x >= 0 for x in place] == [k in pairs for k in asked]
    assert [x >= 0 for x in above] == [a in {c for c, _ in pairs} for a, _ in asked]
    if pairs:
        assert place[place >= 0].tolist() == list(range(len(keys)))
        assert np.abs(level.logs(place[place >= 0]) - logs).max() <= (logs.max() - logs.min()) / 254 + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1 << 34), st.integers(0, 1 << 33)), min_size=1, max_size=60))
def test_distinct_rows_and_their_code(rows):
    columns, inverse = elias_fano.distinct([np.array(x) for x in zip(*rows, strict=True)])
    assert list(zip(*(x.tolist() for x in columns), strict=True)) == sorted(set(rows))
    assert [sorted(set(rows))[i] for i in inverse] == rows
    assert [x.tolist() for x in ngram_lm.decode(ngram_lm.encode(columns))] == [x.tolist() for x in columns]


def test_probabilities_of_the_trie_sum_to_one(tmp_path):
    rng = random.Random(1)
    vocabulary, plain = range(1, 21), {w: (w + 1) / 231.0 for w in range(21)}
    plain[0] = 1 - sum(plain[w] for w in vocabulary)
    counts = Counter((rng.randint(1, 6), rng.randint(1, 5), rng.choice(vocabulary)) for _ in range(150))
    counts |= {(c, 0, rng.choice(vocabulary)): rng.randint(1, 9) for c in (50, 50, 50, 51, 51)}
    total = {c: sum(n for (x, _, _), n in counts.items() if x == c) for c in (50, 51)}
    keys = sorted(counts)
    arrays = lambda rows: [np.array(x, np.int64) for x in zip(*rows, strict=True)]
    elias_fano.Trie.write(str(tmp_path), *arrays(keys), np.array([counts[k] for k in keys]), np.array([plain[w] for _, _, w in keys]), np.array([total.get(c, 0) for c, _, _ in keys]), (4.0, 2.0, 0.2), 16)
    trie = elias_fano.Trie(str(tmp_path))
    for c, u in [(c, u) for c in range(1, 8) for u in range(7)] + [(50, 0), (51, 0)]:
        asked = [(c, u, w) for w in range(21)]
        _, logs = trie.look_up(*arrays(asked), np.log10([plain[w] for w in range(21)]), np.full(21, total.get(c, 0)), 0.2)
        assert math.isclose(sum(10.0**logs), 1.0, abs_tol=1e-3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 60), max_size=50))
def test_packed_numbers(values):
    assert ngram_lm.load(ngram_lm.dump(np.array(values, np.int64))).astype(np.int64).tolist() == values


def mixed(x):
    x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 % 2**64
    return x ^ (x >> 29)


def word_ids(one, shards, hot):
    """Ids by falling count, as the word shards give them (ties by hash)."""
    import xxhash

    out = {}
    for shard in range(shards):
        hashes = {xxhash.xxh64_intdigest(w.encode()): w for w in one}
        mine = [h for h in sorted(hashes) if (mixed(h) >> 32) * shards >> 32 == shard]
        at = 0
        for h in sorted(mine, key=lambda h: -one[hashes[h]]):
            out[hashes[h]] = at * shards + shard + 1
            at += max(1, -(-one[hashes[h]] // hot))
    return out


def compare(rows, texts, tolerance, hot=ngram_lm.HOT, word_shards=1):
    tokens = [[*words((t or "").translate(FOLD)), "\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    triples = [list(zip(["\n", "\n", *t], ["\n", *t], t, strict=False)) for t in tokens]
    one, three, context = Counter(), Counter(), Counter()
    for t, h, own in zip(tokens, held, triples, strict=True):
        if not h:
            one.update(t)
            three.update(own)
            context.update(x[:2] for x in own)
    ids = word_ids(one, word_shards, hot)
    bucket = lambda u, v: mixed(ids.get(u, 0)) % max(1, -(-one[v] // hot))
    pair, middle = Counter(), Counter()
    for (u, v, w), n in three.items():
        if context[u, v] <= hot:
            pair[v, bucket(u, v), w] += n
            middle[v, bucket(u, v)] += n
    total, kinds = sum(one.values()), len(one)
    second, third, share = ngram_lm.PRIORS
    pair_kinds, triple_kinds = Counter(k[:2] for k in pair), Counter(k[:2] for k in three)
    frequent = 0
    for r in rows:
        t = tokens[r.doc_id]
        plain = [(one[x] + 1) / (total + kinds + 1) for x in t]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(one[x] > 0 for x in t), total)
        assert math.isclose(r.base_score, sum(map(math.log10, plain)), rel_tol=1e-9)
        score = 0.0
        for p, (u, v, w) in zip(plain, triples[r.doc_id], strict=True):
            if one[v]:
                frequent += context[u, v] > hot
                b = bucket(u, v)
                low, prior = p, share * context[u, v]
                if context[u, v] <= hot:
                    low, prior = p, second * pair_kinds[v, b]
                    if prior:
                        low = (pair[v, b, w] + prior * p) / (middle[v, b] + prior)
                    prior = third * triple_kinds[u, v]
                p = (three[u, v, w] + prior * low) / (context[u, v] + prior) if prior else low
            score += math.log10(p)
        assert abs(r.score - score) <= tolerance * len(t)
    return frequent


def corpus(n=300):
    rng = random.Random(3)
    vocabulary = [f"W{i}" for i in range(300)]
    after = {w: rng.sample(vocabulary, 4) for w in vocabulary}
    texts = []
    for _ in range(n):
        w, out = rng.choice(vocabulary), []
        for _ in range(rng.randint(0, 60)):
            out.append(w if rng.random() < 0.9 else w.lower())
            w = rng.choice(after[w]) if rng.random() < 0.8 else rng.choice(vocabulary)
        texts.append(" ".join(out))
    return [*texts, None, "", "the only text with these words"]


def test_scores_match_brute_force_and_held_out_gains(spark):
    texts = corpus()
    rows = ngram_lm.score_corpus(documents(spark, texts))[0].collect()
    assert len(rows) == len(texts)
    compare(rows, texts, 0.03)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_many_blocks_shards_and_frequent_contexts(spark, monkeypatch):
    texts = [*corpus(120), *["w1 w2 w3 w1 w2 w4 " * 9] * 3]
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(ngram_lm, "SHARD_WORDS", 4000)
    monkeypatch.setattr(ngram_lm, "SHARD_ENTRIES", 80)
    monkeypatch.setattr(ngram_lm, "HOT", 12)
    scores, trie = ngram_lm.score_corpus(documents(spark, texts), keep_trie=True)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").mapInPandas(ngram_lm.make_blocks, ngram_lm.BLOCK_TYPE)
    shards = -(-asked.agg({"n_words": "sum"}).first()[0] // 4000)
    assert compare(scores.collect(), texts, 0.03, hot=12, word_shards=shards) > 20
    assert trie.count() > 3 and all(len(r.trie) > 0 for r in trie.collect())


def test_a_context_seen_once_predicts(spark):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    texts = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}" for i in range(50)]
    texts[held] = texts[held + 1]
    row = next(r for r in ngram_lm.score_corpus(documents(spark, texts))[0].collect() if r.doc_id == held)
    assert row.held_out and row.score > row.base_score / 2


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = ngram_lm.score_corpus(docs)[0].collect()
    assert len(rows) == docs.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert ngram_lm.score_corpus(docs.limit(0))[0].count() == 0
