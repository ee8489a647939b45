from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantspark.llm import packing

from .helpers import awkward, documents

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*EXACT.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, docs):
    """Every id of every text once, pieces of right sizes, sequences gapless and within capacity."""
    by_text = {}
    for r in rows:
        by_text.setdefault(r.doc_id, []).append(r)
    for d in docs:
        ids = ids_of(d.text)
        pieces = sorted(by_text[d.doc_id], key=lambda r: r.piece)
        copies = sum(x.doc_id == d.doc_id for x in docs)
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert r.length == 1024 or r.piece == 0
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_round_trip_and_awkward_rows(spark):
    docs = awkward(spark)
    check(packing.pack_digest(docs).collect(), docs.select("doc_id", "text").collect())


def test_empty_table(spark):
    assert packing.pack_digest(documents(spark, [])).collect() == []


def test_few_sequences(spark):
    rng = np.random.default_rng(3)
    docs = documents(spark, [" ".join(["word"] * int(n)) for n in rng.integers(1, 2500, 1500)])
    rows = packing.pack_digest(docs).collect()
    used = check(rows, docs.collect())
    assert used <= 1.02 * sum(r.length for r in rows) / 1024 + 3


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_both_tokenizers_agree(text):
    assert packing.token_ids(text) == ids_of(text)


#: Parts of texts that both tokenizers may take: words, contractions, numbers, accents, white space of all kinds.
USUAL = st.sampled_from(["the", "Don't", " we'll", "ÄÖÜ", "straße", "naïve", "12345", "3.14", " ", "  ", "\n", "\n\n", "\t", "\r\n", "...", "--", "(a)", "_x_", "AKIA", "q7Zk2LmX", "https://x.org/?a=b", "\"", "'", "s", "é", "!?"])


@settings(max_examples=200, deadline=None)
@given(st.lists(USUAL, max_size=60).map("".join))
def test_both_tokenizers_agree_on_usual_texts(text):
    assert not packing.UNUSUAL.search(text) and packing.token_ids(text) == ids_of(text)


def test_both_tokenizers_agree_on_long_texts():
    rng = np.random.default_rng(5)
    parts = ["word ", "Don't ", "straße, ", "12345 ", "\n\n", "x" * 50 + " ", "   "]
    text = "".join(parts[i] for i in rng.integers(0, len(parts), 60_000))
    assert packing.token_ids(text) == ids_of(text)


def test_special_token_text():
    assert packing.token_ids("a <|endoftext|> b") == ids_of("a <|endoftext|> b")


def brute_sum_of_squares(lengths, capacity):
    levels, placed = [], []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        s = lengths[i]
        best = None
        for level in [0, *sorted(set(levels), reverse=True)]:
            if level + s > capacity or level == capacity:
                continue
            after = [*levels, s] if level == 0 else [*levels]
            if level:
                after[after.index(level)] = level + s
            cost = sum(after.count(x) ** 2 for x in set(after) if x < capacity)
            key = (cost, -level)
            if best is None or key < best[0]:
                best = (key, level)
        if best[1] == 0:
            levels.append(s)
        else:
            levels[levels.index(best[1])] = best[1] + s
        placed.append(sorted(levels))
    return sorted(levels)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 11), min_size=1, max_size=25))
def test_rule_matches_brute_force(lengths):
    x = np.array(lengths)
    assert sorted(int(x[s].sum()) for s in packing.sum_of_squares(x, 12)) == brute_sum_of_squares(lengths, 12)
