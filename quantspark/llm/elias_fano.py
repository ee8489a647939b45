"""Elias-Fano sequences and the trie built of them, kept in memory-mapped files and queried in batches.

A monotone sequence keeps the low bits of each value in a packed array and its high bits in unary: one set bit for
each value, one clear bit at the end of each run of equal high bits. Selecting the clear bits around a value's high
bits gives the few values that share them, so a successor is found without decoding anything else. A batch about as
long as the sequence reads it once from front to back and searches there.
"""

from __future__ import annotations

import os

import numpy as np

U = np.uint64


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with that rank (from 0) in each word."""
    x, r = words.copy(), rank.astype(np.int64)
    at = np.zeros(len(x), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(x & U((1 << width) - 1)).astype(np.int64)
        go = r >= below
        r -= np.where(go, below, 0)
        step = np.where(go, width, 0)
        x >>= step.astype(U)
        at += step
    return at


class EliasFano:
    """A sorted sequence of non-negative integers below 2^62."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        self._all: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        place = (values >> bits) + np.arange(n)
        high = np.zeros(((top >> bits) + 1 + n) // 64 + 1, U)
        np.bitwise_or.at(high, place >> 6, U(1) << (place & 63).astype(U))
        low = np.zeros(n * bits // 64 + 2, U)
        if bits:
            rest = (values & ((1 << bits) - 1)).astype(U)
            at = np.arange(n, dtype=np.int64) * bits
            shift = (at & 63).astype(U)
            np.bitwise_or.at(low, at >> 6, rest << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, rest[over] >> (U(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]
        return cls(n, bits, low, high, ones)

    def save(self, folder: str, name: str) -> None:
        for part, array in (("low", self.low), ("high", self.high), ("ones", self.ones)):
            np.save(os.path.join(folder, f"{name}.{part}.npy"), array)
        np.save(os.path.join(folder, f"{name}.head.npy"), np.array([self.n, self.low_bits]))

    @classmethod
    def open(cls, folder: str, name: str) -> EliasFano:
        part = lambda p: np.load(os.path.join(folder, f"{name}.{p}.npy"), mmap_mode="r")
        n, bits = part("head").tolist()
        return cls(n, bits, part("low"), part("high"), part("ones"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift
        over = (at & 63) + self.low_bits > 64
        value[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return (value & U((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, rank: np.ndarray, clear: bool) -> np.ndarray:
        table = self.zeros if clear else self.ones
        word = np.searchsorted(table, rank, side="right") - 1
        bits = self.high[word]
        return word * 64 + _select_in_word(~bits if clear else bits, rank - table[word])

    def _decoded(self, asked: int) -> np.ndarray | None:
        """All values, where so many are asked for that reading the sequence once costs less than finding each."""
        if self._all is None and asked * 8 >= self.n:
            places = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
            every = np.arange(self.n)
            self._all = ((places - every) << self.low_bits) | self._low(every)
        return self._all

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        decoded = self._decoded(len(i))
        if decoded is not None:
            return decoded[i]
        return ((self._select(i, False) - i) << self.low_bits) | self._low(i)

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value not below the target, n if there is none; whether it equals the target)."""
        if not self.n:
            return np.zeros(len(targets), np.int64), np.zeros(len(targets), bool)
        decoded = self._decoded(len(targets))
        if decoded is not None:
            place = np.searchsorted(decoded, targets)
            return place, decoded[np.minimum(place, self.n - 1)] == targets
        last = self.access(np.array([self.n - 1]))[0]
        inside = targets <= last
        high = np.where(inside, targets, 0) >> self.low_bits
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - np.maximum(high - 1, 0), 0)
        end = self._select(high, True) - high
        rest = targets & ((1 << self.low_bits) - 1)
        low, up = begin.copy(), end.copy()
        todo = np.flatnonzero(low < up)
        while len(todo):
            middle = (low[todo] + up[todo]) >> 1
            less = self._low(middle) < rest[todo]
            low[todo[less]] = middle[less] + 1
            up[todo[~less]] = middle[~less]
            todo = todo[low[todo] < up[todo]]
        found = inside & (low < end)
        equal = np.zeros(len(targets), bool)
        hit = np.flatnonzero(found)
        equal[hit] = self._low(low[hit]) == rest[hit]
        return np.where(inside, low, self.n), equal


class TrieLevel:
    """Contexts, pointers to their successors, a quantised log10 probability for each successor and a quantised log10
    back-off weight for each context.

    Successors count from where the range of the context before ended, so that all ranges make one monotone
    sequence; a look-up adds that start to the word and searches the successor within the context's range. Contexts
    that are the places of a level above, all of them, need no sequence of their own.
    """

    def __init__(self, contexts: EliasFano | None, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, book: np.ndarray, weights: np.ndarray, weight_book: np.ndarray) -> None:
        self.contexts, self.pointers, self.successors = contexts, pointers, successors
        self.codes, self.book, self.weights, self.weight_book = codes, book, weights, weight_book

    @staticmethod
    def write(folder: str, name: str, contexts: np.ndarray, words: np.ndarray, logs: np.ndarray | None = None, weights: np.ndarray | None = None, bits: int = 8, places: bool = False) -> None:
        """contexts, words: sorted pairs, each once; logs: their log10 probabilities; weights: one for each context."""
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(contexts))
        widths = words[ends - 1] + 1 if len(first) else np.zeros(0, np.int64)
        base = np.repeat(np.cumsum(widths) - widths, ends - first)
        if not places:
            EliasFano.build(contexts[first]).save(folder, f"{name}.contexts")
        EliasFano.build(np.append(first, len(contexts))).save(folder, f"{name}.pointers")
        EliasFano.build(base + words).save(folder, f"{name}.successors")
        for part, values in (("", logs), ("weight_", weights)):
            book, codes = quantise(np.zeros(0) if values is None else values, bits)
            np.save(os.path.join(folder, f"{name}.{part}codes.npy"), codes)
            np.save(os.path.join(folder, f"{name}.{part}book.npy"), book)

    @classmethod
    def open(cls, folder: str, name: str) -> TrieLevel:
        part = lambda p: np.load(os.path.join(folder, f"{name}.{p}.npy"), mmap_mode="r")
        known = os.path.exists(os.path.join(folder, f"{name}.contexts.head.npy"))
        sequences = (EliasFano.open(folder, f"{name}.{p}") for p in ("pointers", "successors"))
        return cls(EliasFano.open(folder, f"{name}.contexts") if known else None, *sequences, part("codes"), part("book"), part("weight_codes"), part("weight_book"))

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each pair, place of its context), -1 for what the level does not hold. Sorted by context."""
        place, above = np.full(len(contexts), -1), np.full(len(contexts), -1)
        if not self.successors.n or not len(contexts):
            return place, above
        start = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
        repeats = np.diff(np.append(start, len(contexts)))
        if self.contexts is None:
            at, known = contexts[start], np.ones(len(start), bool)
        else:
            at, known = self.contexts.successor(contexts[start])
            at = np.where(known, at, 0)
        begin, end = self.pointers.access(at), self.pointers.access(at + 1)
        base = np.where(begin > 0, self.successors.access(np.maximum(begin - 1, 0)) + 1, 0)
        begin, end, base, known, at = (np.repeat(x, repeats) for x in (begin, end, base, known, at))
        above[known] = at[known]
        found, equal = self.successors.successor(base + words)
        hit = known & equal & (found >= begin) & (found < end)
        place[hit] = found[hit]
        return place, above

    def logs(self, place: np.ndarray) -> np.ndarray:
        return np.asarray(self.book)[self.codes[place]]

    def weight(self, above: np.ndarray) -> np.ndarray:
        return np.asarray(self.weight_book)[self.weights[above]]


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of the distinct rows in sorted order, number of each row among them) of non-negative integers."""
    columns, kinds = list(columns), [None] * len(columns)
    widths = [int(x.max(initial=0)).bit_length() for x in columns]
    for i, x in enumerate(columns):
        if sum(widths) > 63:  # values give way to their ranks, which need fewer bits
            kinds[i] = np.unique(x)
            columns[i] = np.searchsorted(kinds[i], x)
            widths[i] = len(kinds[i]).bit_length()
    if sum(widths) <= 63:
        key = columns[0].astype(np.int64)
        for x, width in zip(columns[1:], widths[1:], strict=True):
            key = (key << width) | x
        keys, inverse = np.unique(key, return_inverse=True)
        out = []
        for width in widths[:0:-1]:
            out.insert(0, keys & ((1 << width) - 1))
            keys = keys >> width
        return [x if k is None else k[x] for x, k in zip([keys, *out], kinds, strict=True)], inverse
    number = np.zeros(len(columns[0]), np.int64)
    for x in columns:
        number = np.unique((number << 32) | x, return_inverse=True)[1]
    at = np.unique(number, return_index=True)[1]
    return [x[at] if k is None else k[x[at]] for x, k in zip(columns, kinds, strict=True)], number


class Trie:
    """A shard's part of the model: words behind a word (pairs), words before it (before), and words behind two words
    (triples), whose contexts are places of before.

    Probabilities are smoothed where they are written: a count and prior times the lower probability, over the
    context's count and prior. The back-off weight of a context, prior over its count and prior, is the share of the
    lower probability that an unseen successor gets, so all successors add up to one. The prior is a multiple of the
    context's different successors: the more of them were seen, the likelier are others.
    """

    def __init__(self, folder: str) -> None:
        self.pairs, self.before, self.triples = (TrieLevel.open(folder, n) for n in ("pairs", "before", "triples"))

    @staticmethod
    def write(folder: str, c: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, plain: np.ndarray, total: np.ndarray, priors: tuple[float, float, float], bits: int = 8) -> None:
        """Distinct sorted entries (context c, word u before it, word w behind it) with counts; plain: the probability
        of w alone. A context with a total is a frequent one of two words: it has no u, and further successors may be
        in other shards."""
        pair_prior, triple_prior, frequent_prior = priors
        (c2, w2), pair = distinct([c, w])
        kinds, context = np.unique(c2, return_inverse=True)
        n2, p2, given = np.bincount(pair, n, len(c2)), np.zeros(len(c2)), np.zeros(len(kinds))
        p2[pair], given[context[pair]] = plain, total
        totals = np.where(given > 0, given, np.bincount(context, n2, len(kinds)))
        prior = np.where(given > 0, frequent_prior * given, pair_prior * np.bincount(context, minlength=len(kinds)))
        p2 = (n2 + prior[context] * p2) / (totals + prior)[context]
        TrieLevel.write(folder, "pairs", c2, w2, np.log10(p2), np.log10(prior / (totals + prior)), bits)
        k = np.flatnonzero(total == 0)
        (c3, u3), node = distinct([c[k], u[k]])
        totals = np.bincount(node, n[k], len(c3))
        prior = triple_prior * np.bincount(node, minlength=len(c3))
        p3 = (n[k] + prior[node] * p2[pair[k]]) / (totals + prior)[node]
        TrieLevel.write(folder, "before", c3, u3)
        TrieLevel.write(folder, "triples", node, w[k], np.log10(p3), np.log10(prior / (totals + prior)), bits, places=True)

    def look_up(self, c: np.ndarray, u: np.ndarray, w: np.ndarray, plain: np.ndarray, total: np.ndarray, frequent_prior: float) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the triples, 0 where they are unseen; log10 probability of w) of sorted entries as in write; plain:
        the log10 probability of w alone."""
        place, above = self.pairs.find(c, w)
        known, hit = above >= 0, place >= 0
        logs = plain.astype(np.float64)
        logs[known] += self.pairs.weight(above[known])
        far = ~known & (total > 0)
        logs[far] += np.log10(frequent_prior / (1 + frequent_prior))
        logs[hit] = self.pairs.logs(place[hit])
        codes = np.zeros(len(c), np.int64)
        k = np.flatnonzero(total == 0)
        node = self.before.find(c[k], u[k])[0]
        k, node = k[node >= 0], node[node >= 0]
        place = self.triples.find(node, w[k])[0]
        hit = place >= 0
        logs[k[~hit]] += self.triples.weight(node[~hit])
        logs[k[hit]] = self.triples.logs(place[hit])
        codes[k[hit]] = self.triples.codes[place[hit]]
        return codes, logs


def quantise(logs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(book, codes from 1): bins of equal width between the largest and the smallest value, each told by its mean, so
    that no value is off by more than a bin's width. Code 0 is for what is absent."""
    kind = np.uint8 if bits <= 8 else np.uint16
    if not len(logs):
        return np.full(1, -np.inf), np.zeros(0, kind)
    top, last = logs.max(), (1 << bits) - 2
    width = max((top - logs.min()) / last, 1e-12)
    codes = np.minimum(np.rint((top - logs) / width).astype(np.int64), last)
    counts = np.bincount(codes)
    means = np.bincount(codes, logs) / np.maximum(counts, 1)
    return np.concatenate([[-np.inf], means]), (codes + 1).astype(kind)
