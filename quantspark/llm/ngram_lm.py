"""Language-model scores from a trie of one, two and three words with Elias-Fano levels, learned from the whole corpus.

Texts are cut into words once and written as blocks of about a million tokens, words being numbers within their
block. From then on blocks ask and shards answer:

1. Each block tells each shard of the vocabulary how often its words occur in training texts, once a word. The
   shard adds up over all blocks and answers counts and word ids. Ids fall with the count, so the first level of the
   model, the probability of a word alone, is a short table of the ids at which the quantised probability changes.
2. Where two frequent words follow each other, blocks ask how often they do.
3. Each block asks for its distinct triples with their training counts, at the shard of the middle word. The shard
   adds up, writes its part of the trie (contexts, pointers and successors as Elias-Fano sequences, quantised smoothed
   log probabilities and back-off weights), maps the files into memory and answers each triple's log probability.
4. Each block puts the answers at its tokens and sums up the score of each document.

Blocks send a word or triple once however often it occurs, so a word that makes a third of the corpus is a row for each
block. A word seen more than HOT times is a context for each of several buckets of words before it, with an id for
each. Two words seen together more than HOT times are a context of their own, whose successors are spread over the
shards. So every shard holds a bounded number of entries, and the model grows with the corpus by growing in shards.

A triple's probability is (its count + prior x lower) / (its context's count + prior), the lower one being the pair's
by the same rule, and the pair's lower one the add-one probability of the word; priors grow with the number of
different successors of the context. The pair's context is the middle word,
for a word seen more than HOT times within the bucket of the word before it; a context of two words seen more than HOT
times has the word's own probability as lower one. All counts enter, those of one too. Words are known by a 64-bit hash.
"""

from __future__ import annotations

import tempfile
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import Scratch
from quantspark.llm.elias_fano import distinct, quantise

#: Tokens in a block; words, and triples, in a shard, counted once for each block that has them.
BLOCK_TOKENS = 1_500_000
SHARD_WORDS = 2_000_000
SHARD_ENTRIES = 1_500_000
#: A context seen more often is split.
HOT = SHARD_ENTRIES // 8
#: Bits of a quantised probability of pairs and triples, and width of a bin of log10 of words' counts.
CODE_BITS = 8
WORD_BIN = 0.005
#: How many occurrences the lower probability counts for: times the context's different successors, in pairs and in
#: triples, and times the context's count where two words are seen together more than HOT times.
PRIORS = (2.0, 2.0, 0.2)
#: The token behind every text; no word holds a line end. It is also the context of the first word.
END = b"\n"
#: Documents whose crc32 of the id as text leaves HELD_OUT modulo FOLDS are held out.
FOLDS, HELD_OUT = 7, 2

BLOCK_TYPE = "part int, block long, ids array<long>, held binary, lengths binary, tokens binary, words binary, buckets binary, counts binary, n_words long, n_tokens long"
MESSAGE_TYPE = "shard int, block long, payload binary"
ANSWER_TYPE = "block long, kind int, shard int, payload binary, n_train long, n_words long, top long"
SCORE_TYPE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: Kinds of answers: words, totals of frequent pairs, triples, parts of the trie.
WORDS, TOTALS, TRIPLES, TRIE = range(1, 5)


def dump(values: np.ndarray) -> bytes:
    """Non-negative integers in few bytes: the narrowest width, byte planes one after another, zstandard."""
    import zstandard

    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def load(data: bytes) -> np.ndarray:
    import zstandard

    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def encode(columns: list[np.ndarray]) -> list[bytes]:
    """Sorted distinct rows: a column is told by its steps as long as the columns before it stay."""
    new, out = np.zeros(len(columns[0]), bool), []
    new[:1] = True
    for x in columns:
        step = np.concatenate([[0], np.diff(x)])
        out.append(dump(np.where(new, x, step)))
        new = new | (step != 0)
    return out


def decode(parts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    new = None
    for part in parts:
        step = load(part).astype(np.int64)
        if new is None:
            new = np.zeros(len(step), bool)
            new[:1] = True
        start = np.flatnonzero(new)
        sums = np.cumsum(step)
        x = sums - np.repeat(sums[start] - step[start], np.diff(np.append(start, len(step))))
        out.append(x)
        new = new | np.concatenate([[False], x[1:] != x[:-1]])[: len(x)]
    return out


def is_held_out(doc_id: int | None) -> bool:
    """Null ids are not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def make_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, text) to blocks of whole documents: part 0 has the tokens, part 1 the vocabulary, which only the
    first exchange needs. Null texts are empty and still have their end."""
    import xxhash
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32

    def fresh() -> tuple:
        return defaultdict(count().__next__), [], [], [], []

    def block() -> pd.DataFrame:
        nonlocal number
        number += 1
        flat, sizes = np.concatenate(tokens), np.array(lengths)
        kept = np.repeat(~np.array(held), sizes)
        counts = np.bincount(flat[kept], minlength=len(numbers))
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        buckets = (_mix(words) >> np.uint64(32)).astype(np.uint32)
        texts = (0, number, ids, dump(np.array(held, np.uint8)), dump(sizes), dump(flat), None, buckets.tobytes(), None, len(words), len(flat))
        vocabulary = (1, number, None, None, None, None, words.tobytes(), buckets.tobytes(), dump(counts), 0, 0)
        return pd.DataFrame([texts, vocabulary], columns=[c.split()[0] for c in BLOCK_TYPE.split(", ")])

    numbers, ids, held, lengths, tokens = fresh()
    size = 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].astype(object), frame["text"], strict=True):
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            words.append(END)
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            ids.append(doc_id)
            held.append(is_held_out(doc_id))
            lengths.append(len(words))
            tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            size += len(words)
            if size >= BLOCK_TOKENS:
                yield block()
                numbers, ids, held, lengths, tokens = fresh()
                size = 0
    if ids:
        yield block()


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in it by rising place) of every shard that has some."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if bounds[s] < bounds[s + 1]:
            yield s, order[bounds[s] : bounds[s + 1]]


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _word_shards(buckets: bytes, shards: int) -> np.ndarray:
    """Which shard has each word; blocks keep 32 bits of its hash for that."""
    return (np.frombuffer(buckets, np.uint32).astype(np.uint64) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _ask_words(shards: int):
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                words, counts = np.frombuffer(row.words, np.uint64), load(row.counts)
                out = [(s, row.block, words[at].tobytes(), dump(counts[at])) for s, at in _by_shard(_word_shards(row.buckets, shards), shards)]
                yield pd.DataFrame(out, columns=["shard", "block", "words", "counts"])

    return ask


def _answers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER_TYPE.split(", ")])


def _split_into(counts: np.ndarray, hot: int) -> np.ndarray:
    """How many contexts a word of so many occurrences is."""
    return np.maximum(-(-counts // hot), 1)


def _answer_words(shards: int, hot: int):
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        """Counts and ids of the words of one shard, for each block that asked, and the shard's part of the first level.
        Ids are apart between shards."""
        shard = int(frame["shard"].iloc[0])
        asked = [np.frombuffer(w, np.uint64) for w in frame["words"]]
        told = np.concatenate([load(c) for c in frame["counts"]])
        kinds, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(inverse, told, len(kinds)).astype(np.int64)
        # Known words are numbered by falling count, so that frequent ones have small ids; 0 is for unknown words.
        order = np.argsort(-totals, kind="stable")
        parts = _split_into(totals[order], hot)
        first = np.cumsum(parts) - parts
        ids = np.empty(len(kinds), np.int64)
        ids[order] = first * shards + shard + 1
        ids[totals == 0] = 0
        ends = np.cumsum([len(a) for a in asked])
        rows = []
        for block, end, a in zip(frame["block"], ends, asked, strict=True):
            at = inverse[end - len(a) : end]
            rows.append((block, WORDS, shard, join(dump(totals[at]), dump(ids[at])), 0, 0, 0))
        known = int((totals > 0).sum())
        codes = np.rint(np.log10(totals[order][:known] + 1) / WORD_BIN).astype(np.int64)
        turns = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[:known])
        level = join(dump(np.diff(first[turns], prepend=0)), dump(codes[turns]))
        rows.append((-1, WORDS, shard, level, int(totals.sum()), known, int((first + parts)[:known].max(initial=0)) * shards + shard))
        return _answers(rows)

    return answer


@dataclass(frozen=True)
class _Plan:
    word_shards: int
    shards: int
    hot: int
    n_train: int = 0
    n_words: int = 0
    #: The largest id of a word.
    top: int = 0
    #: The first level: (shard, place) at which a code begins, and the codes.
    turns: np.ndarray | None = None
    codes: np.ndarray | None = None

    @property
    def classes(self) -> int:
        return self.n_train + self.n_words + 1

    def plain(self, ids: np.ndarray) -> np.ndarray:
        """Log10 probability of the words alone, by the first level; ids of 0 are unknown words."""
        logs = np.full(len(ids), -np.log10(self.classes))
        known = ids > 0
        x = ids[known] - 1
        at = np.searchsorted(self.turns, (x % self.word_shards << 44) | x // self.word_shards, side="right") - 1
        logs[known] += self.codes[at] * WORD_BIN
        return logs


def _first_level(rows: list, plan: _Plan) -> _Plan:
    """plan with what the word shards say: a few thousand numbers for two million words at most."""
    turns, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in sorted(rows, key=lambda r: r["shard"]):
        steps, told = map(load, split(r["payload"]))
        turns.append((r["shard"] << 44) | np.cumsum(steps.astype(np.int64)))
        codes.append(told.astype(np.int64))
    total = lambda c: sum(r[c] for r in rows)
    return replace(plan, n_train=total("n_train"), n_words=total("n_words"), top=max((r["top"] for r in rows), default=0), turns=np.concatenate(turns), codes=np.concatenate(codes))


class _Asked:
    """The distinct rows of columns at some tokens, sorted, and the shard that answers each."""

    def __init__(self, at: np.ndarray, columns: list[np.ndarray], shard: np.ndarray, shards: int) -> None:
        self.at, self.shards = at, shards
        self.columns, self.inverse = distinct(columns)
        self.shard = np.empty(len(self.columns[0]), np.int64)
        self.shard[self.inverse] = shard  # tokens of one row agree on it

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        return _by_shard(self.shard, self.shards)

    def counts(self, train: np.ndarray) -> np.ndarray:
        return np.bincount(self.inverse, train[self.at], len(self.shard)).astype(np.int64)

    def answers(self, told: pd.DataFrame, kind: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """(rows, parts of the payload) of each shard's answer."""
        told = told[told["kind"] == kind]
        by_shard = dict(zip(told["shard"], told["payload"], strict=True))
        for s, at in self.rows():
            yield at, split(by_shard[s])


class _Block:
    """One block with what the shards have answered so far."""

    def __init__(self, row: pd.Series, told: pd.DataFrame, plan: _Plan) -> None:
        self.row, self.told, self.plan = row, told, plan
        self.ids, self.held = row["ids"], load(row["held"]).astype(bool)
        self.lengths = load(row["lengths"]).astype(np.int64)
        local = load(row["tokens"])
        words = told[told["kind"] == WORDS]
        by_shard = dict(zip(words["shard"], words["payload"], strict=True))
        shards = _word_shards(row["buckets"], plan.word_shards)
        counts, ids = np.zeros(len(shards), np.int64), np.zeros(len(shards), np.int64)
        for s, at in _by_shard(shards, plan.word_shards):
            first, second = split(by_shard[s])
            counts[at], ids[at] = load(first), load(second)
        self.word_counts, self.words = counts[local], ids[local]
        self.starts = np.cumsum(self.lengths) - self.lengths
        end = local[self.lengths[0] - 1]
        self.train = np.repeat(~self.held, self.lengths)
        # A text begins behind two ends. Behind an unknown word, the word alone counts, which needs no shard.
        middle, middle_counts = self.shifted(self.words, ids[end]), self.shifted(self.word_counts, counts[end])
        self.at = np.flatnonzero(middle > 0)
        self.before = self.shifted(middle, ids[end])[self.at]
        before_counts = self.shifted(middle_counts, counts[end])[self.at]
        self.middle, self.middle_counts = middle[self.at], middle_counts[self.at]
        both = np.flatnonzero((self.middle_counts > plan.hot) & (before_counts > plan.hot))
        shard = _mix(_mix(self.before[both]) ^ self.middle[both].astype(np.uint64)) % np.uint64(plan.shards)
        self.pairs = _Asked(both, [self.before[both], self.middle[both]], shard.astype(np.int64), plan.shards)

    def shifted(self, x: np.ndarray, at_start: int) -> np.ndarray:
        """The value of the token before, within the document."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.starts] = at_start
        return out

    def ask_totals(self) -> list[tuple]:
        counts = self.pairs.counts(self.train[self.at])
        return [(s, self.row["block"], join(*encode([x[at] for x in self.pairs.columns]), dump(counts[at]))) for s, at in self.pairs.rows()]

    def read_totals(self) -> None:
        """The triples, each with its context, now that frequent pairs are known."""
        plan, hot = self.plan, np.zeros(len(self.at), np.int64)
        self.totals: dict[int, int] = {}
        ids = np.zeros(len(self.pairs.shard), np.int64)
        for at, (first, second) in self.pairs.answers(self.told, TOTALS):
            ids[at], totals = load(first), load(second)
            self.totals.update(zip(ids[at][totals > 0].tolist(), totals[totals > 0].tolist(), strict=True))
        hot[self.pairs.at] = ids[self.pairs.inverse]
        bucket = _mix(self.before) % _split_into(self.middle_counts, plan.hot).astype(np.uint64)
        context = np.where(hot > 0, hot, self.middle + bucket.astype(np.int64) * plan.word_shards)
        word = self.words[self.at]
        name = _mix(context)
        name[hot > 0] ^= _mix(word[hot > 0] + 1)
        self.triples = _Asked(self.at, [context, np.where(hot > 0, 0, self.before), word], (name % np.uint64(plan.shards)).astype(np.int64), plan.shards)

    def ask_triples(self) -> list[tuple]:
        counts, out = self.triples.counts(self.train), []
        for s, at in self.triples.rows():
            columns = [x[at] for x in self.triples.columns]
            frequent = np.unique(columns[0][columns[0] > self.plan.top])
            totals = np.array([self.totals[c] for c in frequent.tolist()], np.int64)
            out.append((s, self.row["block"], join(*encode(columns), dump(counts[at]), dump(frequent), dump(totals))))
        return out

    def scores(self) -> pd.DataFrame:
        plain = np.log10((self.word_counts + 1) / self.plan.classes)
        told = np.zeros(len(self.triples.shard))
        for at, (book, codes, far_book, far) in self.triples.answers(self.told, TRIPLES):
            codes = load(codes)
            logs = np.frombuffer(book, "<f8")[codes]
            logs[codes == 0] = np.frombuffer(far_book, "<f8")[load(far)]
            told[at] = logs
        logs = plain.copy()
        logs[self.at] = told[self.triples.inverse]
        sums = lambda x: np.add.reduceat(x, self.starts)
        columns = {"doc_id": pd.array([None if x is None or x != x else int(x) for x in self.ids], "Int64"), "held_out": self.held, "n_tokens": self.lengths}
        return pd.DataFrame(columns | {"n_known": sums((self.word_counts > 0).astype(np.int64)), "base_score": sums(plain), "score": sums(logs)})


def _messages(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["shard", "block", "payload"])


def _ask_totals(plan: _Plan):
    def ask(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return _messages([m for _, row in rows.iterrows() for m in _Block(row, told, plan).ask_totals()])

    return ask


def _ask_triples(plan: _Plan):
    def ask(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            block = _Block(row, told, plan)
            block.read_totals()
            out += block.ask_triples()
        return _messages(out)

    return ask


def _score(plan: _Plan):
    def score(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            block = _Block(row, told, plan)
            block.read_totals()
            out.append(block.scores())
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in SCORE_TYPE.split(", ")})

    return score


def _add_up(messages: list[list[bytes]], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[int]]:
    """(columns of the distinct rows of all messages, their counts, number of each row, rows of each message)."""
    decoded = [decode(m[:width]) for m in messages]
    columns, inverse = distinct([np.concatenate(x) for x in zip(*decoded, strict=True)])
    counts = np.bincount(inverse, np.concatenate([load(m[width]) for m in messages]), len(columns[0])).astype(np.int64)
    return columns, counts, inverse, [len(d[0]) for d in decoded]


def _answer_totals(plan: _Plan):
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        """For each pair of frequent words its id as a context and its count, 0 unless it is frequent itself."""
        shard = int(frame["shard"].iloc[0])
        _, counts, inverse, sizes = _add_up([split(p) for p in frame["payload"]], 2)
        hot = counts > plan.hot
        ids = np.where(hot, plan.top + 1 + (np.cumsum(hot) - 1) * plan.shards + shard, 0)
        counts = np.where(hot, counts, 0)
        rows = []
        for block, at in zip(frame["block"], np.split(inverse, np.cumsum(sizes)[:-1]), strict=True):
            rows.append((block, TOTALS, shard, join(dump(ids[at]), dump(counts[at])), 0, 0, 0))
        return _answers(rows)

    return answer


def _answer_triples(plan: _Plan, keep_trie: bool):
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        """Builds one shard's part of the trie from all counts and answers every block from the mapped files."""
        from quantspark.llm.elias_fano import Trie

        shard, rows = int(frame["shard"].iloc[0]), []
        messages = [split(p) for p in frame["payload"]]
        (c, u, w), counts, inverse, sizes = _add_up(messages, 3)
        plain = plan.plain(w)
        total = np.zeros(len(c), np.int64)
        frequent, at = np.unique(np.concatenate([load(m[4]).astype(np.int64) for m in messages]), return_index=True)
        if len(frequent):
            totals = np.concatenate([load(m[5]) for m in messages])[at]
            behind = c > plan.top
            total[behind] = totals[np.searchsorted(frequent, c[behind])]
        seen = counts > 0
        with tempfile.TemporaryDirectory() as folder:
            Trie.write(folder, c[seen], u[seen], w[seen], counts[seen], 10.0 ** plain[seen], total[seen], PRIORS, CODE_BITS)
            trie = Trie(folder)
            codes, logs = trie.look_up(c, u, w, plain, total, PRIORS[2])
            book = np.asarray(trie.triples.book, "<f8").tobytes()
            if keep_trie:
                rows.append((-2, TRIE, shard, _archive(folder), 0, 0, 0))
            del trie
        far = np.zeros(len(c), np.int64)
        far_book, far[codes == 0] = quantise(logs[codes == 0], CODE_BITS)
        far_book = np.asarray(far_book, "<f8").tobytes()
        for block, at in zip(frame["block"], np.split(inverse, np.cumsum(sizes)[:-1]), strict=True):
            told = codes[at]
            rows.append((block, TRIPLES, shard, join(book, dump(told), far_book, dump(far[at][told == 0])), 0, 0, 0))
        return _answers(rows)

    return answer


def _archive(folder: str) -> bytes:
    import io
    import os
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in sorted(os.listdir(folder)):
            z.write(os.path.join(folder, name), name)
    return out.getvalue()


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_trie: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(scores, trie): one row per document, and the trie's parts by shard if asked for.

    Scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null texts are empty and still have
    their end; null ids are in training; repeated rows are learned from and scored each for itself; texts of any length
    are scored whole; an empty table gives an empty result. Ids are integers.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = scratch.save(texts.mapInPandas(make_blocks, BLOCK_TYPE), "blocks", by=("part",))
    size = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    plan = _Plan(max(1, -(-(size["words"] or 0) // SHARD_WORDS)), max(1, -(-(size["tokens"] or 0) // SHARD_ENTRIES)), HOT)

    asked = blocks.where("part = 1").select("block", "words", "buckets", "counts").mapInPandas(_ask_words(plan.word_shards), "shard int, block long, words binary, counts binary")
    words = scratch.save(asked.groupBy("shard").applyInPandas(_answer_words(plan.word_shards, plan.hot), ANSWER_TYPE), "words")
    plan = _first_level(words.where("block = -1").collect(), plan)

    scratch.drop("blocks/part=1")
    rows = blocks.where("part = 0").select("block", "ids", "held", "lengths", "tokens", "buckets")
    told = words.where("block >= 0")
    beside = lambda answers: rows.groupBy("block").cogroup(answers.groupBy("block"))
    totals = scratch.save(beside(told).applyInPandas(_ask_totals(plan), MESSAGE_TYPE).groupBy("shard").applyInPandas(_answer_totals(plan), ANSWER_TYPE), "totals")
    told = told.unionByName(totals)
    triples = scratch.save(beside(told).applyInPandas(_ask_triples(plan), MESSAGE_TYPE).groupBy("shard").applyInPandas(_answer_triples(plan, keep_trie), ANSWER_TYPE), "triples")
    told = told.unionByName(triples.where("block >= 0"))
    scores = beside(told).applyInPandas(_score(plan), SCORE_TYPE)
    scores = scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(plan.n_train).cast("long").alias("train_tokens"), "base_score", "score")
    if not keep_trie:
        return scores, None
    return scores, triples.where(F.col("kind") == TRIE).select("shard", F.col("payload").alias("trie"))
