"""Quality rules: a decision list learned by sequential covering and emitted as Spark conditional expressions.

Statistics of each text come from one Arrow-batched pass. Rules are conjunctions of thresholds on statistics. Each
rule is grown on one part of the labelled rows, condition by condition, while it covers fewer good texts, then
pruned on the other part from its end. Rules that stay precise enough go on the list, the texts they cover leave the
learning set, and the search starts again. The list becomes an ordered CASE expression: the first rule that fits
rejects, a text that none fits is kept.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import free_name

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
ENDS = b"!?"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_ends", "n_long_words")
STATS_TYPE = ", ".join(f"{c} long" for c in COUNTS)
#: Labelled rows that learning takes at most, by smallest hash of their id.
MAX_TRAIN = 20_000


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which occurs at least twice, its first occurrence included.

    Windows are compared exactly: ranks of single words are joined to ranks of 2, 4 and 8 words.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    width = 1
    while width < window:
        top = int(ranks.max()) + 1
        ranks = ranks[:-width] * top + ranks[width:]
        _, ranks, counts = np.unique(ranks, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        width *= 2
    starts = np.flatnonzero(counts[ranks] > 1)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS; null texts have none of anything."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - without(SPACES),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        without(UPPER),
        without(DIGITS),
        without(ENDS),
        sum(1 for w in words if len(w) > 24),
    )


def _stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_stats(x) for x in batch], columns=list(COUNTS), dtype="int64")


def with_stats(docs: DataFrame, text_col: str = "text", out_col: str = "__stats") -> DataFrame:
    """docs with a struct of counts; other columns keep their names and values."""
    return docs.withColumn(out_col, F.pandas_udf(_stats, STATS_TYPE)(F.col(text_col)))


#: Features by name: (numerator, denominator), a denominator of 0 counting as 1. All are shares or means: counts, and
#: shares that fall with length alone such as distinct words, would judge good long texts by their length.
FEATURES: dict[str, tuple[str, str]] = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeat_per_word": ("n_repeat_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "ends_per_word": ("n_ends", "n_words"),
    "long_per_word": ("n_long_words", "n_words"),
}


def feature(name: str, stats: Column) -> Column:
    top, bottom = FEATURES[name]
    return stats[top].cast("double") / F.greatest(stats[bottom].cast("double"), F.lit(1.0))


def base_failed(stats: Column) -> Column:
    """Too short, or too much of it said again."""
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        return (operator.ge if self.above else operator.lt)(feature(self.feature, stats), F.lit(self.threshold))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(stats)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _covers(conditions: Sequence[Condition], x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in conditions:
        v = x[:, names.index(c.feature)]
        hit &= v >= c.threshold if c.above else v < c.threshold
    return hit


def _best_condition(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Condition | None:
    """The threshold with the largest information gain for the covered bad rows, among midpoints of all values."""
    p0, n0 = bad.sum(), (~bad).sum()
    if not p0 or not n0:
        return None
    base, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v = x[order, j]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below = np.cumsum(bad[order])[cuts - 1]
        for above in (True, False):
            p = (p0 - below if above else below).astype(float)
            n = (len(v) - cuts if above else cuts) - p
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-12) / np.maximum(p + n, 1)) - base), 0.0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], Condition(name, above, float((v[cuts[k]] + v[cuts[k] - 1]) / 2))
    return found


def learn_rules(x: np.ndarray, bad: np.ndarray, names: Sequence[str], min_precision: float = 0.95, min_cover: int = 8, max_conditions: int = 4, max_rules: int = 20) -> list[Rule]:
    """The list in the order in which rules were found. Deterministic; no bad or no good rows give an empty list."""
    grow = np.arange(len(x)) % 3 != 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules and bad[left & grow].sum() >= min_cover:
        g, held = np.flatnonzero(left & grow), np.flatnonzero(left & ~grow)
        conditions: list[Condition] = []
        inside = g
        while len(conditions) < max_conditions and (c := _best_condition(x[inside], bad[inside], names)):
            conditions.append(c)
            inside = g[_covers(conditions, x[g], names)]
        worth = lambda cs: (2 * bad[h].sum() - len(h)) / max(len(h), 1) if len(h := held[_covers(cs, x[held], names)]) else -1.0
        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        hit = left & _covers(conditions, x, names) if conditions else np.zeros(len(x), bool)
        out = hit & ~grow
        precise = lambda rows: (bad[rows].sum() + 1) / (rows.sum() + 2)
        # The bound loosens with the rows at hand, so that few held rows do not rule a pure rule out.
        if hit.sum() < min_cover or bad[hit].mean() < min_precision or (out.sum() and bad[out].mean() < min_precision):
            break
        rules.append(Rule(tuple(conditions), float(precise(hit)), int(hit.sum())))
        left &= ~hit
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN) -> pd.DataFrame:
    """Features and label of at most max_rows labelled texts, those of the smallest hash of id and text.

    Null ids and labels are left out. An id labelled twice counts with its lowest label.
    """
    judged = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    # Choose the ids before touching texts: only the chosen texts are read into Python.
    chosen = judged.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # At most max_rows ids and labels: a size that is safe to broadcast, so that no text is shuffled.
    rows = with_stats(texts.join(F.broadcast(chosen), "__id"), "__text").select("__id", "__label", "__stats")
    rows = rows.select("__id", "__label", *[feature(n, F.col("__stats")).alias(n) for n in FEATURES])
    return rows.orderBy(F.xxhash64("__id"), *FEATURES).limit(max_rows).toPandas()


def fit(docs: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """Learns the list for texts whose label is 0."""
    rows = training_rows(docs, labels, **options)
    names = list(FEATURES)
    return learn_rules(rows[names].to_numpy(float), (rows["__label"] == 0).to_numpy(), names) if len(rows) else []


def rejected_by(rules: Sequence[Rule], stats: Column) -> Column:
    """The number of the first rule that fits, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(stats), F.lit(i)).otherwise(out)
    return out


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, and the rule that rejects.

    Null, empty and blank texts have no words and fail the base limits. Null ids and repeated rows keep a row each, texts
    of any length are counted whole. An empty table gives an empty result; without labels there are no rules.
    """
    rules = fit(docs, labels)
    rows = with_stats(docs.select("doc_id", "text"))
    stats = F.col("__stats")
    rule = rejected_by(rules, stats)
    return rows.select(
        "doc_id",
        *[stats[c].alias(c) for c in COUNTS[:5]],
        base_failed(stats).alias("base_failed"),
        (~base_failed(stats) & rule.isNull()).alias("kept"),
        rule.alias("rule"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the base limits or the learned list reject; their columns and null ids stay."""
    rules = fit(docs, labels, id_col=id_col, text_col=text_col)
    name = free_name(docs, "__stats")
    stats = F.col(name)
    kept = with_stats(docs, text_col, name).where(~base_failed(stats) & rejected_by(rules, stats).isNull())
    return kept.select(*docs.columns)
