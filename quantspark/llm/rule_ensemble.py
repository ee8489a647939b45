"""Quality classifier as a sparse ensemble of rules.

Shallow random trees over the statistics of labelled texts are cut into their paths: every path from the root to a node
is a conjunction of thresholds, that is, a rule. A lasso logistic regression over the rules (0 or 1 for each text) leaves
few of them with a weight. The ensemble becomes one Spark column: the logistic function of the bias and the weights of
the rules that hold. Trees and weights are fitted by Spark over all labelled rows; the driver sees the model alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import Scratch
from quantspark.llm.decision_list import FEATURES, Condition, feature, with_stats

FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3
TREES = 24
DEPTH = 3
#: Weight of the lasso penalty, and the share of rows that a rule covers and leaves uncovered at least.
PENALTY = 0.0005
MIN_SUPPORT = 0.002
SEED = 11
#: Labelled rows that learning takes, about: beyond that, those of the smallest hash of their id, by a threshold on it.
MAX_TRAIN = 200_000
HASHES = 1 << 30


@dataclass(frozen=True)
class WeightedRule:
    conditions: tuple[Condition, ...]
    weight: float

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(stats)
        return out

    def __str__(self) -> str:
        return f"{self.weight:+.4f} if {' and '.join(map(str, self.conditions))}"


@dataclass(frozen=True)
class Ensemble:
    """score = 1 / (1 + exp(-(bias + weights of the rules that hold)))"""

    bias: float
    rules: tuple[WeightedRule, ...] = ()

    def column(self, stats: Column) -> Column:
        total = F.lit(self.bias)
        for r in self.rules:
            total = total + F.when(r.column(stats), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(id_: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Rows that learning never sees, by the CRC of the id as text. Null ids are not held out; they have no label."""
    return F.coalesce(F.crc32(id_.cast("string")) % folds == fold, F.lit(False))


def _narrowed(conditions: Sequence[Condition]) -> tuple[Condition, ...]:
    """One lower and one upper threshold a feature, the tightest of the path, in the order of names."""
    tight: dict[tuple[str, bool], float] = {}
    for c in conditions:
        key = (c.feature, c.above)
        best = max if c.above else min
        tight[key] = best(tight.get(key, c.threshold), c.threshold)
    return tuple(Condition(f, above, t) for (f, above), t in sorted(tight.items()))


def tree_rules(root, names: Sequence[str]) -> list[tuple[Condition, ...]]:
    """The conjunctions of all paths of a fitted tree, to inner nodes and leaves alike."""
    out: list[tuple[Condition, ...]] = []
    open_ = [(root, ())]
    while open_:
        node, path = open_.pop()
        if path:
            out.append(_narrowed(path))
        if node.subtreeDepth() > 0:
            split = node.split()
            name, at = names[split.featureIndex()], float(np.nextafter(split.threshold(), np.inf))
            # The tree sends values up to the threshold left, conditions ask for values below theirs.
            open_.append((node.leftChild(), (*path, Condition(name, False, at))))
            open_.append((node.rightChild(), (*path, Condition(name, True, at))))
    return out


def _forest_rules(train: DataFrame, names: Sequence[str], trees: int, depth: int) -> list[tuple[Condition, ...]]:
    # Trees differ by the statistics that their nodes may split on. Rows are not drawn, so no partitioning changes the trees.
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird", maxBins=64, minInstancesPerNode=5, bootstrap=False)
    model = forest.fit(train.select("label", array_to_vector(F.array(*names)).alias("features")))
    found = {rule for tree in model.trees for rule in tree_rules(tree._call_java("rootNode"), names)}
    return sorted(found, key=lambda rule: [(c.feature, c.above, c.threshold) for c in rule])


def _hit(rule: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & ((F.col(c.feature) >= c.threshold) if c.above else (F.col(c.feature) < c.threshold))
    return F.when(out, 1.0).otherwise(0.0)


def learn_ensemble(train: DataFrame, names: Sequence[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """The ensemble for rows (label 0.0 or 1.0, and a double column for each name).

    Without rows the score is 0.5; where all labels are equal, or no statistic parts them, it is the smoothed share of
    label 1.
    """
    seen = train.agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    prior = (seen["ones"] + 1) / (seen["n"] + 2)
    flat = Ensemble(float(np.log(prior / (1 - prior))))
    if seen["ones"] in (0.0, float(seen["n"])):
        return flat
    rules = _forest_rules(train, names, trees, depth)
    if not rules:
        return flat
    shares = train.agg(Summarizer.mean(array_to_vector(F.array(*[_hit(r) for r in rules]))).alias("shares")).first()["shares"]
    rules = [r for r, s in zip(rules, shares, strict=True) if MIN_SUPPORT <= s <= 1 - MIN_SUPPORT]
    if not rules:
        return flat
    matrix = train.select("label", array_to_vector(F.array(*[_hit(r) for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=200, tol=1e-8, standardization=True).fit(matrix)
    weighted = [WeightedRule(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w != 0.0]
    return Ensemble(float(lasso.intercept), tuple(weighted))


def labelled_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_TRAIN) -> DataFrame:
    """(label, features) of labelled rows that are not held out, all of them or, by a threshold on the hash of the id,
    about max_rows. An id labelled twice counts with its lowest label; labels other than 0 and 1, and null ids, are left
    out."""
    judged = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    judged = judged.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("label"))
    rows = stats.join(judged, "id")
    many = rows.count()
    if many > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(HASHES)) < HASHES * max_rows // many)
    return rows.select("label", *[feature(n, F.col("stats")).alias(n) for n in FEATURES])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, Ensemble]:
    """(id, stats, held_out, score) for every document, and the ensemble. Texts are read once, into a written table of
    counts; learning and scoring read the counts."""
    scratch = Scratch(docs.sparkSession, "ensemble")
    counted = with_stats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", F.col("__stats").alias("stats"))
    stats = scratch.save(counted, "stats")
    train = scratch.save(labelled_rows(stats, labels, id_col, label_col), "train")
    ensemble = learn_ensemble(train, list(FEATURES))
    return stats.select("id", "stats", held_out(F.col("id")).alias("held_out"), ensemble.column(F.col("stats")).alias("score")), ensemble


def classifier_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The inputs of a score are statistics of the text alone. Null, empty and blank texts have counts of zero and a score
    like any other. Null ids and repeated rows keep a row each; texts of any length are counted whole. Without labels
    the score is 0.5, with equal ones it is their smoothed share. Other columns are not read; an empty table gives an
    empty result.
    """
    rows, _ = score_quality(docs, labels)
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

