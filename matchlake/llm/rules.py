"""Quality classifier: a sparse ensemble of rules over text statistics.

Small regression trees are boosted on a bounded sample of labelled rows. Every path from a
root to a node is a conjunction of bounds on statistics, that is a rule. Logistic
regression with an L1 penalty weighs the rules and drops most of them; what remains is
compiled into one Spark column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, thinned

#: Labelled rows that the rules are fitted on, about; more are thinned by a hash of the id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
LEAST_LEAF = 10
PENALTY, STEPS = 0.0015, 1500
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts; null and empty texts have none of anything."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.split(text, " "), F.split(text, "\n")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars
    return {
        "chars": F.length(text).cast("double"),
        "word_length": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "words_per_line": n_words / n_lines,
        "upper": share("[A-Z]+"),
        "digits": share("[0-9]+"),
        "stops": share("[.,]+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,]+"),
    }


#: The statistics, in the order in which trees try them.
NAMES = (
    "chars", "word_length", "distinct_words", "distinct_lines", "words_per_line", "upper", "digits", "stops", "symbols",
)


@dataclass(frozen=True)
class Bound:
    """A statistic at most, or above, a value."""

    name: str
    value: float
    above: bool

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return (table[self.name] > self.value) == self.above

    def column(self, row: Column | None = None) -> Column:
        value = F.col(self.name) if row is None else row[self.name]
        return value > self.value if self.above else value <= self.value


Rule = frozenset  # of Bound


@dataclass
class RuleModel:
    """Weighted rules; the score is the logistic function of their sum."""

    bias: float
    weights: dict[Rule, float]

    def column(self, row: Column | None = None) -> Column:
        """Score over columns named as the statistics, or over the fields of ``row``."""
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            condition = None
            for bound in sorted(rule, key=lambda b: (b.name, b.above, b.value)):
                condition = bound.column(row) if condition is None else condition & bound.column(row)
            total = total + F.when(condition, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _tree_rules(table: dict[str, np.ndarray], edges: dict[str, np.ndarray], bins: dict[str, np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> tuple[set[Rule], np.ndarray]:
    """Paths of one tree fitted to the gradient, and the tree's step for each row."""
    rules: set[Rule] = set()
    step = np.zeros(len(gradient))

    def grow(rows: np.ndarray, path: frozenset, depth: int) -> None:
        if path:
            rules.add(path)
        total_g, total_w = gradient[rows].sum(), weight[rows].sum()
        best = (1e-6, None, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            for name, cuts in edges.items():
                size = len(cuts) + 1
                g = np.bincount(bins[name][rows], gradient[rows], size).cumsum()[:-1]
                w = np.bincount(bins[name][rows], weight[rows], size).cumsum()[:-1]
                n = np.bincount(bins[name][rows], minlength=size).cumsum()[:-1]
                gain = g**2 / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g**2 / (total_w + 1)
                gain[(n < LEAST_LEAF) | (n > len(rows) - LEAST_LEAF)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), name, int(gain.argmax()))
        if best[1] is None:
            step[rows] = total_g / (total_w + 1)
            return
        name, cut = best[1], best[2]
        low = bins[name][rows] <= cut
        value = float(edges[name][cut])
        grow(rows[low], path | {Bound(name, value, False)}, depth + 1)
        grow(rows[~low], path | {Bound(name, value, True)}, depth + 1)

    grow(np.arange(len(gradient)), frozenset(), 0)
    return rules, step


def _lasso(features: np.ndarray, labels: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty on all but the bias, by accelerated proximal steps."""
    rows, columns = features.shape
    design = np.hstack([features, np.ones((rows, 1))])
    vector = np.ones(columns + 1)
    for _ in range(30):
        vector = design.T @ (design @ vector)
        vector /= np.linalg.norm(vector)
    rate = 4 * rows / max(float(np.linalg.norm(design @ vector) ** 2), 1e-9)
    weights = ahead = np.zeros(columns + 1)
    momentum = 1.0
    for _ in range(STEPS):
        slope = design.T @ (1 / (1 + np.exp(-(design @ ahead))) - labels) / rows
        moved = ahead - rate * slope
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - rate * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = moved + (momentum - 1) / following * (moved - weights)
        weights, momentum = moved, following
    return float(weights[-1]), weights[:-1]


def fit(table: dict[str, np.ndarray], labels: np.ndarray) -> RuleModel:
    """Rules for labels 0 and 1; with one class, or too few rows for any rule, a constant."""
    positive, rows = float(labels.sum()), len(labels)
    prior = np.log((positive + 1) / (rows - positive + 1))
    if positive in (0, rows):
        return RuleModel(float(prior), {})
    edges, bins = {}, {}
    for name in NAMES:
        edges[name] = np.unique(np.quantile(table[name], np.linspace(0, 1, BINS + 1)[1:-1]))
        bins[name] = np.searchsorted(edges[name], table[name], side="left")
    rules: dict[Rule, None] = {}
    margin = np.full(rows, prior)
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        found, step = _tree_rules(table, edges, bins, labels - chance, chance * (1 - chance))
        rules |= dict.fromkeys(sorted(found, key=lambda r: sorted((b.name, b.value, b.above) for b in r)))
        margin = margin + RATE * np.clip(step, -8, 8)
    names = list(rules)
    if not names:
        return RuleModel(float(prior), {})
    features = np.stack([np.logical_and.reduce([b.holds(table) for b in rule]) for rule in names], axis=1)
    bias, weights = _lasso(features.astype(float), labels, PENALTY)
    return RuleModel(bias, {r: float(w) for r, w in zip(names, weights, strict=True) if w})


def _sample(stats: DataFrame, labels: DataFrame, most: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and labels of training rows, thinned to about ``most``."""
    marks = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(4))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("quality").cast("int")).alias("quality"))
    )
    marks = marks.where("quality IN (0, 1)")
    share = min(1.0, most / max(1, marks.count()))
    rows = stats.join(marks.where(thinned("doc_id", share)), "doc_id").select("quality", *NAMES).toPandas()
    rows = rows.sort_values(["quality", *NAMES], kind="stable")
    return {n: rows[n].to_numpy(float) for n in NAMES}, rows["quality"].to_numpy(float)


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Rules fitted on labelled rows of ``documents`` outside the held-out ones."""
    stats = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    return fit(*_sample(stats, labels, sample_rows))


def quality(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``documents``.

    ``labels`` has ``doc_id`` and ``quality`` 0 or 1; rows with a null in either are
    passed over, and of several labels of one id the largest counts. Rows whose crc32 of
    the id leaves 2 by 4 are never learned from. Texts that are null or empty, repeated
    rows and rows without an id are scored like others; no other column is read. Without
    labels of both kinds every score is the smoothed share of label 1 (0.5 with none).
    """
    scratch = Scratch(documents.sparkSession, "quality")
    text = statistics(F.col("text"))
    stats = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *[c.alias(n) for n, c in text.items()]
    )
    stats = scratch.write(stats, "statistics")
    model = fit(*_sample(stats, labels, sample_rows))
    scored = stats.select("doc_id", held_out(4).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents predicted to be of quality 1, with their columns."""
    model = train(documents, labels, sample_rows)
    text = statistics(F.col("`text`"))
    # Bound to a lambda's variable, each statistic is computed once wherever the filter is put.
    scores = F.transform(F.array(F.struct(*[c.alias(n) for n, c in text.items()])), model.column)
    return documents.where(F.element_at(scores, 1) >= THRESHOLD)
