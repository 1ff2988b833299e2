"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Small trees are grown by boosting; every path from a root to a node is a conjunctive rule. A logistic model with a lasso
penalty weighs the rules, most get no weight, and the rest are compiled to one Spark column expression. Trees and weights are
fitted on a bounded sample of labelled rows; counting and scoring run on all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.llm.risk_rules import ratio
from kerbline.llm.statistics import counts_of, labelled
from kerbline.llm.texts import held_out

#: Labelled rows to learn from at most: those with the smallest hash of the id.
LEARN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LASSO, STEPS = 24, 3, 32, 0.3, 0.002, 400


def features() -> dict[str, Column]:
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbols": ratio("n_symbols", "n_words"),
        "duplicate_lines": ratio("n_dup_lines", "n_lines"),
        "repeated_words": ratio("n_repeat_words", "n_words"),
        "different_words": ratio("n_unique_words", "n_words"),
        "line_words": ratio("n_words", "n_lines"),
        "capitals": ratio("n_capitals", "word_chars"),
        "digits": ratio("n_digits", "word_chars"),
        "marks": ratio("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.bound if self.above else values[self.feature] <= self.bound

    def column(self) -> Column:
        return F.col(self.feature) > self.bound if self.above else F.col(self.feature) <= self.bound


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Ensemble:
    base: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score, over columns named as the features."""
        total = F.lit(self.base)
        for rule, weight in self.weights:
            total = total + F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def grow_rules(values: dict[str, np.ndarray], label: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each path once."""
    names = list(values)
    edges = {n: np.unique(np.quantile(values[n], np.linspace(0, 1, BINS + 1)[1:-1])) for n in names}
    place = {n: np.searchsorted(edges[n], values[n]) for n in names}  # value <= edges[k] just where place <= k
    total, rules = np.zeros(len(label)), {}
    for tree in range(TREES):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = label - chance, chance * (1 - chance) + 1e-6
        # Every tree sees other features, so that one strong feature does not make all the rules.
        offered = names if tree == 0 else list(np.random.default_rng(tree).choice(names, max(2, len(names) * 2 // 3), False))
        nodes = [((), np.ones(len(label), bool))]
        for _ in range(DEPTH):
            below = []
            for path, rows in nodes:
                best = (1e-3, None)
                for n in offered:
                    if not len(edges[n]):
                        continue
                    g = np.bincount(place[n][rows], slope[rows], len(edges[n]) + 1).cumsum()
                    h = np.bincount(place[n][rows], bend[rows], len(edges[n]) + 1).cumsum()
                    gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                    best = max(best, (float(gain.max()), (n, int(gain.argmax()))), key=lambda b: b[0])
                if best[1] is None:
                    continue
                n, k = best[1]
                for above in (False, True):
                    part = rows & ((place[n] > k) == above)
                    if part.any():
                        rule = (*path, Condition(n, above, float(edges[n][k])))
                        rules[rule] = None
                        below.append((rule, part))
            nodes = below or nodes
        for _, rows in nodes:
            total[rows] += RATE * slope[rows].sum() / (bend[rows].sum() + 1)
    return list(rules)


def lasso_logistic(matrix: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal steps."""
    n, width = matrix.shape
    share = min(max(label.mean(), 1e-3), 1 - 1e-3)
    base, weights = float(np.log(share / (1 - share))), np.zeros(width)
    step = 4 / max(1e-9, (matrix ** 2).sum(1).max() + 1)
    ahead, ahead_base, momentum = weights, base, 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(matrix @ ahead + ahead_base))) - label
        moved = ahead - step * (matrix.T @ error) / n
        new, new_base = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0), ahead_base - step * error.mean()
        next_momentum = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        pull = (momentum - 1) / next_momentum
        ahead, ahead_base = new + pull * (new - weights), new_base + pull * (new_base - base)
        weights, base, momentum = new, float(new_base), next_momentum
    return base, weights


def fit(values: dict[str, np.ndarray], label: np.ndarray) -> Ensemble:
    """The ensemble of a sample; without both labels in it, the share of label 1 (0.5 if there is none) for every text."""
    if not len(label) or label.min() == label.max():
        share = (label.sum() + 0.5) / (len(label) + 1)
        return Ensemble(float(np.log(share / (1 - share))), ())
    rules = grow_rules(values, label)
    matrix = np.column_stack([reduce(np.logical_and, (c.holds(values) for c in r)) for r in rules]).astype(np.float64)
    base, weights = lasso_logistic(matrix, label)
    return Ensemble(base, tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def measured(docs: DataFrame, *carried: str, text: str = "text") -> DataFrame:
    """The carried columns and the features of each row's text."""
    counted = docs.select(*(F.col(c) for c in carried), counts_of(F.col(text)).alias("counts"))
    return counted.select(*carried, "counts.*").select(*carried, *(c.alias(n) for n, c in features().items()))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = LEARN_ROWS) -> Ensemble:
    """Fitted on the labelled rows outside the held-out fold, at most ``rows`` of them, chosen by the hash of the id."""
    sample = labelled(labels, "quality", key).where(~held_out(key)).orderBy(F.xxhash64(key), key).limit(rows)
    # At most ``rows`` ids and labels are broadcast, and one text of each id is measured.
    graded = measured(docs.select(key, text).join(F.broadcast(sample), key), key, "label", text=text)
    least = graded.groupBy(key).agg(F.min(F.struct(*features(), "label")).alias("row")).select(key, "row.*")
    pairs = least.toPandas().sort_values(key)
    return fit({n: pairs[n].to_numpy(float) for n in features()}, pairs["label"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: key, held_out, score and predicted (1 from the threshold on).

    Null and empty texts have features of 0 and are scored by them. Repeated rows and null keys are scored like others.
    """
    score = learn(docs, labels, key, text).column()
    return measured(docs, key, text=text).select(key, held_out(key).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is predicted good."""
    score = learn(docs, labels, key, text).column()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    return measured(whole, "row").where(score >= threshold).select("row.*")
