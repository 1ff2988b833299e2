"""Toxicity: a learnt lexicon matched with misspellings, hits weighed by their context.

Terms are words and word beginnings that labelled toxic documents hold far more often than others. They form tries; the
Levenshtein automata of all terms, intersected with the tries, are made deterministic as words are read, so that a
word costs one look-up per letter. Words of five letters may differ by one edit, words of nine by two; shorter words and
beginnings must be exact. A hit between quotation marks or near reporting words counts as quotation, else as abuse, and a
logistic model weighs the sums.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kerbline.llm.statistics import labelled
from kerbline.llm.texts import held_out, map_rows

#: Labelled documents to learn from at most: those with the smallest hash of the id.
LEARN_ROWS = 20_000
#: A term's least number of toxic documents, log-likelihood ratio against chance, and share of toxic among its documents.
LEAST_DOCUMENTS, LEAST_RATIO, LEAST_SHARE = 4, 20.0, 0.6
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"\w+")
WINDOW = 6
#: Fixed words that report another's words.
REPORTING = frozenset("said says called calls wrote writes quote quoted quoting word words term terms insult insults slur slurs "
                      "according phrase".split())
MARKS = re.compile("[\"“”«»„]")
#: Remembered words and automaton transitions before a task starts anew, and the longest word that is remembered; these
#: bound memory, never results.
CACHE_ENTRIES, LONGEST_REMEMBERED = 400_000, 64


def edits(length: int) -> int:
    return 2 if length >= 9 else 1 if length >= 5 else 0


def terms_of(text: str | None) -> set[str]:
    """The words of a text, and the beginnings of longer words, marked by a star."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class Lexicon:
    """Terms as tries, and the automaton over them."""

    terms: tuple[str, ...]
    _children: list[dict[str, int]] = field(default_factory=list)
    _word: set[int] = field(default_factory=set)
    _beginning: set[int] = field(default_factory=set)
    _budget: list[int] = field(default_factory=list)

    def __post_init__(self):
        self._children, self._word, self._beginning, self._budget = [], set(), set(), []
        roots: dict[int, int] = {}
        for term in self.terms:
            letters = term.rstrip("*")
            budget = 0 if term.endswith("*") else edits(len(letters))
            node = roots.setdefault(budget, len(self._children))
            if node == len(self._children):
                self._add(budget)
            for letter in letters:
                if letter not in self._children[node]:
                    self._children[node][letter] = self._add(budget)
                node = self._children[node][letter]
            (self._beginning if term.endswith("*") else self._word).add(node)
        self._start = self._close({root: 0 for root in roots.values()})
        self._reset()

    def _add(self, budget: int) -> int:
        self._children.append({})
        self._budget.append(budget)
        return len(self._children) - 1

    def _reset(self) -> None:
        self._states, self._moves, self._known = {}, [], {}
        self._state(self._start)

    def _close(self, items: dict[int, int]) -> frozenset:
        """With the places reached by leaving out letters of a term; of each place the fewest edits."""
        least = dict(items)
        todo = list(items.items())
        while todo:
            node, used = todo.pop()
            if used < self._budget[node]:
                for child in self._children[node].values():
                    if least.get(child, 9) > used + 1:
                        least[child] = used + 1
                        todo.append((child, used + 1))
        return frozenset(least.items())

    def _state(self, items: frozenset) -> int:
        if items not in self._states:
            self._states[items] = len(self._moves)
            self._moves.append({})
        return self._states[items]

    def _step(self, items: frozenset, letter: str) -> frozenset:
        least: dict[int, int] = {}

        def reach(node: int, used: int) -> None:
            if least.get(node, 9) > used:
                least[node] = used

        for node, used in items:
            if node in self._beginning:
                reach(node, used)
            if letter in self._children[node]:
                reach(self._children[node][letter], used)
            if used < self._budget[node]:
                reach(node, used + 1)
                for child in self._children[node].values():
                    reach(child, used + 1)
        return self._close(least)

    def match(self, word: str) -> int | None:
        """The fewest edits to a term, within the term's budget; None if there is no such term."""
        if word in self._known:
            return self._known[word]
        if len(self._known) > CACHE_ENTRIES or len(self._moves) > CACHE_ENTRIES // 8:
            self._reset()
        state, items = 0, self._start
        for letter in word:
            move = self._moves[state].get(letter)
            if move is None:
                target = self._step(items, letter)
                move = self._moves[state][letter] = (self._state(target), target)
            state, items = move
            if not items:
                break
        found = min((used for node, used in items if node in self._word or node in self._beginning), default=None)
        if len(word) <= LONGEST_REMEMBERED:
            self._known[word] = found
        return found

    def hits(self, words: set[str]) -> dict[str, int]:
        """Of the words those that match, with their edits."""
        return {w: e for w in words if (e := self.match(w)) is not None}


def quoted(text: str, start: int) -> bool:
    """Whether an odd number of quotation marks comes before a place in its line."""
    return len(MARKS.findall(text, text.rfind("\n", 0, start) + 1, start)) % 2 == 1


def features(text: str | None, lexicon: Lexicon) -> tuple[float, ...]:
    """Sums over the hits: exact and misspelt abuse, exact and misspelt quotation, different terms, hits per 100 words."""
    lowered = text.lower() if text else ""
    found = lexicon.hits(set(WORD.findall(lowered)))
    if not found:
        return (0.0,) * 6
    words = [(m[0], m.start()) for m in WORD.finditer(lowered)]
    sums, total = [0.0] * 4, 0
    for at, (word, start) in enumerate(words):
        if word in found:
            window = words[max(0, at - WINDOW):at + WINDOW + 1]
            reported = 1.0 if quoted(lowered, start) else min(1.0, 0.5 * sum(w in REPORTING for w, _ in window))
            misspelt = found[word] > 0
            sums[misspelt] += 1 - reported
            sums[2 + misspelt] += reported
            total += 1
    return (*map(math.log1p, sums), math.log1p(len(found)), math.log1p(100 * total / len(words)))


@dataclass
class Model:
    lexicon: Lexicon
    base: float
    weights: tuple[float, ...]

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-self.base - sum(w * x for w, x in zip(self.weights, features(text, self.lexicon)))))


def learn_terms(sample: DataFrame, text: str) -> tuple[str, ...]:
    """Terms of a sample of texts with labels. A beginning stands for the longer beginnings that begin with it, unless they are as telling."""
    rows = sample.select("label", text)
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return ()
    counts = map_rows(rows, "label int, term string", lambda: lambda part: (
        (label, term) for label, t in part for term in terms_of(t))).groupBy("term").agg(
        F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    share, n = toxic / (toxic + clean), F.col("t") + F.col("c")
    against = 2 * (F.col("t") * F.log(F.col("t") / (n * share))
                   + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0))
    telling = counts.where((F.col("t") >= LEAST_DOCUMENTS) & (F.col("t") > LEAST_SHARE * n)).withColumn("ratio", against).where(
        (F.col("ratio") >= LEAST_RATIO) & (F.col("t") / n > share))
    # Bounded by the sample: each term has several of its toxic documents.
    rated = {r.term: r.ratio for r in telling.select("term", "ratio").collect()}
    # Words stay beside their beginnings, which match exactly only: else no misspelling of their first letters would be found.
    return tuple(sorted(t for t in rated if not (t.endswith("*") and any(
        rated.get(f"{t[:k]}*", 0) >= 1.05 * rated[t] for k in BEGINNINGS if k < len(t) - 1))
        and not (t.endswith("*") and any(w.startswith(t[:-1]) and w != t and rated[w] * 1.05 > rated[t] for w in rated))))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, np.ndarray]:
    """Ridge-penalised logistic regression by Newton steps."""
    full = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(full.shape[1]), penalty * np.eye(full.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        w = w - np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + ridge, full.T @ (p - y) + ridge @ w)
    return float(w[0]), w[1:]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = LEARN_ROWS) -> Model:
    """Terms and weights from labelled documents outside the held-out fold, at most ``rows`` of them, one text for each id."""
    chosen = labelled(labels, "toxic", key).where(~held_out(key)).orderBy(F.xxhash64(key), key).limit(rows)
    # At most ``rows`` ids and labels are broadcast.
    found = docs.select(F.col(key), F.col(text)).join(F.broadcast(chosen), key)
    sample = found.groupBy(key).agg(F.min(F.struct(F.col(text).alias("text"), "label")).alias("row")).select("row.*")
    lexicon = Lexicon(learn_terms(sample, "text"))
    names = ("x0", "x1", "x2", "x3", "x4", "x5")
    measured = map_rows(sample, "label int, " + ", ".join(f"{n} double" for n in names), lambda: lambda part: (
        (label, *features(t, lexicon)) for t, label in part)).toPandas()
    if measured.empty:
        return Model(lexicon, 0.0, (0.0,) * 6)
    base, weights = fit_logistic(measured[list(names)].to_numpy(), measured["label"].to_numpy(float))
    return Model(lexicon, base, tuple(map(float, weights)))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: key, held_out, score and predicted (1 from the threshold on).

    Null and empty texts score as texts without hits. Every row is scored by itself; keys may repeat or be null. Without labels
    the lexicon is empty and every score 0.5.
    """
    model = learn(docs, labels, key, text)
    kind = docs.schema[key].dataType.simpleString()
    scored = map_rows(docs.select(key, text), f"`{key}` {kind}, score double", lambda: lambda rows: (
        (name, model.score(t)) for name, t in rows))
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
