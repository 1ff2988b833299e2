"""Quality rules with risk-controlled cutoffs.

A rule rejects a text whose ratio reaches a cutoff; a setting is a cutoff for each rule, and rejects what any of its rules
rejects. A quarter of the labelled texts, of all strata together, serves to lay a path of settings from lenient to strict:
again and again the rule and cutoff are taken that reject most bad texts, less ``GOOD_WORTH`` for each good one, of the texts that are
left, and the rule goes there step by step. Every text of the quarter counts: it is tallied by Spark, and the driver sees for each
stretch of the path only how many texts have which first rejecting cutoff. Labelled good texts of the other three quarters are the
holdout, which the path may not have seen, or the tests would not hold: for each stratum
the settings are tested along the path. A setting passes if the exact binomial test rejects "it falsely rejects more than the
allowed share of good texts"; the first that does not pass ends the row, so that neither the row nor the number of rules costs
a correction (fixed-sequence testing of joint settings, laid out by other texts). Strata are corrected for by Bonferroni, so
that with probability ``1 - error`` no stratum loses more than ``risk`` of its good texts. Among the passing settings that is chosen
which is worth most by the holdout, the strictest of equals. Strata with too few labels (fewer than about 110 good texts of the holdout
with four strata) have no cutoffs: nothing can be guaranteed for them, and nothing is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.llm.statistics import COUNTS, counts_of, labelled
from kerbline.operators.store import materialize

RISK, ERROR = 0.04, 0.05
#: Bad texts that must be rejected for each good text lost, among cutoffs that pass.
GOOD_WORTH = 10
#: One in so many labelled texts, chosen by hash of the key, lays the path; all others test it.
DESIGN_SHARE = 4
#: From lenient to strict: 60 steps of 10 % from 1 down to 0.0033.
CUTOFFS = tuple(round(1.1 ** -k, 6) for k in range(60))


def ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


RULES = {
    "symbols": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p): the exact test of a share of at least p, when k of n were counted."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
             for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def walk(tally: Callable[[list[int]], np.ndarray]) -> list[tuple[int, int]]:
    """Settings from lenient to strict: (rule, place of its cutoff), each in force beside all before it.

    ``tally`` gets for each rule the number of its cutoffs in force. Of the texts that these leave, it counts by rule, label and
    first rejecting cutoff (one past the grid for none).
    """
    path, levels = [], [0] * len(RULES)
    while True:
        most, rule, stop = 0, None, None
        for at, (bad, good) in enumerate(tally(levels)):
            worth = bad.cumsum()[:-1] - GOOD_WORTH * good.cumsum()[:-1]
            if worth.max() > most:
                best = np.flatnonzero(worth == worth.max())
                most, rule, stop = worth.max(), at, int(best[len(best) // 2])
        if rule is None:
            return path
        path += [(rule, place) for place in range(levels[rule], stop + 1)]
        levels[rule] = stop + 1


def lay_path(steps: np.ndarray, good: np.ndarray) -> list[tuple[int, int]]:
    """The path of texts in memory: ``steps`` has for each text and rule the first cutoff that rejects it."""
    def tally(levels: list[int]) -> np.ndarray:
        left = (steps >= levels).all(1)
        return np.array([[np.bincount(steps[left & kind, at], minlength=len(CUTOFFS) + 1) for kind in (~good, good)]
                         for at in range(len(RULES))])

    return walk(tally)


def lay_path_of(graded: DataFrame) -> list[tuple[int, int]]:
    """The path of a table of any size with a label and, under each rule's name, the first cutoff that rejects the text."""
    alike = materialize(graded.groupBy("label", *RULES).agg(F.count("*").alias("texts")), "path-tally")
    each = F.explode(F.array(*(F.struct(F.lit(at).alias("rule"), F.col(n).alias("step")) for at, n in enumerate(RULES)))).alias("e")

    def tally(levels: list[int]) -> np.ndarray:
        counts = np.zeros((len(RULES), 2, len(CUTOFFS) + 1), int)
        left = alike.where(reduce(and_, (F.col(n) >= level for n, level in zip(RULES, levels))))
        for rule, step, label, texts in left.select("label", "texts", each).groupBy("e.rule", "e.step", "label").agg(F.sum("texts")).collect():
            counts[rule, label, step] = texts
        return counts

    return walk(tally)


def choose_setting(good: np.ndarray, bad: np.ndarray, n_good: int, risk: float, error: float) -> int | None:
    """The place in the path to go to, given how many good and bad texts each of its settings rejects."""
    passed = 0
    while passed < len(good) and good[passed] <= risk * n_good and at_most(int(good[passed]), n_good, risk) <= error:
        passed += 1
    worth = bad[:passed] - GOOD_WORTH * good[:passed]
    if not passed or worth.max() <= 0:
        return None
    return int(np.flatnonzero(worth == worth.max())[-1])


def learn_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", risk: float = RISK,
                  error: float = ERROR) -> DataFrame:
    """Per stratum (null is one) a cutoff for each rule, null where none passes."""
    graded = counts.where(~base_failed()).join(labelled(labels, "quality", key), key)

    def step(found: Column) -> Column:
        """The first cutoff of the grid that rejects the text; one past the grid for none."""
        return F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: c > found))

    draw = F.xxhash64(F.col(key).cast("string"))
    graded = materialize(graded.select(F.col(stratum).alias("stratum"), "label", *(step(ratio(*parts)).alias(n) for n, parts in RULES.items()),
                                       draw.alias("draw")), "graded-steps")
    design = F.pmod("draw", F.lit(DESIGN_SHARE)) == 0
    path = lay_path_of(graded.where(design))
    # For each rule and step the first setting that rejects; one past the path for none.
    first = [[next((i for i, (r, place) in enumerate(path) if r == rule and place >= s), len(path)) for s in range(len(CUTOFFS) + 1)]
             for rule in range(len(RULES))]
    place = F.least(*(F.element_at(F.array(*map(F.lit, known)), F.col(name) + 1) for name, known in zip(RULES, first)))
    tally = materialize(graded.where(~design).groupBy("stratum", place.alias("place")).agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")), "cutoff-tally")
    strata = tally.select("stratum").distinct().count()

    def choose(group):
        good, bad = (np.bincount(group["place"], group[c], len(path) + 1).astype(int) for c in ("good", "bad"))
        chosen = choose_setting(good.cumsum()[:-1], bad.cumsum()[:-1], int(good.sum()), risk, error / max(1, strata))
        in_force = path[:chosen + 1] if chosen is not None else []
        out = {"stratum": group["stratum"].iloc[0]}
        for rule, name in enumerate(RULES):
            out[name] = min((CUTOFFS[at] for r, at in in_force if r == rule), default=None)
        return type(group)([out]).astype({name: "float64" for name in RULES})

    kind = tally.schema["stratum"].dataType.simpleString()
    # A group has one row for each place of the path at most.
    return tally.groupBy("stratum").applyInPandas(choose, f"stratum {kind}, " + ", ".join(f"{n} double" for n in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text",
          risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per row of ``docs``: key, stratum, the counts, base_failed, failed_rules (those whose cutoff the text reaches) and kept.

    Null and empty texts have counts of 0 and fail the base; repeated rows and null keys are judged like others. The counts
    are written once to the shared folder, since both the learning and the judging read them.
    """
    counts = materialize(docs.select(key, stratum, counts_of(F.col(text)).alias("counts")).select(key, stratum, "counts.*"),
                         "rule-counts")
    cutoffs = materialize(learn_cutoffs(counts, labels, stratum, key, risk, error), "rule-cutoffs")
    limits = cutoffs.select(F.col("stratum").alias("cut_stratum"), *(F.col(n).alias(f"cut_{n}") for n in RULES))
    failed = F.array_compact(F.array(*(F.when(ratio(*parts) >= F.col(f"cut_{n}"), F.lit(n)) for n, parts in RULES.items())))
    joined = counts.join(limits, F.col(stratum).eqNullSafe(F.col("cut_stratum")), "left")
    return joined.select(key, stratum, *COUNTS, base_failed().alias("base_failed"), failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
