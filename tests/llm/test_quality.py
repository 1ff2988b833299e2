import math
import random
import re

import numpy as np
import pytest

from kerbline.llm import queries, risk_rules, rule_ensemble, statistics
from tests.conftest import SMALL
from tests.llm.fixtures import LABELS, ODD, docs, prose


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\nx\n\nx \n x", "a|b <c> #1 * $%&", "é b c \x1cd",
    "\n\n \n \n", "a b c d a b c e a b c", *(prose(s, 60, 6) for s in range(3)), "of the of the of the end of the"])
def test_counts_equal_a_plain_version(text):
    assert statistics.count(text)[:5] == plain_counts(text)


def test_many_different_words_are_counted_alike():
    words = "a b c d a b c x y z a b x y z".split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    assert statistics.repeated_words_of_many(words) == statistics.repeated_words(np.array([number[w] for w in words]))


def test_binomial_tail_is_exact():
    assert risk_rules.at_most(0, 10, 0.1) == pytest.approx(0.9 ** 10)
    assert risk_rules.at_most(2, 5, 0.5) == pytest.approx(sum(math.comb(5, i) for i in range(3)) / 32)
    assert risk_rules.at_most(5, 5, 0.3) == pytest.approx(1.0)


def test_settings_pass_in_order_and_stop_at_the_first_failure():
    n = 60
    good = np.array([0] * 20 + [900] * (n - 20))
    bad = np.array([0] * 5 + [40] * (n - 5))
    assert risk_rules.choose_setting(good, bad, 1000, 0.01, 0.01) == 19
    assert risk_rules.choose_setting(good, bad, 100, 0.01, 0.01) is None  # too few labels to guarantee anything
    assert risk_rules.choose_setting(good, np.zeros(n, int), 1000, 0.01, 0.01) is None
    assert risk_rules.choose_setting(good[:0], bad[:0], 1000, 0.01, 0.01) is None
    assert risk_rules.choose_setting(good, bad, 113, 0.04, 0.01) == 19 and risk_rules.choose_setting(good, bad, 112, 0.04, 0.01) is None


def test_path_goes_where_most_bad_texts_are():
    none = len(risk_rules.CUTOFFS)
    texts = [(none, none, 50, 40, True)] * 30 + [(10, none, none, none, False)] * 8 + [(none, none, 20, 10, False)] * 9
    drawn = np.array(texts)
    path = risk_rules.lay_path(drawn[:, :4].astype(int), drawn[:, 4] == 1)
    order = list(dict.fromkeys(rule for rule, _ in path))
    assert len(order) == 2 and order[0] in (2, 3) and order[1] == 0
    for rule in order:
        assert [at for r, at in path if r == rule] == list(range(sum(r == rule for r, _ in path)))
    reached = {rule: max(at for r, at in path if r == rule) for rule in order}
    assert 10 <= reached[order[0]] < 50 and 10 <= reached[0] < none
    assert risk_rules.lay_path(drawn[:0, :4].astype(int), drawn[:0, 4] == 1) == []


def test_the_guarantee_holds_on_fresh_texts():
    """Two ratios of good texts with known distributions; the true loss of the chosen joint setting is their exact tail."""
    drawn = np.random.default_rng(3)
    cutoffs, none = np.array(risk_rules.CUTOFFS), len(risk_rules.CUTOFFS)
    steps_of = lambda ratios: (cutoffs[None, :] > ratios[:, None]).sum(1)
    lost = []
    for _ in range(60):
        size = 600
        steps = np.full((size + 200, 4), none)
        steps[:size, 0], steps[:size, 1] = steps_of(drawn.beta(1, 12, size)), steps_of(drawn.beta(1, 30, size))
        steps[size:, 0], steps[size:, 1] = steps_of(drawn.beta(3, 9, 200)), steps_of(drawn.beta(3, 20, 200))
        good = np.arange(size + 200) < size
        design = np.arange(size + 200) % 4 == 0
        path = risk_rules.lay_path(steps[design], good[design])
        first = [min((i for i, (r, at) in enumerate(path) if at >= row[r]), default=len(path)) for row in steps[~design]]
        tally = [np.bincount(np.array(first)[good[~design] == kind], minlength=len(path) + 1).cumsum()[:-1] for kind in (True, False)]
        chosen = risk_rules.choose_setting(*tally, int(good[~design].sum()), 0.04, 0.05)
        limit = [min((cutoffs[at] for r, at in path[:chosen + 1] if r == rule), default=1.0) if chosen is not None else 1.0 for rule in (0, 1)]
        lost.append(1 - (1 - (1 - limit[0]) ** 12) * (1 - (1 - limit[1]) ** 30))
    assert sum(share > 0.04 for share in lost) <= 7 and max(lost) > 0.005


def test_every_labelled_text_of_the_quarter_lays_the_path(spark):
    """The bad texts of 100,000 are those whose keys have the greatest hashes."""
    bad = "xxhash64(string(id)) > 6.5e18"
    counts = spark.range(100_000).selectExpr(
        "id AS doc_id", "'en' AS lang", "100L AS n_words", f"IF({bad}, 50L, id % 3) AS n_symbols", "500L AS word_chars",
        "10L AS n_lines", "0L AS n_dup_lines", "0L AS n_repeat_words", "5L AS n_capitals")
    labels = spark.range(100_000).selectExpr("id AS doc_id", f"IF({bad}, 0, 1) AS quality")
    cutoffs = risk_rules.learn_cutoffs(counts, labels, "lang").collect()
    assert len(cutoffs) == 1 and 0.02 < cutoffs[0].symbols <= 0.5


def test_path_of_a_table_is_that_of_its_texts(spark):
    drawn = np.random.default_rng(7)
    good = drawn.random(3000) < 0.6
    steps = np.where(good[:, None], drawn.integers(20, len(risk_rules.CUTOFFS) + 1, (3000, 4)), drawn.integers(0, 61, (3000, 4)))
    table = spark.createDataFrame([(int(g), *map(int, row)) for g, row in zip(good, steps)],
                                  "label int, " + ", ".join(f"{n} int" for n in risk_rules.RULES))
    path = risk_rules.lay_path(steps, good)
    assert len({rule for rule, _ in path}) == 4 and risk_rules.lay_path_of(table) == path
    assert risk_rules.lay_path_of(table.limit(0)) == []


def test_rules_judge_each_stratum_by_its_own_labels(spark):
    good = [(i, prose(i, 80, 4), "en" if i % 2 else "de") for i in range(1400)]
    bad = [(2000 + i, " ".join(f"{w}###" for w in prose(i, 80).split()), "en") for i in range(60)]
    bad += [(3000 + i, " ".join(f"{w}###" for w in prose(i, 80).split()), None) for i in range(5)]
    rows = docs(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad], LABELS)
    labels = labels.union(labels.limit(50))
    found = {(r.doc_id, r.lang): r for r in risk_rules.judge(rows, labels).collect()}
    assert all(found[i, lang].kept for i, _, lang in good)
    assert all(found[2000 + i, "en"].failed_rules == ["symbols"] for i in range(60))
    assert all(found[3000 + i, None].kept for i in range(5))  # no good labels there
    cuts = {r.stratum: r.symbols for r in risk_rules.learn_cutoffs(
        rows.select("doc_id", "lang", statistics.counts_of("text").alias("c")).select("doc_id", "lang", "c.*"), labels, "lang").collect()}
    assert cuts["en"] is not None and cuts["de"] is None  # no bad texts there
    assert risk_rules.judge(rows, labels).count() == len(good) + len(bad) + len(ODD)
    assert not any(r.kept for r in found.values() if r.n_words < 50)


def test_rules_without_rows_or_labels(spark):
    labels = spark.createDataFrame([], LABELS)
    assert risk_rules.judge(docs(spark, []), labels).count() == 0
    judged = {r.doc_id: r.kept for r in risk_rules.judge(docs(spark, [(1, prose(1, 60)), (2, None)]), labels).collect()}
    assert judged == {1: True, 2: False}


def test_query_one_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op1_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r.doc_id]) < 4000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def noisy(i):
    return " ".join(f"{w.upper()}!!" for w in prose(i, 60).split())


@pytest.fixture(scope="module")
def graded(spark):
    rows = [(i, noisy(i) if i % 6 == 0 else prose(i, 90, 3)) for i in range(240)]
    return docs(spark, rows + ODD), spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240)], LABELS)


def test_ensemble_separates_and_is_sparse(spark, graded):
    rows, labels = graded
    model = rule_ensemble.learn(rows, labels)
    assert 0 < len(model.weights) < 60
    scored = rule_ensemble.score_quality(rows, labels).collect()
    assert len(scored) == 240 + len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == int(r.doc_id % 6 != 0) for r in scored if r.doc_id is not None and r.doc_id > 6 and r.held_out)
    assert "Python" not in model.column()._jc.toString()


def test_column_and_model_agree(spark):
    values = {n: np.random.default_rng(1).random(300) for n in ("a", "b")}
    label = ((values["a"] > 0.4) & (values["b"] <= 0.7)).astype(float)
    model = rule_ensemble.fit(values, label)
    frame = spark.createDataFrame(list(zip(values["a"].tolist(), values["b"].tolist())), "a double, b double")
    got = np.array([r[0] for r in frame.select(model.column()).collect()])
    total = model.base + sum(w * np.logical_and.reduce([c.holds(values) for c in rule]) for rule, w in model.weights)
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got >= 0.5) == (label == 1)).mean() > 0.97


def test_ensemble_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], LABELS)
    assert [r.score for r in rule_ensemble.score_quality(docs(spark, [(1, "a")]), labels).collect()] == [0.5]
    assert rule_ensemble.score_quality(docs(spark, []), labels).count() == 0


def test_keep_good_returns_whole_rows(spark, graded):
    rows, labels = graded
    kept = rule_ensemble.keep_good(rows, labels)
    assert kept.columns == rows.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(7, 240) if i % 6} <= ids and not {i for i in range(12, 240) if i % 6 == 0} & ids


def test_query_nine_is_accurate_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in queries.op9_quality_classifier(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95
