import collections
import math
import random

import pytest

from kerbline.llm import decontamination as leaks, queries, toxicity
from tests.conftest import SMALL
from tests.llm.fixtures import LABELS, ODD, docs, prose

ITEMS = "item_id bigint, text string, score double"


def plain_weights(items):
    """BM25 shares of every item's terms."""
    words = {i: leaks.words_of(t) for i, t in items}
    mean = sum(map(len, words.values())) / len(words)
    df = collections.Counter(t for own in words.values() for t in set(own))
    out = {}
    for i, own in words.items():
        weight = {}
        for t, tf in collections.Counter(own).items():
            weight[t] = math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
        out[i] = {t: w / sum(weight.values()) for t, w in weight.items()}
    return out


def index_of(items):
    found = {}
    for _, t in items:
        for term in set(leaks.words_of(t)):
            found[term] = found.get(term, 0) + 1
    return leaks.build_index(items, found, len(items), sum(len(leaks.words_of(t)) for _, t in items) / len(items))


def plain_retrieval(items, texts):
    """Every window of every item's own size, scored without an index."""
    out = {}
    weights = plain_weights(items)
    for k, words in enumerate(texts):
        windows = {half: [set(words[at:at + 2 * half]) for at in range(0, len(words), half)] for half in (64, 128, 256)}
        for number, (i, t) in enumerate(items):
            half = leaks.half_of(len(leaks.words_of(t)))
            for n, window in enumerate(windows[half]):
                score = sum(s for term, s in weights[i].items() if term in window)
                if score >= leaks.THRESHOLD:
                    out[k, n * half, number] = score
    return out


@pytest.fixture(scope="module")
def searches():
    """Items of three length classes, texts that hold pieces of them, and the plain result."""
    items = [(i, prose(i, 12 + i % 9)) for i in range(40)] + [(40 + i, prose(900 + i, 66 + 9 * i)) for i in range(4)] + [(50, prose(950, 140))]
    drawn = random.Random(2)
    texts = []
    for k in range(40):
        words = prose(1000 + k, drawn.randrange(0, 300)).split()
        for _ in range(drawn.randrange(3)):
            at = drawn.randrange(len(words) + 1)
            own = items[drawn.randrange(len(items))][1].split()
            words[at:at] = own[:drawn.randrange(1, len(own) + 1)]
        texts.append(words)
    return items, texts, plain_retrieval(items, texts)


@pytest.mark.parametrize("entries", [leaks.GROUP_ENTRIES, 50, 1])
@pytest.mark.parametrize("block", [leaks.BLOCK_ITEMS, 3])
def test_retrieval_finds_every_item_above_the_threshold(searches, monkeypatch, entries, block):
    items, texts, expected = searches
    monkeypatch.setattr(leaks, "GROUP_ENTRIES", entries)
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", block)
    found = {(k, at, i): s for k, at, i, s in leaks.Searcher(index_of(items)).retrieve(texts)}
    assert found.keys() == expected.keys() and {leaks.half_of(len(items[i][1].split())) for *_, i in found} == {64, 128, 256}
    assert all(abs(found[hit] - s) < 1e-9 for hit, s in expected.items())


def test_blocks_are_skipped():
    """A common word stands in every block; only windows with an item's rarer words open any."""
    items = [(i, f"the and of {' '.join(f'{c}{i}' for c in 'abcdefghijkl')}") for i in range(640)]
    searcher = leaks.Searcher(index_of(items))
    texts = [f"the and of {prose(5000 + k, 60)}".split() for k in range(50)] + [f"{prose(6000, 40)} {items[7][1]}".split()]
    assert {(k, i) for k, _, i, s in searcher.retrieve(texts) if s > 0.99} == {(50, 7)}
    assert searcher.scored == 1 and searcher.opened < 20 and searcher.listed > 100


def test_groups_have_bounded_work_and_cover_everything():
    costs = leaks.np.array([3, 0, 9, 1, 1, 1, 0, 20, 2])
    groups = list(leaks._groups(costs, 4))
    assert [n for g in groups for n in range(g.start, g.stop)] == list(range(9))
    assert all(costs[g].sum() <= 4 or g.stop - g.start == 1 for g in groups)


def test_other_items_change_nothing(spark):
    """Question and answer of a short item 900 words apart are no leak of it, whatever long items there are besides."""
    short = "Which river crosses the old town of the northern province? " + prose(1, 12)
    question, answer = short.split("?")
    rows = docs(spark, [(1, f"{question}? {prose(77, 900)} {answer}"), (2, f"{prose(78, 300)} {short} {prose(79, 300)}")])
    for others in ([], [(2, prose(80, 3000))]):
        items = spark.createDataFrame([(1, short, 0.0), *((i, t, 0.0) for i, t in others)], ITEMS)
        assert [(r.doc_id, r.item_id) for r in leaks.find_leaks(rows, items).collect()] == [(2, 1)]


def test_question_and_answer():
    assert leaks.parts_of("What is it? A b c.") == (["what", "is", "it"], ["a", "b", "c"])
    assert leaks.parts_of("a b c d e f") == (["a", "b", "c", "d"], ["e", "f"])
    assert leaks.parts_of("one") == (["one"], [])
    assert leaks.overlap([], ["x"]) == 1.0 and leaks.overlap(list("abcdefg"), list("xabcdey")) == pytest.approx(1 / 3)


@pytest.fixture(scope="module")
def leaky(spark):
    items = [(i, prose(500 + i, 30)) for i in range(40)] + [(90, None), (91, ""), (92, prose(505, 30))]
    rows = [(i, prose(i, 150)) for i in range(100)]
    rows += [(200 + i, f"{prose(i, 70)}\n{prose(500 + i, 30).upper()}. {prose(i + 3, 60)}") for i in range(10)]
    rows += [(300, " ".join(prose(507, 30).split()[:10])), (301, " ".join(w if k % 11 else "x" for k, w in enumerate(prose(508, 30).split())))]
    return docs(spark, rows + ODD), spark.createDataFrame([(*i, 0.1) for i in items], ITEMS)


@pytest.mark.parametrize("characters", [leaks.INDEX_CHARACTERS, 1500])
def test_planted_items_are_found_and_nothing_else(spark, leaky, monkeypatch, characters):
    rows, items = leaky
    built = leaks.indexes
    monkeypatch.setattr(leaks, "indexes", lambda *a: built(*a, characters=characters))  # 1500: several indexes
    found = sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(rows, items).collect())
    assert found == sorted([*((200 + i, i) for i in range(10)), (205, 92), (301, 8)])
    kept = leaks.drop_leaks(rows, items)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 11
    assert {r.doc_id for r in kept.collect()} & {301, *range(200, 210)} == set()


def test_no_items_and_no_documents(spark, leaky):
    rows, items = leaky
    assert leaks.find_leaks(rows, items.limit(0)).count() == 0 and leaks.find_leaks(docs(spark, []), items).count() == 0
    assert leaks.drop_leaks(rows, items.where("text = ''")).count() == rows.count()


def test_query_seven_equals_a_plain_search(spark):
    rows = {r.doc_id: leaks.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: leaks.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    whole = {(d, i) for d, words in rows.items() for i, own in items.items() if f" {' '.join(own)} " in f" {' '.join(words)} "}
    found = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, SMALL).collect()}
    assert whole <= found and whole
    stated = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    numbers, texts = list(rows), list(rows.values())
    verified = set()
    for k, at, n in plain_retrieval(list(stated.items()), texts):
        i = list(stated)[n]
        passage = texts[k][at:at + 2 * leaks.half_of(len(items[i]))]
        if all(leaks.overlap(part, passage) >= leaks.OVERLAP for part in leaks.parts_of(stated[i])):
            verified.add((numbers[k], i))
    assert found == verified


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ("idiot", "scum", "worthless", "pathetic", "loser", "low*", "id", "disgusting")
    lexicon = toxicity.Lexicon(terms)
    drawn = random.Random(4)
    words = []
    for term in terms * 150:
        letters = list(term.rstrip("*"))
        for _ in range(drawn.randrange(4)):
            at, kind = drawn.randrange(len(letters) + 1), drawn.randrange(3)
            letters[at:at + (kind != 0)] = [] if kind == 1 else [drawn.choice("abcdiotslw")]
        words.append("".join(letters))
    for word in [*words, "", "i", "x" * 500]:
        near = [distance(word, t) for t in terms if not t.endswith("*") and distance(word, t) <= toxicity.edits(len(t))]
        near += [0] * word.startswith("low")
        assert lexicon.match(word) == min(near, default=None), word


def test_the_automaton_starts_anew_without_change(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_ENTRIES", 16)
    lexicon = toxicity.Lexicon(("idiot", "worthless"))
    assert [lexicon.match(w) for w in ("idiot", "idjot", "worthles", "wrthles", "wort", *(f"w{i}" for i in range(60)), "idiot")][:5] == [0, 1, 1, 2, None]
    assert lexicon.match("idiot") == 0 and toxicity.Lexicon(()).match("a") is None


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon(("idiot",))
    abuse = toxicity.features("you are an idiot and so on", lexicon)
    marks = toxicity.features('they shouted "an idiot" there', lexicon)
    report = toxicity.features("the word idiot is an insult", lexicon)
    assert abuse[0] > 0 and abuse[2] == 0 and marks[0] == 0 and marks[2] > 0 and report[2] > report[0]
    assert toxicity.features("an idjot", lexicon)[1] > 0 and toxicity.features(None, lexicon) == (0.0,) * 6


@pytest.fixture(scope="module")
def spoken(spark):
    drawn = random.Random(9)
    bad = ["moron", "scumbag", "worthless"] + [f"vequ{e}" for e in ("ta", "ri", "lo", "mu", "na", "si")]
    rows = []
    for i in range(400):
        words = prose(i, 60).split()
        if i % 5 == 0:
            for _ in range(3):
                words[drawn.randrange(60)] = drawn.choice(bad)
        rows.append((i, " ".join(words)))
    rows += [(1000, prose(1, 30) + " you mooron " + prose(2, 30)), (1001, prose(3, 60) + " vequzzz")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], LABELS)
    return docs(spark, rows + ODD), labels


def test_lexicon_is_learnt_with_beginnings(spark, spoken):
    model = toxicity.learn(*spoken)
    assert {"moron", "worthless", "vequ*"} <= set(model.lexicon.terms) and len(model.lexicon.terms) < 12


def test_words_stay_beside_their_beginnings(spark, spoken):
    lexicon = toxicity.learn(*spoken).lexicon
    assert lexicon.match("vequta") == 0 and lexicon.match("vequzzz") == 0  # a word and the beginning
    assert lexicon.match("veuta") == 1 and lexicon.match("vaquta") == 1  # misspelt within the beginning


def test_held_out_documents_and_misspellings(spark, spoken):
    rows, labels = spoken
    scored = toxicity.score_toxicity(rows, labels).collect()
    assert len(scored) == 402 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id is not None and 6 < r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in scored}
    # One hit each, where the labelled documents have three: far above texts without any.
    assert all(by_id[i].score > 10 * by_id[2].score for i in (1000, 1001))


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.score_toxicity(docs(spark, [(1, "a")]), none).collect()] == [0.5]
    assert toxicity.score_toxicity(docs(spark, []), none).count() == 0


def test_query_five_is_accurate_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in queries.op5_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.9
