"""Benchmark decontamination: passages of the corpus query a BM25 index of test items.

Every passage of every text is a query. Items are classed by length, and each class has windows of its own: twice the least
power of two that its items fit in (128 words at least), each half overlapping the next, so that an item lies whole in some
window. An item's windows thus follow from the item alone. Its score is the share of its own BM25 sum that the window's words
make up, so the threshold is fixed, and every passage retrieves all items that reach it.

Items stand in blocks; the index holds the greatest share of every term, and of every term and block. A window takes its
terms in order of their greatest shares; the pivot is the first at which the sum of these reaches the threshold. No item made of
terms before the pivot alone can get there, so only the blocks of the other terms are opened (block-max WAND with the pivot by
bound, not by item number, so that many windows go at once). Blocks that the remaining terms can't lift to the threshold are
skipped, then those whose own maxima don't add up to it; the items of the rest are scored. Windows are taken in groups of
bounded work, whatever the number of items. What is retrieved is verified on the n-grams of the item's question and answer.

The index of a bounded number of items is broadcast; more items are taken in several parts of that size, one pass each. What a
pass found is written before the next index is made, so that one index is held at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from kerbline.llm.texts import SLICE_ROWS, map_rows
from kerbline.operators.store import materialize

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Share of an item's BM25 sum that a window needs, and share of n-grams of the question and of the answer.
THRESHOLD, OVERLAP, GRAM = 0.5, 0.5, 5
BLOCK_ITEMS = 16
#: Half a window of the shortest items, in words.
LEAST_HALF = 64
#: Characters of test items that one index holds.
INDEX_CHARACTERS = 16_000_000
#: Index entries looked at in one go; a single window may exceed it, by no more than its terms have blocks.
GROUP_ENTRIES = 250_000
SLACK = 1e-7  # of bounds; they are sums in another order than the scores


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer: split after the first question mark, else two thirds of the words are the question."""
    head, mark, tail = text.partition("?")
    question, answer = words_of(head), words_of(tail)
    if not (mark and question and answer):
        words = words_of(text)
        cut = max(1, (2 * len(words) + 2) // 3)
        question, answer = words[:cut], words[cut:]
    return question, answer


def grams_of(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def overlap(part: list[str], window: list[str]) -> float:
    """Share of the part's n-grams found in the window; 1 for an empty part. A part shorter than n is one n-gram."""
    if not part:
        return 1.0
    size = min(GRAM, len(part))
    own = grams_of(part, size)
    return len(own & grams_of(window, size)) / len(own)


def half_of(n_words: int) -> int:
    """Half a window for an item of so many words."""
    return max(LEAST_HALF, 1 << (n_words - 1).bit_length())


@dataclass
class LengthClass:
    """Postings of the items with equal windows: for each term its blocks with their greatest shares, and for each of those the items."""

    half: int
    numbers: np.ndarray      # of the items in the index; a block holds the next BLOCK_ITEMS of them
    top: np.ndarray          # greatest share of each term, 0 if no item has it
    start: np.ndarray        # first entry of each term
    key: np.ndarray          # of an entry: term * n_blocks + block, ascending
    block: np.ndarray
    share: np.ndarray
    item_start: np.ndarray   # first posting of each entry
    item: np.ndarray
    item_share: np.ndarray

    @property
    def n_blocks(self) -> int:
        return -(-len(self.numbers) // BLOCK_ITEMS)


@dataclass
class ItemIndex:
    items: list[tuple]
    terms: dict[str, int]
    classes: list[LengthClass]


def _length_class(half: int, numbers: list[int], shares: list[dict[int, float]], n_terms: int) -> LengthClass:
    postings = [(term, place, s) for place, own in enumerate(shares) for term, s in own.items()]
    term, place, share = (np.array(c, t) for c, t in zip(zip(*postings), (np.int64, np.int64, np.float64)))
    order = np.lexsort((place, term))
    term, place, share = term[order], place[order], share[order]
    key = term * -(-len(numbers) // BLOCK_ITEMS) + place // BLOCK_ITEMS
    first = np.flatnonzero(np.diff(key, prepend=-1))
    top = np.zeros(n_terms)
    np.maximum.at(top, term, share)
    return LengthClass(half, np.array(numbers, np.int64), top, np.searchsorted(term[first], np.arange(n_terms + 1)), key[first],
                       place[first] // BLOCK_ITEMS, np.maximum.reduceat(share, first), np.append(first, len(key)), place, share)


def build_index(items: list[tuple], frequency: dict[str, int], n_items: int, mean_words: float) -> ItemIndex:
    """``items`` are (id, text); ``frequency`` has the number of items of each of their terms, over all items."""
    terms: dict[str, int] = {}
    classes: dict[int, list[tuple[int, dict[int, float]]]] = {}
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        share = {}
        for term, n in Counter(words).items():
            rarity = math.log(1 + (n_items - frequency[term] + 0.5) / (frequency[term] + 0.5))
            share[terms.setdefault(term, len(terms))] = rarity * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean_words))
        total = sum(share.values())
        classes.setdefault(half_of(len(words)), []).append((number, {t: s / total for t, s in share.items()}))
    return ItemIndex(items, terms, [_length_class(half, *map(list, zip(*own)), len(terms)) for half, own in sorted(classes.items())])


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range, which range it is and the places in it, one after another."""
    sizes = stop - start
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(sizes.cumsum() - sizes, sizes) + start[which]


def _groups(costs: np.ndarray, most: int):
    """Slices whose costs add up to ``most`` at most, but for slices of one."""
    total = np.concatenate(([0], costs.cumsum()))
    at = 0
    while at < len(costs):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield slice(at, end)
        at = end


class Searcher:
    def __init__(self, index: ItemIndex):
        self.index = index
        self.parts = [parts_of(text) for _, text in index.items]
        self.halves = {int(n): c.half for c in index.classes for n in c.numbers}
        #: Blocks of the windows' terms, those opened, and those whose items were scored.
        self.listed = self.opened = self.scored = 0

    def retrieve(self, texts: list[list[str]]) -> list[tuple[int, int, int, float]]:
        """(text, first word of the window, item number, score) of every window and item that reach the threshold."""
        get = self.index.terms.get
        numbers = np.fromiter((get(w, -1) for words in texts for w in words), np.int64)
        lengths = np.array([len(words) for words in texts], np.int64)
        place = np.arange(len(numbers)) - np.repeat(lengths.cumsum() - lengths, lengths)
        text = np.repeat(np.arange(len(texts)), lengths)
        known = numbers >= 0
        numbers, place, text = numbers[known], place[known], text[known]
        return [hit for c in self.index.classes for hit in self._of_class(c, numbers, place, text, lengths)]

    def _of_class(self, c: LengthClass, numbers: np.ndarray, place: np.ndarray, text: np.ndarray, lengths: np.ndarray):
        own = c.top[numbers] > 0
        numbers, place, text = numbers[own], place[own], text[own]
        # Windows cover two chunks of half their words; each text has one window for every chunk.
        chunks = -(-lengths // c.half)
        base = chunks.cumsum() - chunks
        first = (base[text] + place // c.half) * len(c.top) + numbers
        pairs = np.unique(np.concatenate((first, first[place >= c.half] - len(c.top))))
        window, term = np.divmod(pairs, len(c.top))
        top, size = c.top[term], c.start[term + 1] - c.start[term]
        self.listed += int(size.sum())
        # Windows whose terms can't make up the threshold go; those of the others stand in order of their bounds.
        able = (np.bincount(window, top) >= THRESHOLD - SLACK)[window] if len(window) else np.zeros(0, bool)
        window, term, top, size = window[able], term[able], top[able], size[able]
        order = np.lexsort((top, window))
        term, top, size = term[order], top[order], size[order]
        names, begin = np.unique(window, return_index=True)
        end = np.append(begin[1:], len(window))
        which = np.repeat(np.arange(len(names)), end - begin)
        total = top.cumsum()
        total -= np.repeat((total - top)[begin], end - begin)
        late = total >= THRESHOLD - SLACK
        pivot = end - np.bincount(which, late, minlength=len(names)).astype(np.int64)
        before = np.bincount(which, top * ~late, minlength=len(names))
        owner = np.repeat(np.arange(len(lengths)), chunks)
        # Work of a window: its terms' entries, and a cell for each block.
        work = np.add.reduceat(size, begin) + c.n_blocks if len(begin) else begin
        for group in _groups(work, GROUP_ENTRIES):
            n, item, score = self._score(c, term, begin[group], pivot[group], end[group], before[group])
            found = names[group][n]
            yield from zip(owner[found].tolist(), ((found - base[owner[found]]) * c.half).tolist(), c.numbers[item].tolist(), score.tolist())

    def _score(self, c: LengthClass, term: np.ndarray, begin: np.ndarray, pivot: np.ndarray, end: np.ndarray, before: np.ndarray):
        """Windows (places in ``begin``), items and scores; a window's terms are those from begin to end. Cells are windows x blocks."""
        at, pair = _spread(pivot, end)
        which, entry = _spread(c.start[term[pair]], c.start[term[pair] + 1])
        self.opened += len(entry)
        n_cells = len(begin) * c.n_blocks
        bound = np.bincount(at[which] * c.n_blocks + c.block[entry], c.share[entry], minlength=n_cells)
        # What the terms before the pivot can add, by their greatest shares and then by those in the block.
        live = (bound > 0) & (bound + np.repeat(before, c.n_blocks) >= THRESHOLD - SLACK)
        for cell, entry in self._entries(c, term, live, begin, pivot):
            bound += np.bincount(cell, c.share[entry], minlength=n_cells)
        live &= bound >= THRESHOLD - SLACK
        cells = np.flatnonzero(live)
        self.scored += len(cells)
        score = np.zeros(len(cells) * BLOCK_ITEMS)
        for cell, entry in self._entries(c, term, live, begin, end):
            which, posting = _spread(c.item_start[entry], c.item_start[entry + 1])
            score += np.bincount(np.searchsorted(cells, cell)[which] * BLOCK_ITEMS + c.item[posting] % BLOCK_ITEMS,
                                 c.item_share[posting], minlength=len(score))
        hit = np.flatnonzero(score >= THRESHOLD - 1e-9)
        window, block = np.divmod(cells[hit // BLOCK_ITEMS], c.n_blocks)
        return window, block * BLOCK_ITEMS + hit % BLOCK_ITEMS, score[hit]

    @staticmethod
    def _entries(c: LengthClass, term: np.ndarray, live: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Cells and entries of the terms from begin to end in live cells: looked up, or read through where most cells of a window live."""
        n_live = live.reshape(len(begin), c.n_blocks).sum(1)
        _, pair = _spread(begin, end)
        n_listed = np.bincount(np.repeat(np.arange(len(begin)), end - begin), c.start[term[pair] + 1] - c.start[term[pair]], len(begin))
        wide = n_listed <= 4 * n_live * (end - begin)
        own = np.flatnonzero(wide & (n_live > 0))
        if len(own):
            at, pair = _spread(begin[own], end[own])
            which, entry = _spread(c.start[term[pair]], c.start[term[pair] + 1])
            cell = own[at[which]] * c.n_blocks + c.block[entry]
            yield cell[live[cell]], entry[live[cell]]
        cells = np.flatnonzero(live & ~np.repeat(wide, c.n_blocks))
        if len(cells):
            window, block = np.divmod(cells, c.n_blocks)
            which, pair = _spread(begin[window], end[window])
            key = term[pair] * c.n_blocks + block[which]
            entry = np.minimum(np.searchsorted(c.key, key), len(c.key) - 1)
            there = c.key[entry] == key
            yield cells[which[there]], entry[there]

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its verified items: (item number, score, question overlap, answer overlap, first word of the window)."""
        words = [words_of(t) for t in texts]
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for text, first, item, score in self.retrieve(words):
            passage = words[text][first:first + 2 * self.halves[item]]
            question, answer = (overlap(part, passage) for part in self.parts[item])
            if question >= OVERLAP and answer >= OVERLAP:
                found = (round(score, 6), round(question, 6), round(answer, 6), first)
                if item not in best[text] or (*found[:3], -found[3]) > (*best[text][item][:3], -best[text][item][3]):
                    best[text][item] = found
        return [sorted((i, *f) for i, f in b.items()) for b in best]


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text", characters: int = INDEX_CHARACTERS):
    """Indexes that together hold every item with a word; each is built from a bounded part of the benchmark.

    Term frequencies and lengths are those of all items, however many indexes there are.
    """
    items = benchmark.select(F.col(key).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kind = items.schema["item"].dataType.simpleString()
    worded = map_rows(items, f"item {kind}, text string, words array<string>", lambda: lambda rows: (
        (i, t, w) for i, t in rows if (w := words_of(t))))
    size = worded.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.length("text")).alias("chars")).first()
    if not size.n:
        return
    frequency = worded.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").count()
    n_parts = -(-size.chars // characters)
    for part in range(n_parts):
        own = worded.where(F.pmod(F.xxhash64("text"), F.lit(n_parts)) == part)
        terms = own.select(F.explode("words").alias("term")).distinct()
        yield build_index([tuple(r) for r in own.select("item", "text").orderBy("item", "text").collect()],
                          {r.term: r["count"] for r in frequency.join(terms, "term").collect()}, size.n, size.mean)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Per row of ``docs`` and verified item: key, item id, score, question and answer overlap, first word of the best window.

    Null and empty texts, and null and empty items, have no rows. Items of equal text are reported each; repeated rows repeat
    their results. The result of an empty benchmark is empty.
    """
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = (f"`{key}` {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double, "
              "first_word bigint")
    found = shared = None
    for index in indexes(benchmark, item_key):
        if shared:
            found = materialize(found, "leaks")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def start(shared=shared):
            searcher = Searcher(shared.value)
            names = [i for i, _ in shared.value.items]

            def handle(rows):
                for (name, _), leaks in zip(rows, searcher.search([t for _, t in rows])):
                    yield from ((name, names[i], *rest) for i, *rest in leaks)
            return handle

        own = map_rows(docs.select(key, text), schema, start)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no verified item.

    Rows with null or empty texts stay, and each row is judged by itself, so that repeated rows stay or go alike. An empty benchmark
    drops nothing. Extra columns may have any names, and are not looked at.
    """
    clean, shared = docs, None
    for index in indexes(benchmark, item_key):
        if shared:
            clean = materialize(clean, "clean")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            searcher = Searcher(shared.value)
            for texts in batches:
                yield pa.array([bool(leaks) for at in range(0, len(texts), SLICE_ROWS)
                                for leaks in searcher.search(texts.slice(at, SLICE_ROWS).to_pylist())], pa.bool_())

        leaked = F.arrow_udf(run, "boolean", ArrowUDFType.SCALAR_ITER).asNondeterministic()
        clean = clean.where(~leaked(F.col(text)))
    return clean
