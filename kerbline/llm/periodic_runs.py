"""Periodic runs: stretches of words that repeat with a short period, found by an online sparse diagonal DP.

A diagonal is a lag; it is active while words that far apart are equal. Words are read from left to right. A word whose
context of ``CONTEXT`` words occurred before activates the lags of those occurrences; each further equal word lengthens the
match of an active lag by one, and the first unequal word ends it. A diagonal that ends long enough emits its run at once.

Three observations keep the active lags few in any text without losing a run:

* Every run matches for ``CONTEXT`` words, and from lag 3 on its last word has its context twice before, one and two lags
  back. So lags are taken from repeated contexts and not from repeated words. A lag that is taken late is traced back.
* Inside an established run of period p, lags of p and more can't make another run, or make it also outside (two periods
  within p + q words share their divisor), where the lag is taken.
* A lag whose run could not reach the length any more before the text ends is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kerbline.llm.texts import map_rows, words_of

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of context; a run of LEAST_WORDS words matches at lag 1 for one word less.
CONTEXT = LEAST_WORDS - 1
#: Fewer earlier places than this are looked through one by one.
FEW = 32

Run = tuple[int, int, int]  # start, length, period


def numbered(words: Sequence[str]) -> list[int]:
    """Equal numbers for equal words."""
    number: dict[str, int] = {}
    return [number.setdefault(w, len(number)) for w in words]


class Contexts:
    """The places whose context occurs more than once, and for each the earlier ones of the same context."""

    def __init__(self, ids: list[int]):
        x = np.asarray(ids, np.uint64)
        code = np.zeros(len(x) - CONTEXT + 1, np.uint64)
        for k in range(CONTEXT):
            code = code * np.uint64(0x9E3779B97F4A7C15) + x[k:k + len(code)] + np.uint64(1)
            code ^= code >> np.uint64(29)
        # Contexts that share a code by chance cost a comparison and nothing else.
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        self.places: list[int] = []
        if not same.any():
            return
        new = np.concatenate(([True], ~same))
        shared = new & np.concatenate((same, [False])) | ~new
        # Groups of equal contexts, one after another, each in order of place.
        self.sorted = order[shared] + (CONTEXT - 1)
        starts = np.flatnonzero(new[shared])
        group = np.cumsum(new[shared]) - 1
        by_place = np.argsort(self.sorted)
        self.places = self.sorted[by_place].tolist()
        self.first, self.spot = starts[group[by_place]].tolist(), by_place.tolist()
        self.group = np.full(len(ids), -1, np.int64)
        self.group[self.sorted] = group
        self.listed, self.numbers = self.sorted.tolist(), self.group.tolist()

    def earlier(self, k: int, i: int, longest: int, established: list[tuple[int, int]]) -> list[int]:
        """Places that may lie one period before ``i``, the ``k``-th place, at lags up to ``longest``, the nearest first.

        At lags from 3 on the context must occur once more as far back. For each established (period, since), in order of period,
        places from ``since`` on at lags of the period and more are left out.
        """
        listed, start, end = self.listed, self.first[k], self.spot[k]
        low = bisect_left(listed, i - longest, start, end)
        kept, high, since = [], end, i
        for q, s in established:
            edge = max(low, bisect_right(listed, i - q, start, end))
            kept.append((edge, min(high, bisect_left(listed, since, start, end))))
            high, since = edge, min(since, s)
        kept.append((low, min(high, bisect_left(listed, since, start, end))))
        if sum(max(0, b - a) for a, b in kept) < FEW:
            group = self.numbers
            return [j for a, b in kept for j in reversed(listed[a:b]) if i - j < 3 or 2 * j >= i and group[2 * j - i] == group[i]]
        before = np.concatenate([self.sorted[a:b] for a, b in reversed(kept) if a < b])
        again = 2 * before - i
        found = (before >= i - 2) | ((again >= 0) & (self.group[np.maximum(again, 0)] == self.group[i]))
        return before[found][::-1].tolist()


def is_primitive(ids: list[int], start: int, period: int) -> bool:
    """Whether the first period of a run is not itself a repetition; any smaller period of the run would divide it."""
    return not any(period % p == 0 and ids[start:start + period - p] == ids[start + p:start + period]
                   for p in range(1, period // 2 + 1))


def find_runs(ids: list[int]) -> Iterator[Run]:
    """Start, length and smallest period of every maximal run, as soon as it has ended."""
    n = len(ids)
    if n < LEAST_WORDS:
        return
    active: dict[int, int] = {}  # lag: first word of the stretch
    at = -1

    def ended(lag: int, start: int, end: int) -> Iterator[Run]:
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * lag) and is_primitive(ids, start, lag):
            yield start, end - start, lag

    contexts = Contexts(ids)
    longest = n // LEAST_PERIODS
    for k, i in enumerate(contexts.places):
        # Words without a repeated context only end what is active.
        while active and at + 1 < i:
            at += 1
            for lag in [q for q in active if ids[at] != ids[at - q]]:
                yield from ended(lag, active.pop(lag), at)
        at = i
        for lag in [q for q in active if ids[i] != ids[i - q]]:
            yield from ended(lag, active.pop(lag), i)
        established = sorted((q, s) for q, s in active.items() if i + 1 - s >= max(LEAST_WORDS, LEAST_PERIODS * q))
        for j in contexts.earlier(k, i, longest, established):
            lag = i - j
            if lag in active or ids[i] != ids[j]:
                continue
            first = i
            while first > lag and ids[first - 1] == ids[first - 1 - lag]:
                first -= 1
            if n - (first - lag) >= LEAST_PERIODS * lag:
                active[lag] = first - lag
    while active and at + 1 < n:
        at += 1
        for lag in [q for q in active if ids[at] != ids[at - q]]:
            yield from ended(lag, active.pop(lag), at)
    for lag, start in active.items():
        yield from ended(lag, start, n)


def kept_words(words: Sequence[str], runs: Sequence[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    change = [0] * (len(words) + 1)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    depth, kept = 0, []
    for word, step in zip(words, change):
        depth += step
        if not depth:
            kept.append(word)
    return kept


def damaged(words: list[str], key: int | None) -> list[str]:
    """The words as the query takes them: of about every tenth document the end repeats. Without a key nothing changes."""
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapse_runs(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every periodic run cut to its first period, and ``runs`` (array of start, length, period) at the end.

    Only texts with a run change: their words come joined by one space, and ``length``, if there is such a column, is brought up
    to date. Null texts stay null without runs, empty ones empty; repeated rows give repeated results, null keys are no
    matter, an empty table stays empty. A column called like the new one is replaced.
    """
    columns = [c for c in docs.columns if c != "runs"]
    place, size = columns.index(text), columns.index(length) if length in columns else None

    def start():
        def handle(rows):
            for row in rows:
                words = words_of(row[place])
                runs = sorted(find_runs(numbered(words)), key=lambda r: (r[0], r[2]))
                if runs:
                    row = list(row)
                    row[place] = " ".join(kept_words(words, runs))
                    if size is not None:
                        row[size] = len(row[place])
                yield *row, [dict(zip(("start", "length", "period"), r)) for r in runs]
        return handle

    # Through Python the columns go by number, as names may hold dots.
    kept = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{k}") for k, c in enumerate(columns)])
    kinds = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(kept.schema)]
    return map_rows(kept, ", ".join([*kinds, "runs array<struct<start:bigint,length:bigint,period:bigint>>"]), start).toDF(*columns, "runs")


def run_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the runs of its words, damaged by ``damaged``: number, longest run, and digests of runs and kept words.

    Null and empty texts have no words and no runs: nulls for the longest run, and the digests of the empty string.
    """
    def start():
        def handle(rows):
            for name, t in rows:
                words = damaged(words_of(t), name)
                runs = sorted(find_runs(numbered(words)), key=lambda r: (r[0], r[2]))
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                written = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
                kept = " ".join(kept_words(words, runs) if runs else words)
                yield (name, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                       hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
        return handle

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), f"`{key}` {kind}, n_runs bigint, start bigint, length bigint, period bigint, "
                    "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string", start)
