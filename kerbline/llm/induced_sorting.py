"""Suffix arrays with common prefixes by induced sorting, over queues that can lie on disk.

The suffixes of a text are of two kinds: those less than the suffix after them, and those greater. Those of the first kind
that follow one of the second are the seeds. Once the seeds are in order, a scan in ascending order induces all greater
suffixes and a scan in descending order all lesser ones: the suffix before the one that is read goes into the queue of its
first symbol. A queue is a priority queue whose keys are (first symbol, order of arrival); as arrivals come in order, each
symbol is a region of known size that is filled front to back and read once. The seeds are sorted by the same two
scans, named, and the text of names is sorted recursively where names repeat.

With each tuple goes the length of the prefix it shares with the tuple before: one more than the least along the read
tuples between their origins. Seeds get theirs from the recursion (names in common) and the symbols behind. Lengths are cut at ``most``.

Symbols are handled in ranges within which nothing is induced but repetitions of one symbol, so that each range is a few
array operations, also where the names are many.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class Scratch:
    """Arrays in memory up to a number of bytes, beyond that in files without a name, which go with the task."""

    def __init__(self, in_memory: int = 256 << 20):
        self.left = in_memory

    def array(self, size: int, kind) -> np.ndarray:
        bytes_ = size * np.dtype(kind).itemsize
        if bytes_ <= self.left or not size:
            self.left -= bytes_
            return np.zeros(size, kind)
        # Beside Spark's own spills.
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
            file.truncate(bytes_)
            return np.memmap(file, kind, "r+", shape=(size,))


class BucketQueue:
    """Tuples (place, common prefix) by (symbol, order of arrival)."""

    def __init__(self, counts: np.ndarray, scratch: Scratch):
        self.start = np.concatenate(([0], np.cumsum(counts)))
        self.end = self.start[:-1].copy()
        self.places = scratch.array(int(self.start[-1]), np.int32)
        self.shared = scratch.array(int(self.start[-1]), np.uint8)

    def push(self, symbols: np.ndarray, places: np.ndarray, shared: np.ndarray) -> None:
        """Tuples sorted by symbol, in each symbol by arrival."""
        new = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        sizes = np.diff(np.append(new, len(symbols)))
        to = np.arange(len(symbols)) + np.repeat(self.end[symbols[new]] - new, sizes)
        self.places[to], self.shared[to] = places, shared
        self.end[symbols[new]] += sizes

    def filled(self, low: int, high: int) -> np.ndarray:
        """Which places of a range hold tuples so far."""
        sizes = np.diff(self.start[low:high + 1])
        return np.arange(self.start[low], self.start[high]) < np.repeat(self.end[low:high], sizes)

    def of(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """What symbols from ``low`` up to, not including, ``high`` hold."""
        part = slice(self.start[low], self.start[high])
        return self.places[part], self.shared[part]


def ranges(first: np.ndarray, second: np.ndarray, symbols: int) -> np.ndarray:
    """Bounds of ranges of symbols such that no pair (first < second) lies within one."""
    nearest = np.full(symbols, symbols, np.int64)
    np.minimum.at(nearest, first, second)
    bounds, at, width = [0], 0, 256
    while at < symbols:
        # The next bound is where a symbol has a pair that starts at or after ``at``.
        reach = np.minimum.accumulate(nearest[at:at + width])
        inside = np.arange(at, at + len(reach))
        stop = np.flatnonzero(np.minimum(reach, symbols) <= inside)
        if len(stop):
            at = int(inside[stop[0]])
        elif at + len(reach) >= symbols:
            at = symbols
        else:
            width *= 2
            continue
        bounds.append(at)
    return np.array(bounds)


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low + 1 .. high]`` for each pair low < high."""
    out = np.empty(len(low), values.dtype)
    length = high - low
    level, table = 0, values
    todo = np.flatnonzero(length >= 1)
    power = np.frexp(length.astype(np.float64))[1] - 1
    for level in range(int(power[todo].max()) + 1 if len(todo) else 0):
        if level:
            half = 1 << (level - 1)
            table = np.minimum(table[:-half], table[half:])
        now = todo[power[todo] == level]
        out[now] = np.minimum(table[low[now] + 1], table[high[now] - (1 << level) + 1])
    return out


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share, from a number known to be shared on, cut at ``most``."""
    shared = np.minimum(known, most).astype(np.int64)
    todo = np.flatnonzero(shared < most)
    while len(todo):
        x, y = a[todo] + shared[todo], b[todo] + shared[todo]
        inside = np.maximum(x, y) < len(text)
        todo, x, y = todo[inside], x[inside], y[inside]
        todo = todo[text[x] == text[y]]
        shared[todo] += 1
        todo = todo[shared[todo] < most]
    return shared.astype(np.uint8)


def induce(text: np.ndarray, symbols: int, given: np.ndarray, given_shared: np.ndarray, most: int, scratch: Scratch):
    """The suffixes greater than the one after them, in order, each with what it shares with the one before of its first symbol.

    ``given`` are the other suffixes that induce, in order. Both kinds are read, symbol by symbol, and each read suffix puts
    the one before it into its queue if that one begins with a greater symbol.
    """
    greater = np.flatnonzero(kinds(text))
    queue = BucketQueue(np.bincount(text[greater], minlength=symbols), scratch)
    first = text[given]
    begin = np.searchsorted(first, np.arange(symbols + 1))
    falls = np.flatnonzero(text[:-1] > text[1:])
    bounds = ranges(text[falls + 1], text[falls], symbols)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        # Repetitions: a suffix with its own first symbol before it puts that one behind in the same queue.
        own, shared = queue.of(low, high)
        several = high - low > 1
        if several:
            filled = queue.filled(low, high)
            own, shared = own[filled], shared[filled]
        else:
            size = int(queue.end[low] - queue.start[low])
            own, shared = own[:size], shared[:size]
        step, grown = 0, len(own)
        while len(own):
            again = np.flatnonzero(text[own - 1] == text[own]) if own.min() > 0 else np.flatnonzero((own > 0) & (text[own - 1] == text[own]))
            if not len(again):
                break
            step += 1
            own, shared = _before(text[own[again]], own[again], shared, again, min(step, most), most)
            queue.push(text[own], own, shared)
            grown += len(own)
        if step or not several:
            own, shared = queue.of(low, high)
        else:
            own, shared = queue.of(low, high)[0][filled], queue.of(low, high)[1][filled]
        more, more_shared = given[begin[low]:begin[high]], given_shared[begin[low]:begin[high]]
        n = len(own)
        if len(more):
            own, shared = np.concatenate((own, more)), np.concatenate((shared, more_shared))
            if n and several:
                order = np.argsort(text[own], kind="stable")
                own, shared = own[order], shared[order]
                behind = order >= n
            else:
                behind = np.arange(len(own)) >= n
            met = np.flatnonzero(behind[1:] & ~behind[:-1] & (text[own[1:]] == text[own[:-1]])) + 1 if n and most else ()
            if len(met):
                shared[met] = common(text, own[met - 1], own[met], np.ones(len(met), np.int64), most)
        if not len(own):
            continue
        here = text[own]
        if several and most:
            shared = np.where(np.concatenate(([True], here[1:] != here[:-1])), 0, shared).astype(np.uint8)
        ahead = text[own - 1]
        rising = np.flatnonzero((ahead > here) & (own > 0))
        if len(rising):
            order = np.argsort(ahead[rising], kind="stable")
            rising = rising[order]
            places, nearer = _before(ahead[rising], own[rising], shared, rising, min(1, most), most)
            queue.push(ahead[rising], places, nearer)
    return queue


def _before(symbols, origins, shared, spots, start: int, most: int):
    """The suffixes before ``origins``, grouped by symbol, and what neighbours in a group share; the first of a group ``start``."""
    nearer = np.full(len(spots), start, np.uint8)
    if most:
        pairs = np.flatnonzero(symbols[1:] == symbols[:-1])
        if len(pairs):
            nearer[pairs + 1] = np.minimum(most - 1, least_between(shared, spots[pairs], spots[pairs + 1])) + 1
    return origins - 1, nearer


def kinds(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is greater than the one after it. The last symbol of a text is its least or its greatest."""
    falls = np.append(text[:-1] > text[1:], False)
    differs = np.append(text[:-1] != text[1:], True)
    # A repeated symbol is as the next other one.
    nearest = np.where(differs, np.arange(len(text), dtype=np.int32), np.int32(len(text)))
    return falls[np.minimum.accumulate(nearest[::-1])[::-1]]


def both_scans(text: np.ndarray, symbols: int, seeds: np.ndarray, shared: np.ndarray, most: int, scratch: Scratch):
    """The queues of greater and of lesser suffixes, the latter in falling order."""
    greater = induce(text, symbols, seeds, shared, most, scratch)
    turned = (symbols - 1 - text).astype(np.int32)
    falling = np.concatenate(([0], greater.shared[:0:-1])).astype(np.uint8)[:len(greater.places)]
    return greater, induce(turned, symbols, greater.places[::-1], falling, most, scratch)


def suffix_array(text: np.ndarray, most: int, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` in order, and what each shares with the one before, cut at ``most`` (255 at most).

    ``text`` holds numbers from 0 on; the last is 0 and occurs nowhere else.
    """
    scratch = scratch or Scratch()
    text = np.ascontiguousarray(text, np.int32)
    symbols = int(text.max()) + 1
    if len(text) == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    greater = kinds(text)
    seeds = (np.flatnonzero(greater[:-1] & ~greater[1:]) + 1).astype(np.int32)
    order, shared = _seeds_in_order(text, symbols, seeds, most, scratch)
    up, down = both_scans(text, symbols, order, shared, most, scratch)
    # The least suffix is induced by none.
    lesser = np.concatenate(([len(text) - 1], down.places[::-1])).astype(np.int32)
    lesser_shared = np.concatenate(([0, 0], down.shared[:0:-1])).astype(np.uint8)[:len(lesser)]
    places = np.concatenate((up.places, lesser))
    shared = np.concatenate((up.shared, lesser_shared))
    rank = np.argsort(text[places], kind="stable")
    second = (rank >= len(up.places))
    places, shared = places[rank], shared[rank]
    new = np.concatenate(([True], text[places[1:]] != text[places[:-1]]))
    met = np.flatnonzero(second[1:] & ~second[:-1] & ~new[1:]) + 1
    shared[met] = common(text, places[met - 1], places[met], np.ones(len(met), np.int64), most)
    shared[new] = 0
    return places, shared


def sort_pieces(text: np.ndarray, symbols: int, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces from seed to seed in order, and which equal the one before.

    As many symbols as fit into 64 bits are compared at once, further ones only where pieces are still alike. A piece that ends
    where another goes on is the greater one: there the other one's suffix falls and its own rises.
    """
    bits = int(symbols).bit_length()
    each = 64 // bits
    pad = (1 << bits) - 1

    def key(pieces: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(pieces), np.uint64)
        at, left = starts[pieces] + depth, lengths[pieces] - depth
        for k in range(each):
            symbol = np.where(k < left, text[np.minimum(at + k, len(text) - 1)], pad).astype(np.uint64)
            out = (out << np.uint64(bits)) | symbol
        return out

    keys = key(np.arange(len(starts)), 0)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = np.concatenate(([False], keys[1:] == keys[:-1]))
    depth = each
    # Groups of pieces that are alike so far and not at their end.
    open_ = same | np.concatenate((same[1:], [False]))
    todo = np.flatnonzero(open_ & (lengths[order] >= depth))
    while len(todo):
        group = np.cumsum(~same)[todo]
        pieces = order[todo]
        keys = key(pieces, depth)
        rank = np.lexsort((keys, group))
        order[todo], keys, group = pieces[rank], keys[rank], group[rank]
        same[todo[1:]] = (keys[1:] == keys[:-1]) & (group[1:] == group[:-1])
        depth += each
        open_ = same[todo] | np.concatenate((same[todo[1:]], [False]))
        todo = todo[open_ & (lengths[order[todo]] >= depth)]
    return order, same


def _seeds_in_order(text, symbols, seeds, most, scratch):
    """The seeds in order of their suffixes, with what neighbours share."""
    spots, same = sort_pieces(text, symbols, seeds, np.append(np.diff(seeds) + 1, 1))
    names = np.empty(len(seeds), np.int32)
    names[spots] = np.cumsum(~same) - 1
    if same.any():
        ranked, alike = suffix_array(names, most, scratch)
    else:
        ranked, alike = spots, np.zeros(len(spots), np.uint8)
    # Names in common are that many seeds further; behind them the symbols are compared.
    further = np.minimum(ranked + alike, len(seeds) - 1)
    order = seeds[ranked].astype(np.int32)
    known = seeds[further].astype(np.int64) - order
    shared = np.zeros(len(order), np.uint8)
    if most and len(order) > 1:
        shared[1:] = common(text, order[:-1], order[1:], np.minimum(known[1:], most), most)
    return order, shared
