"""Removal of byte strings that an earlier document holds, by sorted suffixes of shards.

A string of ``SPAN`` bytes is removed if it also starts in a document of a smaller key. No document needs to meet all
others for that: each window of SPAN bytes has an anchor, the string of ``GRAM`` bytes in it whose hash is least, and equal
windows have equal anchors.

1. Anchors of all texts are counted by buckets of their hash. Only windows at anchors of two documents go on. A part of a
   text as large as a task's memory allows sends each anchor on once if it already sees it in two documents.
2. The windows of one anchor in one text lie side by side and make a segment of at most 2 SPAN - GRAM bytes. Segments go to the shard of
   their anchor's hash; of equal segments that meet in one task only the one of least key does, the others are removed at once. Anchors
   with more than a share of ``1 / HOT`` of all occurrences (there are at most HOT) and more than LEAST_HOT send each window by itself, to the shard of the window's hash.
3. A shard's suffixes are sorted, with the prefixes they share, by induced sorting over queues that go to disk when the
   shard is large (``induced_sorting``). Windows that share SPAN bytes are neighbours: the least key of each class stays.
4. What is removed goes back to the documents by groups of key hashes.

Anchors and segments travel in packed arrays, one row for each task and bucket. The texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.llm.induced_sorting import Scratch, suffix_array
from kerbline.operators.store import materialize

SPAN, GRAM = 50, 20
#: Share of the occurrences above which an anchor counts as hot, and so the most there can be.
HOT, LEAST_HOT = 100_000, 50_000
#: Bytes of text of a group of documents, anchors of a bucket, and segments of a shard, in expectation.
GROUP_BYTES, BUCKET_ANCHORS, SHARD_SEGMENTS = 4 << 20, 500_000, 40_000
#: Anchors and segment bytes that a task holds back before it sends them.
HELD_ANCHORS, HELD_BYTES = 1_500_000, 24 << 20
#: Bytes that are hashed at once; a longer text is taken by itself.
SLICE_BYTES = 4 << 20
MEMORY = 192 << 20
BASE = 0x9E3779B97F4A7C15
PLACE_BITS = 24


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, put together from hashes of powers of two."""
    def power(n):
        return np.uint64(pow(BASE, n, 1 << 64))
    parts = {1: data.astype(np.uint64) + np.uint64(1)}
    n = 1
    while 2 * n <= GRAM:
        h = parts[n]
        parts[2 * n] = h[:-n] * power(n) + h[n:]
        n *= 2
    whole, size = parts[n], n
    for k in sorted(parts, reverse=True):
        if size + k <= GRAM:
            rest = parts[k][size:]
            whole = whole[:len(rest)] * power(k) + rest[:len(whole)]
            size += k
    x = whole ^ (whole >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of texts: its first text, its end, and for each anchor its text, hash, first and last window (in the text)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end, *_anchors_of(texts[at:end])
        at = end


def _anchors_of(texts: list[bytes]):
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < SPAN or not (lengths >= SPAN).any():
        return none, none.view(np.uint64), none, none
    hashes = _gram_hashes(data)
    width = SPAN - GRAM + 1
    anchor = np.empty(len(data) - SPAN + 1, np.int64)
    # Places get PLACE_BITS bits beside the hash; longer data goes in overlapping stretches.
    stretch = (1 << PLACE_BITS) - width
    for low in range(0, len(anchor), stretch):
        part = hashes[low:low + stretch + width - 1]
        key = (part >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            key = np.minimum(key[:-n], key[n:])
            n *= 2
        if n < width:
            key = np.minimum(key[:n - width], key[width - n:])
        anchor[low:low + len(key)] = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + low
    text = np.repeat(np.arange(len(texts)), lengths)[:len(anchor)]
    window = np.arange(len(anchor))
    inside = window - starts[text] <= lengths[text] - SPAN
    window, text = window[inside], text[inside]
    anchor = anchor[window]
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
    first, last = np.concatenate(([0], change)), np.concatenate((change, [len(window)])) - 1
    text = text[first]
    return text, hashes[anchor[first]], window[first] - starts[text], window[last] - starts[text]


def _packed(sort_by: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(value, packed columns) for each value of ``sort_by``."""
    order = np.argsort(sort_by, kind="stable")
    values = sort_by[order]
    new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else []
    sorted_ = [c[order] for c in columns]
    for low, high in zip(new, [*new[1:], len(values)]):
        yield int(values[low]), *(c[low:high].tobytes() for c in sorted_)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > 8 << 20 or len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _schema(*fields: tuple[str, pa.DataType]) -> tuple[pa.Schema, str]:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return pa.schema(fields), ", ".join(f"{n} {names[t]}" for n, t in fields)


PACKED, PACKED_DDL = _schema(("bucket", pa.int32()), ("known", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()),
                             ("numbers", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()))
SHARED, SHARED_DDL = _schema(("grp", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("numbers", pa.binary()), ("hot", pa.binary()))
SEGMENTS, SEGMENTS_DDL = _schema(("shard", pa.int32()), ("known", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()),
                                 ("firsts", pa.binary()), ("lengths", pa.binary()), ("hashes", pa.binary()), ("data", pa.binary()))
REMOVED, REMOVED_DDL = _schema(("grp", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("firsts", pa.binary()), ("counts", pa.binary()))


def _group_of(tags: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a tag belongs to."""
    return (tags % groups).astype(np.int32)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes * np.uint64(BASE) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _send_anchors(groups: int, buckets: int):
    def send(docs, tags, numbers, hashes):
        order = np.lexsort((tags, docs, hashes))
        docs, tags, numbers, hashes = docs[order], tags[order], numbers[order], hashes[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(hashes)))
        shared = docs[first] != docs[first + size - 1]
        known = np.repeat(shared, size)
        counts = np.ones(len(hashes), np.int32)
        # Of what is known to be shared, one occurrence stands for all and another one vouches for it.
        ends = np.concatenate((first[shared], (first + size - 1)[shared]))
        counts[first[shared]] = size[shared]
        counts[(first + size - 1)[shared]] = 0
        asked = np.concatenate((np.flatnonzero(~known), ends))
        for row in _packed(_bucket_of(hashes[asked], buckets), docs[asked], tags[asked], np.where(known[asked], np.int32(-1), numbers[asked]),
                           hashes[asked], counts[asked]):
            yield row[0], 0, *row[1:]
        told = np.flatnonzero(known)
        for row in _packed(_group_of(tags[told], groups), docs[told], tags[told], numbers[told]):
            yield row[0], 1, *row[1:], b"", b""

    def rows(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            docs, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            for at, _, text, hashes, _, _ in anchors(_texts(batch, "text")):
                number = np.arange(len(text)) - np.searchsorted(text, text)
                held.append((docs[text + at], tags[text + at], number.astype(np.int32), hashes))
                size += len(text)
                if size >= HELD_ANCHORS:
                    yield from send(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield from send(*map(np.concatenate, zip(*held)))

    return lambda batches: _batches(rows(batches), PACKED)


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _find_shared(groups: int, least_hot: int):
    """Of a bucket of anchors those of two documents, by group of documents; and the hot ones. What is known is passed on."""
    def find(table: pa.Table) -> pa.Table:
        rows = []
        if table.column("known")[0].as_py():
            rows = [(r["bucket"], r["docs"], r["tags"], r["numbers"], b"") for r in table.select(["bucket", "docs", "tags", "numbers"]).to_pylist()]
        else:
            docs, tags, numbers, hashes, counts = (_joined(table, c, k) for c, k in zip(
                ("docs", "tags", "numbers", "hashes", "counts"), (np.int64, np.int64, np.int32, np.uint64, np.int32)))
            order = np.lexsort((docs, hashes))
            hashes = hashes[order]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            size = np.diff(np.append(first, len(hashes)))
            sorted_docs = docs[order]
            shared = np.repeat(sorted_docs[first] != sorted_docs[first + size - 1], size)
            hot = first[np.add.reduceat(counts[order].astype(np.int64), first) >= least_hot]
            told = order[shared & (numbers[order] >= 0)]
            rows = [(*row, b"") for row in _packed(_group_of(tags[told], groups), docs[told], tags[told], numbers[told])]
            if len(hot):
                rows.append((-1, b"", b"", b"", hashes[hot].tobytes()))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SHARED)], schema=SHARED)]
                                     if rows else [], SHARED)
    return find


def _send_segments(groups: int, shards: int, hot: np.ndarray):
    """The segments of a group of documents at its shared anchors; of equal ones the least key's."""
    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        docs, tags, numbers = (_joined(right, c, k) for c, k in zip(("docs", "tags", "numbers"), (np.int64, np.int64, np.int32)))
        wanted: dict[tuple, np.ndarray] = {}
        order = np.lexsort((numbers, tags, docs))
        docs, tags, numbers = docs[order], tags[order], numbers[order]
        new = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])))) if len(docs) else []
        for low, high in zip(new, [*new[1:], len(docs)]):
            wanted[int(docs[low]), int(tags[low])] = numbers[low:high]
        # Repeated rows are sent once; a row of the same key and another text has another tag.
        own = {(d, g): t for d, g, t in zip(left.column("doc").to_pylist(), left.column("tag").to_pylist(), _texts(left, "text"))
               if (d, g) in wanted}
        pairs, texts = list(own), list(own.values())
        kept: dict[bytes, list] = {}
        removed: list[tuple] = []
        for at, end, text, hashes, first, last in anchors(texts):
            bounds = np.searchsorted(text, np.arange(end - at + 1))
            for k in range(end - at):
                pair = pairs[at + k]
                picked = bounds[k] + wanted[pair]
                body = texts[at + k]
                is_hot = np.isin(hashes[picked], hot).tolist() if len(hot) else [False] * len(picked)
                for h, p, q, each in zip(hashes[picked].tolist(), first[picked].tolist(), last[picked].tolist(), is_hot):
                    for a, b in ([(w, w) for w in range(p, q + 1)] if each else [(p, q)]):
                        data = body[a:b + SPAN]
                        entry = (*pair, a)
                        shard = hashlib.blake2b(data, digest_size=8).digest() if each else h
                        known = kept.setdefault((shard, data), [])
                        if not known or known[0][0] == pair[0]:
                            known.append(entry)
                        elif known[0][0] < pair[0]:
                            removed.append((*entry, b - a + 1))
                        else:
                            removed += [(*e, b - a + 1) for e in known]
                            kept[shard, data] = [entry]
        rows: list[tuple] = []
        if kept:
            entries = [(int.from_bytes(s, "little") if isinstance(s, bytes) else s, e, d) for (s, d), es in kept.items() for e in es]
            shard = _bucket_of(np.array([s for s, _, _ in entries], np.uint64), shards)
            order = np.argsort(shard, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], shard[order][1:] != shard[order][:-1])))
            for low, high in zip(new, [*new[1:], len(order)]):
                part = [entries[i] for i in order[low:high]]
                rows.append((int(shard[order[low]]), 0, np.array([e[0] for _, e, _ in part], np.int64).tobytes(),
                             np.array([e[1] for _, e, _ in part], np.int64).tobytes(), np.array([e[2] for _, e, _ in part], np.int32).tobytes(),
                             np.array([len(d) for _, _, d in part], np.int32).tobytes(), np.array([h for h, _, _ in part], np.uint64).tobytes(),
                             b"".join(d for _, _, d in part)))
        if removed:
            d, t, a, n = (np.array(c, k) for c, k in zip(zip(*removed), (np.int64, np.int64, np.int32, np.int32)))
            rows.append((int(key[0].as_py()), 1, d.tobytes(), t.tobytes(), a.tobytes(), n.tobytes(), b"", b""))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SEGMENTS)], schema=SEGMENTS)]
                                     if rows else [], SEGMENTS)
    return send


def repeated_windows(docs: np.ndarray, lengths: np.ndarray, data: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """For each byte of the joined segments whether a window that starts there, within its segment, also is in one of a smaller key."""
    ends = np.cumsum(lengths + 1) - 1
    size = len(docs)
    text = np.empty(len(data) + size + 1, np.int32)
    inside = np.ones(len(text), bool)
    inside[ends] = inside[-1] = False
    # Ends of segments are all different and less than any byte.
    text[inside] = data.astype(np.int32) + size + 1
    text[ends], text[-1] = np.arange(1, size + 1), 0
    places, shared = suffix_array(text, SPAN, Scratch(memory))
    segment = np.repeat(np.arange(size + 1), np.append(lengths + 1, 1)).astype(np.int32)
    open_ = np.zeros(len(text), bool)
    open_[:len(text) - SPAN] = segment[SPAN - 1:-1] == segment[:len(text) - SPAN]
    open_[:len(text) - SPAN] &= inside[SPAN - 1:-1]
    first = np.flatnonzero(shared < SPAN)
    key = np.append(docs, np.iinfo(np.int64).max)[segment[places]]
    valid = open_[places]
    least = np.minimum.reduceat(np.where(valid, key, np.iinfo(np.int64).max), first)
    out = np.zeros(len(text), bool)
    out[places] = valid & (key > np.repeat(least, np.diff(np.append(first, len(places)))))
    return out[inside]


def _contents(table: pa.Table) -> tuple:
    """The different segments of a shard, their least keys, and for each entry its segment."""
    data, lengths = b"".join(table.column("data").to_pylist()), _joined(table, "lengths", np.int32)
    number: dict[tuple, int] = {}
    segment = np.empty(len(lengths), np.int64)
    at = 0
    for k, (h, n) in enumerate(zip(_joined(table, "hashes", np.uint64).tolist(), lengths.tolist())):
        segment[k] = number.setdefault((h, data[at:at + n]), len(number))
        at += n
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, segment, _joined(table, "docs", np.int64))
    anchor = np.array([h for h, _ in number], np.uint64)
    return [d for _, d in number], anchor, least, segment


def may_share(anchor: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which segments can share a window with another one of their anchor.

    A window holds half of its bytes beside the anchor, or more, on one side of it: segments that share one also share the
    gram that ends there. Segments in which the anchor's hash does not occur, which are windows of hot anchors, always may.
    """
    half = (SPAN - GRAM) // 2
    starts = np.cumsum(sizes) - sizes
    hashes = _gram_hashes(data)
    segment = np.repeat(np.arange(len(sizes)), sizes)[:len(hashes)]
    hits = np.flatnonzero(hashes == anchor[segment])
    hits = hits[hits - starts[segment[hits]] <= sizes[segment[hits]] - GRAM]
    own, first = np.unique(segment[hits], return_index=True)
    place = hits[first]
    out = np.ones(len(sizes), bool)
    out[own] = False
    for gram, inside in ((place + half, place + half + GRAM <= starts[own] + sizes[own]), (place - half, place - half >= starts[own])):
        side = own[inside]
        met = hashes[gram[inside]] ^ (anchor[side] * np.uint64(BASE))
        _, kind, count = np.unique(met, return_inverse=True, return_counts=True)
        out[side[count[kind] > 1]] = True
    return out


def _sort_shard(groups: int):
    """What a shard removes, as runs of windows, by group of documents.

    Equal segments go into the order once, with their least key. A segment that can't share a window with a different one
    has its entries of greater keys removed whole without being sorted.
    """
    def sort(table: pa.Table) -> pa.Table:
        docs, tags, firsts, lengths = (_joined(table, c, k) for c, k in zip(
            ("docs", "tags", "firsts", "lengths"), (np.int64, np.int64, np.int32, np.int32)))
        if not table.column("known")[0].as_py():
            contents, anchor, least, segment = _contents(table)
            order = np.argsort(anchor, kind="stable")
            alike = anchor[order[1:]] == anchor[order[:-1]]
            met = order[np.concatenate((alike, [False])) | np.concatenate(([False], alike))]
            runs: dict[int, list] = {}
            if len(met):
                met = met[may_share(anchor[met], np.array([len(contents[k]) for k in met]), np.frombuffer(b"".join(contents[k] for k in met), np.uint8))]
            if len(met):
                sizes = np.array([len(contents[k]) for k in met])
                found = repeated_windows(least[met], sizes, np.frombuffer(b"".join(contents[k] for k in met), np.uint8))
                edge = np.diff(np.concatenate(([0], found.view(np.int8), [0])))
                starts = np.cumsum(sizes) - sizes
                for low, high in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    k = int(np.searchsorted(starts, low, "right")) - 1
                    runs.setdefault(int(met[k]), []).append((low - int(starts[k]), high - low))
            whole = docs > least[segment]
            entries, offsets, counts = [np.flatnonzero(whole)], [np.zeros(whole.sum(), np.int64)], [lengths[whole] - SPAN + 1]
            partly = [(e, *r) for e in np.flatnonzero(~whole & np.isin(segment, list(runs))).tolist() for r in runs[int(segment[e])]]
            if partly:
                for into, column in zip((entries, offsets, counts), zip(*partly)):
                    into.append(np.array(column))
            entry, offset, lengths = (np.concatenate(x) for x in (entries, offsets, counts))
            docs, tags, firsts, lengths = docs[entry], tags[entry], (firsts[entry] + offset).astype(np.int32), lengths.astype(np.int32)
        rows = list(_packed(_group_of(tags, groups), docs, tags, firsts, lengths))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), REMOVED)], schema=REMOVED)]
                                     if rows else [], REMOVED)
    return sort


def spans_of(length: int, firsts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows starting at ``firsts`` and the ``counts - 1`` places behind cover."""
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, firsts, 1)
    np.add.at(change, firsts + counts + SPAN - 1, -1)
    covered = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False])).view(np.int8)
    edge = np.diff(covered)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _digests(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    docs, tags, firsts, counts = (_joined(right, c, k) for c, k in zip(("docs", "tags", "firsts", "counts"), (np.int64, np.int64, np.int32, np.int32)))
    order = np.lexsort((tags, docs))
    pairs = np.stack((docs[order], tags[order]), 1)
    new = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))) if len(order) else []
    place = {tuple(pairs[low].tolist()): order[low:high] for low, high in zip(new, [*new[1:], len(order)])}
    for doc, tag, text in zip(left.column("doc").to_pylist(), left.column("tag").to_pylist(), _texts(left, "text")):
        own = place.get((doc, tag))
        yield doc, text, spans_of(len(text), firsts[own], counts[own]) if own is not None else []


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of start and end, in bytes).

    ``key`` is a whole number. Rows of a null key remove nothing and lose nothing; rows of one key don't remove from
    each other, whatever their texts. Null texts are taken as empty; texts of fewer than SPAN bytes stay whole. Repeated
    rows give repeated results. Only the two columns are read; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    body: Column = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc"), body.alias("text"))
    size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    bytes_ = size[1] or 0
    groups, buckets = 1 + bytes_ // GROUP_BYTES, 1 + bytes_ // (BUCKET_ANCHORS * (SPAN - GRAM + 2) // 2)
    usable = rows.where(f"doc IS NOT NULL AND octet_length(text) >= {SPAN}").select("doc", F.xxhash64("doc", "text").alias("tag"), "text")

    sent = usable.mapInArrow(_send_anchors(groups, buckets), PACKED_DDL)
    least_hot = max(LEAST_HOT, -(-2 * bytes_ // (SPAN - GRAM + 2) // HOT))
    shared = materialize(sent.groupBy("bucket", "known").applyInArrow(_find_shared(groups, least_hot), SHARED_DDL), "shared-anchors")
    found = shared.agg(F.sum(F.octet_length("numbers").cast("long")) / 4).first()[0] or 0
    # At most HOT hashes.
    hot = np.frombuffer(b"".join(r.hot for r in shared.where("grp = -1").select("hot").collect()), np.uint64)
    shards = 1 + int(found) // SHARD_SEGMENTS

    grouped = usable.withColumn("grp", F.pmod("tag", F.lit(groups)).cast("int"))
    segments = grouped.groupBy("grp").cogroup(shared.where("grp >= 0").groupBy("grp")).applyInArrow(_send_segments(groups, shards, hot), SEGMENTS_DDL)
    removed = segments.groupBy("shard", "known").applyInArrow(_sort_shard(groups), REMOVED_DDL)

    target = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for doc, data, spans in _digests(left, right):
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((doc, len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(),
                        [{"start": a, "end": b} for a, b in spans]))
        columns = list(zip(*out)) or [[]] * len(target)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    ddl = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    done = grouped.groupBy("grp").cogroup(removed.groupBy("grp")).applyInArrow(finish, ddl)
    whole = rows.where(f"doc IS NULL OR octet_length(text) < {SPAN}").select(
        "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return done.unionByName(whole).withColumn("doc", F.col("doc").cast(kind)).withColumnRenamed("doc", key)
