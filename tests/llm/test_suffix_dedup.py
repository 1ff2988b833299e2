import hashlib
import random

import numpy as np
import pytest

from kerbline.llm import induced_sorting as sort, queries, suffix_dedup as sd
from tests.conftest import SMALL
from tests.llm.fixtures import ODD, docs, prose


def plain_suffixes(text, most):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        shared.append(min(n, most))
    return order, shared


@pytest.mark.parametrize("in_memory", [0, 1 << 20])
def test_suffix_array_equals_sorting(in_memory):
    r = random.Random(4)
    for _ in range(400):
        alphabet = r.choice([1, 2, 3, 6, 60])
        block = [r.randint(1, alphabet) for _ in range(r.randint(1, 12))]
        text = block * r.randint(0, 7) + [r.randint(1, alphabet) for _ in range(r.randint(0, 60))] + block * r.randint(0, 4) + [0]
        most = r.choice([3, 50, 200])
        places, shared = sort.suffix_array(np.array(text), most, sort.Scratch(in_memory))
        assert (places.tolist(), shared.tolist()) == plain_suffixes(text, most), text


def test_queues_beyond_the_memory_are_files():
    scratch = sort.Scratch(100)
    assert isinstance(scratch.array(1000, np.int32), np.memmap) and not isinstance(scratch.array(10, np.int32), np.memmap)


def test_every_window_has_its_anchor_wherever_it_stands():
    r = random.Random(2)
    body = bytes(r.choice(b"abc ") for _ in range(400))
    seen = {}
    for texts in ([body], [b"x" * 60, b"y" * 37 + body[100:300], b"short", body[50:120] * 3], [b"a" * 500, b"ab" * 100]):
        for at, _, text, hashes, first, last in sd.anchors(texts):
            for t, h, p, q in zip(text.tolist(), hashes.tolist(), first.tolist(), last.tolist()):
                for w in range(p, q + 1):
                    window = texts[at + t][w:w + sd.SPAN]
                    assert len(window) == sd.SPAN and seen.setdefault(window, h) == h
            covered = sorted((t, w) for t, p, q in zip(text.tolist(), first.tolist(), last.tolist()) for w in range(p, q + 1))
            assert covered == [(t, w) for t in range(len(texts)) for w in range(len(texts[t]) - sd.SPAN + 1)]


def brute(rows, span=50):
    least = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - span + 1) if key is not None else ():
            least[data[i:i + span]] = min(key, least.get(data[i:i + span], key))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        covered = bytearray(b" " * len(data))
        for i in range(len(data) - span + 1) if key is not None else ():
            if least[data[i:i + span]] < key:
                covered[i:i + span] = b"x" * span
        kept = bytes(c for c, x in zip(data, covered) if x == 32)
        out.append((key, len(data), covered.count(b"x"), len(bytes(covered).split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def awkward():
    shared = prose(1, 60)
    rows = [(i, prose(i, 20) + shared[i % 3:] + prose(i + 100, 20)) for i in range(30, 60)]
    rows += [(i, prose(7, 80)) for i in range(60, 80)]
    rows += [(9, prose(7, 80)), (9, prose(8, 40)), (9, prose(7, 80)[:200]), (None, prose(7, 80)), (-4, prose(8, 40)[40:140])]
    rows += [(1000, "a" * 3000), (1001, "a" * 60 + "b" * 70), (1002, "é日" * 200), (1003, "日é" * 100), (1004, "x" * 49), (1005, "x" * 50), (1006, "x" * 50)]
    return rows + [r for r in ODD if r[0] != 5] + [(5, "word " * 600)]


@pytest.mark.parametrize("least_hot, pieces", [(50_000, 1 << 20), (3, 2000)])
def test_removal_equals_brute_force(spark, monkeypatch, least_hot, pieces):
    monkeypatch.setattr(sd, "LEAST_HOT", least_hot)
    monkeypatch.setattr(sd, "HOT", 10**9)
    for name, size in (("GROUP_BYTES", pieces * 4), ("BUCKET_ANCHORS", pieces), ("SHARD_SEGMENTS", pieces // 4), ("HELD_ANCHORS", pieces)):
        monkeypatch.setattr(sd, name, size)
    found = sd.remove_repeats(docs(spark, awkward())).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute(awkward())
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_spans == len(r.spans) for r in found)


def test_query_equals_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op12_suffix_dedup"](spark, SMALL).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(given)


def test_empty_table(spark):
    assert sd.remove_repeats(docs(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in sd.remove_repeats(docs(spark, [(1, "short")])).collect()] == [(1, 5, 0, 0)]
