"""Byte-level BPE: encoding through the tokenizers library over Arrow batches, and decoding back to bytes.

The rank file gives the vocabulary; the merges are recovered from the ranks, and bytes are written as the characters
of the byte table, which is the form the tokenizers library works in. Each match of the split pattern is encoded by
itself; equal ones are encoded once as long as they stay in a bounded cache. Ids and offsets therefore equal those of
an encoder that takes one match after another.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, models

from kerbline.llm.texts import map_rows

#: Bytes of chunks, ids and their objects a task remembers before it starts anew; bounds memory, never results.
CACHE_BYTES = 160_000_000
#: What Python takes for an entry beside its characters and ids.
ENTRY_BYTES = 190
#: A space before other white space or at the end. Takes more for white space than any split pattern does.
UNEVEN = re.compile(r" (?:\s|$)")


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printing}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(printing)))
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the last merge of a token joins; None where lower ranks don't lead to two parts."""
    limit = ranks[token]
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern.

    No match of the pattern goes on over a space that a word follows, and none looks back. So a text without other
    white space after its spaces falls into chunks at the spaces, each split and encoded by itself, and equal chunks
    are looked up. Any other text is split whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.chars = byte_table()
        self.split = regex.compile(pattern)
        written = {token: "".join(self.chars[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            if len(token) > 1 and (pair := _halves(token, ranks)):
                merges.append((written[pair[0]], written[pair[1]]))
        # Bytes that no UTF-8 text holds keep matches and chunks apart: no token has them.
        self.gap, self.end = max(ranks.values()) + 1, max(ranks.values()) + 2
        self.table = {b: c for b, c in enumerate(self.chars)} | {0xFE: "\n", 0xFF: "\t"}
        vocabulary = {written[t]: r for t, r in ranks.items()} | {"\n": self.gap, "\t": self.end}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self._known: dict[str, bytes] = {}
        self._held = 0

    def _encode(self, chunks: list[list[str]]) -> list[bytes]:
        """The ids of each chunk, given as its matches, as the bytes of 32-bit numbers."""
        out = []
        for at in range(0, len(chunks), 256):
            part = chunks[at:at + 256]
            raw = b"".join([b"\xfe".join([p.encode() for p in pieces]) + b"\xff" for pieces in part])
            coded = raw.decode("latin-1").translate(self.table)
            ids = np.array(self.tokenizer.encode_batch_fast([coded], add_special_tokens=False)[0].ids, np.int32)
            ids = ids[ids != self.gap]
            start = 0
            for stop in np.flatnonzero(ids == self.end).tolist():
                out.append(ids[start:stop].tobytes())
                start = stop + 1
        return out

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        """The ids of each text."""
        if self._held > CACHE_BYTES:
            self._known, self._held = {}, 0
        known = self._known
        parts = [[t] if UNEVEN.search(t) else t.split(" ") for t in texts]
        starts = self._encode([self.split.findall(first) for first, *_ in parts])
        new = [c for c in set().union(*(rest for _, *rest in parts)) if c not in known]
        coded = self._encode([self.split.findall(f" {c}") for c in new])
        known.update(zip(new, coded))
        # A string takes four bytes a character at most; what a slice of texts adds is in proportion to these.
        self._held += ENTRY_BYTES * len(new) + 4 * sum(map(len, new)) + sum(map(len, coded))
        return [np.frombuffer(start + b"".join(map(known.__getitem__, rest)), np.int32).tolist()
                for start, (_, *rest) in zip(starts, parts)]

    def said(self, ids: Sequence[int]) -> str:
        """Ids as decimal numbers joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids))

    def pieces(self, text: str) -> list[tuple[str, list[int]]]:
        """Each match of the split pattern with its ids."""
        found = self.split.findall(text)
        return [(p, np.frombuffer(i, np.int32).tolist()) for p, i in zip(found, self._encode([[p] for p in found]))]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """For each id the code points [start, end) that its bytes touch; ids that share a character overlap there."""
        spans, at = [], 0
        for piece, ids in self.pieces(text):
            place = [at + k for k, ch in enumerate(piece) for _ in ch.encode()]
            start = 0
            for i in ids:
                stop = start + len(self.bytes_of[i])
                spans.append((place[start], place[stop - 1] + 1))
                start = stop
            at += len(piece)
        return spans

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_parts(self, ids: Sequence[int]) -> list[str]:
        """The text each id completes: a character split over several ids appears with the last of them."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        parts = [decoder.decode(self.bytes_of[i]) for i in ids]
        if parts and (rest := decoder.decode(b"", True)):
            parts[-1] += rest
        return parts


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
                     with_ids: bool = True, with_offsets: bool = False) -> DataFrame:
    """Per row: key, n_tokens, digests of ids and of the decoded bytes, and on request ids and offsets.

    A null or empty text has no tokens, an empty id list and the digests of empty strings. Rows with equal or null keys
    are encoded each for themselves. Other columns are not read. The rank table is broadcast; its size is that of
    the vocabulary.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", offsets array<struct<start:int,stop:int>>" * with_offsets

    def start():
        coder = ByteBpe(shared.value, pattern)

        def handle(rows):
            for (name, _), ids in zip(rows, coder.encode_batch([t or "" for _, t in rows])):
                row = [name, len(ids), hashlib.sha256(coder.said(ids).encode()).hexdigest(),
                       hashlib.sha256(coder.decode(ids)).hexdigest()]
                if with_ids:
                    row.append(ids)
                yield tuple(row)

        def handle_with_offsets(rows):
            for row, (_, t) in zip(handle(rows), rows):
                yield (*row, [{"start": a, "stop": b} for a, b in coder.offsets(t or "")])

        return handle_with_offsets if with_offsets else handle

    return map_rows(docs.select(F.col(key), F.col(text)), schema, start)


def decode_documents(coded: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key and the text its ids spell, with the replacement character for bytes that are no UTF-8; null ids: empty."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks)
    key_type = coded.schema[key].dataType.simpleString()

    def start():
        spelled = {rank: token for token, rank in shared.value.items()}
        return lambda rows: ((name, b"".join(spelled[i] for i in found or ()).decode("utf-8", "replace"))
                             for name, found in rows)

    return map_rows(coded.select(key, ids), f"`{key}` {key_type}, text string", start)
