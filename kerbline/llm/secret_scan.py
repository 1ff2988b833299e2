"""Secret scans: fixed forms, and tokens that look random to a pair of character Markov models.

One model is of random strings, one of ordinary identifiers and words. Both are first-order chains over ASCII letters,
digits and the characters of keys, trained on labelled samples that the corpus itself gives: the values that the fixed forms
catch are random, other tokens made of words are ordinary. A token, or what a fixed form leaves of it, is a secret if its
log-likelihood ratio, in all and per character, is high enough. The counts cover the whole corpus; each task sums its own and
hands on one row per class.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kerbline.llm.texts import SLICE_ROWS, map_rows, quoted

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run is taken whole either way, so the least length can stand in the expression.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: Characters of the shortest token that is scored.
SHORTEST = 10
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: What an ordinary token is made of: words in lower case, capitalised or in capitals, and a number at the end.
ORDINARY = re.compile(r"[A-Z]?[a-z]++(?:[_-]?[A-Z][a-z]{2,}+|[_-][a-z]{2,}+)*+[_-]?[0-9]{0,4}|[A-Z]{2,}+(?:[_-][A-Z]{2,}+)*+[_-]?[0-9]{0,4}")
WIDTH = len(ALPHABET) + 1  # and the start
CODE = np.full(128, WIDTH - 1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Log-likelihood ratio that a secret reaches: in all, and per character.
LEAST_RATIO, LEAST_PER_CHARACTER = 12.0, 0.6

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Start, end and kind of what the fixed forms match; each kind from left to right without overlaps."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def values(text: str) -> list[str]:
    """What the fixed forms hold as secrets: the value of an assignment without its keyword, keys as a whole."""
    assigned = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    return assigned + [text[a:b] for a, b, kind in base_spans(text) if kind != "assign"]


def free_tokens(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Tokens outside the spans, which are in order of their starts. What a span leaves of a token is a token itself."""
    found, nth = [], 0
    for m in TOKEN.finditer(text):
        at, end = m.span()
        while nth < len(taken) and taken[nth][0] < end:
            start, stop, _ = taken[nth]
            if start - at >= SHORTEST:
                found.append((at, start))
            at = max(at, stop)
            if stop > end:
                break  # it may cover the next token too
            nth += 1
        if end - at >= SHORTEST:
            found.append((at, end))
    return found


def steps(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The transitions of the tokens, one after another, as places in the flat count table, and where each token starts.

    Tokens are ASCII. After each but the last comes a step to the start of the next, which stands in the table's last column.
    """
    codes = CODE[np.frombuffer("\n".join(tokens).encode("ascii"), np.uint8)]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    return np.concatenate(([WIDTH - 1], codes[:-1])) * WIDTH + codes, lengths.cumsum() - lengths


@dataclass(frozen=True)
class Ratio:
    """Log-likelihood ratios of the transitions, random over ordinary; 0 in the last column."""

    table: np.ndarray

    def are_random(self, tokens: list[str]) -> list[bool]:
        if not tokens:
            return []
        places, starts = steps(tokens)
        total = np.add.reduceat(self.table[places], starts)
        lengths = np.diff(starts, append=len(places) + 1) - 1
        return ((total >= LEAST_RATIO) & (total >= LEAST_PER_CHARACTER * lengths)).tolist()


def train(docs: DataFrame, text: str = "text") -> Ratio:
    """Both models from counts over all texts. Without ordinary tokens the models are alike and find nothing."""

    def tally(batches):
        sums = {"random": np.zeros(WIDTH * WIDTH, np.int64), "ordinary": np.zeros(WIDTH * WIDTH, np.int64)}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for t in filter(None, batch.column(0).slice(at, SLICE_ROWS).to_pylist()):
                    samples = {"random": values(t), "ordinary": [
                        t[a:b] for a, b in free_tokens(t, base_spans(t)) if ORDINARY.fullmatch(t, a, b)]}
                    for kind, tokens in samples.items():
                        if tokens:
                            sums[kind] += np.bincount(steps(tokens)[0], minlength=WIDTH * WIDTH)
        for counts in sums.values():
            counts[WIDTH - 1::WIDTH] = 0  # steps from one token to the next
        yield pa.RecordBatch.from_pydict({"kind": list(sums), "counts": [s.tolist() for s in sums.values()]},
                                         schema=pa.schema([("kind", pa.string()), ("counts", pa.list_(pa.int64()))]))

    parts = docs.select(quoted(text)).mapInArrow(tally, "kind string, counts array<bigint>")
    summed = parts.select("kind", F.posexplode("counts").alias("place", "n")).groupBy("kind", "place").agg(F.sum("n").alias("n"))
    # Two tables of a fixed size.
    counts = {kind: np.zeros((WIDTH, WIDTH)) for kind in ("random", "ordinary")}
    for row in summed.where("n > 0").collect():
        counts[row.kind][divmod(row.place, WIDTH)] += row.n
    table = _chances(counts["random"], 0.5, 50.0) - _chances(counts["ordinary"], 0.0, 5.0)
    table[:, WIDTH - 1] = 0.0
    return Ratio(table.ravel())


def _chances(counts: np.ndarray, even: float, weight: float) -> np.ndarray:
    """Logarithms of the transition probabilities: counts, smoothed by ``weight`` draws from the single characters.

    Of these a share ``even`` is uniform, since random strings may use characters that the samples don't show.
    """
    single = (counts.sum(0) + 1) / (counts.sum() + WIDTH)
    single = even / WIDTH + (1 - even) * single
    return np.log((counts + weight * single) / (counts.sum(1, keepdims=True) + weight))


def all_spans(text: str, ratio: Ratio) -> list[Span]:
    found = base_spans(text)
    free = free_tokens(text, found)
    random = ratio.are_random([text[a:b] for a, b in free])
    return sorted(found + [(a, b, "markov") for (a, b), is_random in zip(free, random) if is_random], key=_order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, the counts of the fixed forms, the digest of their spans, and all spans as text.

    Null and empty texts have no spans (counts 0, the digest of the empty string). Each row is scanned by itself, so
    repeated rows and null keys are no matter. Positions are code points, the end is exclusive.
    """
    ratio = train(docs, text)

    def start():
        def handle(rows):
            for name, t in rows:
                spans = all_spans(t or "", ratio)
                base = [s for s in spans if s[2] != "markov"]
                n = {kind: sum(s[2] == kind for s in base) for kind in KINDS[:3]}
                yield name, n["assign"], n["access"], n["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans)
        return handle

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(quoted(key), quoted(text)), f"`{key}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, "
                    "base_sha256 string, spans string", start)


def masked(text: str, ratio: Ratio, mask: str) -> str:
    """The text with every span, or group of overlapping spans, replaced by ``mask``."""
    out, at = [], 0
    for start, end, _ in all_spans(text, ratio):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", mask: str = "[secret]") -> DataFrame:
    """``docs`` with secrets masked in the text and the length column, if there is one, brought up to date.

    Null texts stay null, with their length as it is, and empty ones empty. Each row is masked by itself, so repeated rows are masked alike; an
    empty table stays empty. Extra columns may have any names (dots included) and are kept as they are.
    """
    ratio = train(docs, text)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t and masked(t, ratio, mask) for at in range(0, len(texts), SLICE_ROWS)
                         for t in texts.slice(at, SLICE_ROWS).to_pylist()], pa.string())

    done = docs.withColumn(text, F.arrow_udf(run, "string").asNondeterministic()(quoted(text)))
    if length in docs.columns:
        done = done.withColumn(length, F.when(quoted(text).isNull(), quoted(length)).otherwise(
            F.length(quoted(text))).cast(docs.schema[length].dataType))
    return done
