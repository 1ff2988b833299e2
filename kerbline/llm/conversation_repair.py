"""Repair of conversations: generalised LR parsing of their roles with weighted edits.

The grammar says what a conversation is: an optional system turn and one or more pairs of a user and an assistant turn, or
nothing. Its LR automaton is built from the productions. A graph-structured stack holds all parses of all edited versions of
the turns so far: each turn is kept, given another role or deleted, and turns may be inserted before and after it. Stacks
share what they have in common; where two edited versions come to one stack top, the one of least (cost, audit) stays.

Turns are read in order, from partitions sorted by conversation and turn. What all surviving versions have in common is
settled and leaves memory, so that a conversation of any length is read in one pass. Repeated turns are found by an
aggregation over (conversation, role, digest of the text) beforehand and come along as marks in the same order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kerbline.llm.texts import SLICE_ROWS, WORD_PATTERN

#: Left side and right side; capitals are derived, the rest are initials of roles.
GRAMMAR = (("S", "C"), ("C", ""), ("C", "P"), ("C", "sP"), ("P", "Q"), ("P", "PQ"), ("Q", "ua"))
END = "$"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = ("user", "assistant")
LEGAL = ("su", "ua", "au")
#: Turns after which what all versions share is settled.
PENDING = 128
NOT_BLANK = re.compile(WORD_PATTERN)
FAULTS = ("blank", "duplicate", "truncated")


class Automaton:
    """The LR(0) states of a grammar with lookahead sets of its reductions (SLR)."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = grammar
        derived = {left for left, _ in grammar}
        first: dict[str, set] = {x: set() for x in derived}
        empty: set[str] = set()
        follow: dict[str, set] = {x: set() for x in derived}
        follow[grammar[0][0]].add(END)
        size = -1
        while size != (size := sum(map(len, [*first.values(), *follow.values(), empty]))):
            for left, right in grammar:
                if all(x in empty for x in right):
                    empty.add(left)
                for x in right:
                    first[left] |= first.get(x, {x})
                    if x not in empty:
                        break
                behind = set(follow[left])
                for x in reversed(right):
                    if x in derived:
                        follow[x] |= behind
                        behind = behind | first[x] if x in empty else set(first[x])
                    else:
                        behind = {x}
        self.states = [self._closure({(0, 0)})]
        self.moves: dict[tuple[int, str], int] = {}
        for number, state in enumerate(self.states):  # grows meanwhile
            for symbol in sorted({grammar[r][1][dot] for r, dot in state if dot < len(grammar[r][1])}):
                target = self._closure({(r, dot + 1) for r, dot in state if grammar[r][1][dot:dot + 1] == symbol})
                if target not in self.states:
                    self.states.append(target)
                self.moves[number, symbol] = self.states.index(target)
        self.reductions = {(number, symbol): r for number, state in enumerate(self.states) for r, dot in state
                           if dot == len(grammar[r][1]) for symbol in follow[grammar[r][0]]}

    def _closure(self, items: set) -> frozenset:
        while True:
            wanted = {self.grammar[r][1][dot] for r, dot in items if dot < len(self.grammar[r][1])}
            more = {(k, 0) for k, (left, _) in enumerate(self.grammar) if left in wanted} - items
            if not more:
                return frozenset(items)
            items = items | more


class Stacks:
    """The graph of stacks: one node for each (state, node below), however many versions come to it.

    Nodes from which the same turns can follow are one stack top. The role grammar has few of them; they are found by
    walking from the empty stack and splitting what differs in acceptance or in its next tops.
    """

    MOST_NODES = 10_000

    def __init__(self):
        self.automaton = Automaton()
        self.initials = sorted({x for _, right in GRAMMAR for x in right if x.islower()})
        nodes: dict[tuple, tuple] = {}
        bottom = nodes.setdefault((0, None), (0, None))
        after: dict[tuple, dict] = {}
        todo = [bottom]
        while todo:
            node = todo.pop()
            if node not in after:
                after[node] = {x: self._next(nodes, node, x) for x in self.initials}
                todo += [n for n in after[node].values() if n is not None]
            if len(after) > self.MOST_NODES:
                raise ValueError("a grammar without bound on its stacks")
        accepts = {n: self._next(nodes, n, END) is not None for n in after}
        kind = {n: int(accepts[n]) for n in after}
        kinds = -1
        while kinds != (kinds := len(set(kind.values()))):
            seen: dict[tuple, int] = {}
            kind = {n: seen.setdefault((kind[n], *(kind.get(t) for t in after[n].values())), len(seen)) for n in after}
        self.bottom = kind[bottom]
        self.accepting = {kind[n] for n in after if accepts[n]}
        self.shifts = {(kind[n], x): kind[t] for n in after for x, t in after[n].items() if t is not None}
        self.tops = sorted(set(kind.values()))
        self.insertions = {top: self._insertions(top) for top in self.tops}
        self.excess = self._excess()

    def _next(self, nodes: dict, node: tuple, initial: str) -> tuple | None:
        """The stack after the reductions that the initial calls for and its shift; None where the grammar has none."""
        grammar, moves = self.automaton.grammar, self.automaton.moves
        while (rule := self.automaton.reductions.get((node[0], initial))) is not None:
            if rule == 0:
                return node
            left, right = grammar[rule]
            for _ in right:
                node = node[1]
            node = nodes.setdefault((moves[node[0], left], node), (moves[node[0], left], node))
        target = moves.get((node[0], initial))
        return None if target is None else nodes.setdefault((target, node), (target, node))

    def _insertions(self, top: int) -> list[tuple[int, tuple[str, ...]]]:
        """Tops that inserted turns lead to, each by the fewest turns."""
        found, front = {top: ()}, [top]
        while front:
            steps = [(self.shifts.get((t, r[0])), (*found[t], r)) for t in front for r in ROLES]
            front = []
            for target, roles in steps:
                if target is not None and target not in found:
                    found[target] = roles
                    front.append(target)
        return [(t, roles) for t, roles in found.items() if roles]

    def _excess(self) -> dict[tuple[int, int], float]:
        """How much more, at most, a version at the second top has to pay from here on than one at the first, whatever follows."""
        ways = {t: [(t, 0), *((o, INSERT * len(roles)) for o, roles in self.insertions[t])] for t in self.tops}
        value = {(x, y): 0.0 for x in self.tops for y in self.tops}
        for _ in range(50):
            def cost(x, y):
                worst = min((c for o, c in ways[y] if o in self.accepting), default=float("inf")) if x in self.accepting else 0.0
                for i in self.initials:
                    if (x, i) in self.shifts:
                        target = self.shifts[x, i]
                        answers = [DELETE + value[target, y]]
                        answers += [c + value[target, self.shifts[o, i]] for o, c in ways[y] if (o, i) in self.shifts]
                        worst = max(worst, min(answers))
                return worst
            value, before = {pair: cost(*pair) for pair in value}, value
            if value == before:
                return value
        # Tops that can't be compared are never given up.
        return {pair: v if v == before[pair] else float("inf") for pair, v in value.items()}


@dataclass
class Repair:
    """One conversation, turn by turn."""

    stacks: Stacks
    versions: dict = field(default_factory=dict)  # stack top: (cost, audit since what is settled, its lines as linked pairs)
    settled: list = field(default_factory=list)
    digest: object = field(default_factory=hashlib.sha256)
    lines: int = 0
    base: int = 0
    turns: int = 0

    def __post_init__(self):
        self.versions = self._inserted({self.stacks.bottom: (0, "", None)})

    def _inserted(self, versions: dict) -> dict:
        """With versions that insert turns here; without those that another one undercuts whatever follows."""
        found = dict(versions)
        for top, (cost, audit, trail) in versions.items():
            for target, roles in self.stacks.insertions[top]:
                better = cost + INSERT * len(roles), audit + "I" * len(roles)
                if target not in found or better < found[target][:2]:
                    for role in roles:
                        trail = (trail, role + ":")
                    found[target] = (*better, trail)
                    trail = versions[top][2]
        excess = self.stacks.excess
        costs = [(top, v[0]) for top, v in found.items()]
        return {x: found[x] for x, own in costs if all(cost + excess[x, y] >= own for y, cost in costs if y != x)}

    def turn(self, role: str, text: str, fault: str | None) -> None:
        found: dict = {}
        shifts = self.stacks.shifts
        extra = TRUNCATED if fault == "truncated" else 0
        removed = fault in ("blank", "duplicate")
        for top, (cost, audit, trail) in self.versions.items():
            offers = [(top, cost + DELETE, "D", None)]
            if not removed:
                offers.append((shifts.get((top, role[:1])), cost + extra, "K", role))
                offers += [(shifts.get((top, r[0])), cost + REROLE + extra, "R", r) for r in ROLES]
            for target, price, edit, own in offers:
                if target is not None and (target not in found or (price, audit + edit) < found[target][:2]):
                    found[target] = (price, audit + edit, (trail, None if own is None else f"{own}:{text}"))
        self.versions = self._inserted(found)
        self.turns += 1
        if self.turns % PENDING == 0:
            self._settle()

    def _settle(self) -> None:
        least, most = min(v[1] for v in self.versions.values()), max(v[1] for v in self.versions.values())
        shared = next((k for k, (a, b) in enumerate(zip(least, most)) if a != b), min(len(least), len(most)))
        # One edit stays, so that versions keep apart what they did last.
        shared = min(shared, len(least) - 1)
        if shared <= 0:
            return
        cheapest = min(v[0] for v in self.versions.values())
        versions = {}
        for top, (cost, audit, trail) in self.versions.items():
            back = []
            while trail is not None:
                trail, line = trail
                back.append(line)
            rest = None
            for line in back[::-1][shared:]:
                rest = (rest, line)
            versions[top] = (cost - cheapest, audit[shared:], rest)
        self._write(back[::-1][:shared])
        self.settled.append(least[:shared])
        self.base += cheapest
        self.versions = versions

    def _write(self, lines: Iterable[str | None]) -> None:
        for line in lines:
            if line is not None:
                self.digest.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
                self.lines += 1

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the least repair."""
        cost, audit, trail = min((v for n, v in self.versions.items() if n in self.stacks.accepting), key=lambda v: v[:2])
        back = []
        while trail is not None:
            trail, line = trail
            back.append(line)
        self._write(back[::-1])
        return self.base + cost, "".join([*self.settled, audit]), self.digest.hexdigest()


def first_fault(text: str, repeated: bool) -> str | None:
    last = NOT_BLANK.findall(text[-64:]) or NOT_BLANK.findall(text)
    if not last:
        return "blank"
    if repeated:
        return "duplicate"
    return None if last[-1][-1] in ".!?" else "truncated"


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns as the query takes them, some of them damaged by a checksum of their key; dropped ones keep a row without role.

    Nulls are taken as one space, also in the key; conversation and turn keep theirs.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = F.crc32(key.cast("binary")) % 20
    own, said = F.coalesce(role, F.lit(" ")), F.coalesce(text, F.lit(" "))
    rows = turns.select(F.col(conv), F.col(turn), own.alias("role"), said.alias("text"), kind.alias("kind"))
    rows = rows.select(conv, turn, "kind", F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                       .when(F.col("kind") != 0, F.col("text")).alias("text"))
    return rows.select(conv, turn, "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns come in order of ``turn`` (nulls first), equal turns in order of role and text digest. A null text counts as blank. A
    row of null role only says that its conversation exists: a conversation of nothing else has zeros, an empty audit and the
    digest of the empty string. Rows of null ``conv`` form one conversation. Further columns are not looked at; an
    empty table gives none.

    gaps are the turns missing between least and greatest; each row's first fault counts (blank, duplicate of an earlier
    role and text, truncated); illegal are neighbours whose roles can't follow each other; audit has a letter for each
    edit of the least repair: (K)eep, (R)erole, (D)elete, (I)nsert.
    """
    conv_kind, turn_kind = (turns.schema[c].dataType.simpleString() for c in (conv, turn))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.when(F.col(role).isNotNull(), F.coalesce(text, F.lit(""))).alias("text")).withColumn("digest", _digest("text"))
    # A group of equal turns at several places: all but the first place are marked. Within a place, equal rows are neighbours.
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    keys = rows.where("role IS NOT NULL").select("conv", "turn", "role", "digest")
    groups = keys.groupBy("conv", "role", "digest").agg(F.min(place).alias("least"), F.max(place).alias("greatest")).where("least <> greatest")
    a, b = keys.alias("a"), groups.alias("b")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    later = a.join(b, same).where("a.turn IS NOT NULL AND NOT (a.turn <=> b.least.turn)").select("a.*")
    marks = later.distinct().select("conv", "turn", "role", F.lit(None).cast("string").alias("text"), "digest", F.lit(0).alias("row"))
    ordered = rows.withColumn("row", F.lit(1)).unionByName(marks).repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "digest", "row")

    schema = (f"`{conv}` {conv_kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
              "audit string, repaired_sha256 string")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        stacks = Stacks()
        out: list[tuple] = []
        name, state = object(), None

        def finish():
            if state is not None:
                span = state["most"] - state["least"] + 1 - state["turns"] if state["turns"] else 0
                out.append((name, span, *(state[f] for f in FAULTS), state["illegal"], *state["repair"].end()))

        def pack():
            columns = list(zip(*out)) or [[]] * len(target)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for own, number, who, said, digest, real in zip(*(c.to_pylist() for c in part.columns)):
                    if state is None or own != name:
                        finish()
                        name = own
                        state = dict.fromkeys((*FAULTS, "illegal", "turns", "least", "most"), 0) | {
                            "repair": Repair(stacks), "seen": None, "last": None, "mark": None}
                    key = (number, who, digest)
                    if not real:
                        state["mark"] = key
                        continue
                    if who is None:
                        continue
                    if number is not None and (not state["turns"] or number != state["most"]):
                        state["least"] = state["least"] if state["turns"] else number
                        state["turns"], state["most"] = state["turns"] + 1, number
                    if state["last"] is not None and state["last"] + who[:1] not in LEGAL:
                        state["illegal"] += 1
                    fault = first_fault(said, key in (state["seen"], state["mark"]))
                    if fault:
                        state[fault] += 1
                    state["seen"], state["last"] = key, who[:1]
                    state["repair"].turn(who, said, fault)
                if len(out) >= 2000:
                    yield pack()
        finish()
        yield pack()

    return ordered.select("conv", "turn", "role", "text", "digest", "row").mapInArrow(run, schema)
