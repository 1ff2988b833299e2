import hashlib
import random
import re
import zlib

from kerbline.llm import conversation_repair as cr, queries
from tests.conftest import SMALL

TURNS = "conv_id bigint, turn bigint, role string, text string, cost int, row string"
FAULTS = (None, None, None, "blank", "truncated", "duplicate")


def least_repair(rows, inserts=4):
    """By trying all edits, with a number of insertions at most."""
    best = None

    def step(i, cost, audit, out, left):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(o[0] if o[0] in "sua" else "x" for o in out)):
                best = min(best or (cost, audit, out), (cost, audit, out), key=lambda b: b[:2])
        else:
            role, text, fault = rows[i]
            step(i + 1, cost + 4, audit + "D", out, left)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                step(i + 1, cost + more, audit + "K", [*out, f"{role}:{text}"], left)
                for other in cr.ROLES:
                    step(i + 1, cost + 3 + more, audit + "R", [*out, f"{other}:{text}"], left)
        if left:
            for other in cr.ROLES:
                step(i, cost + 3, audit + "I", [*out, f"{other}:"], left - 1)

    step(0, 0, "", [], inserts)
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def by_states(rows):
    """The same for long conversations: all costs over the states of the grammar, written by hand."""
    after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}

    def offer(into, state, cost, audit, out):
        if state and (state not in into or (cost, audit) < into[state][:2]):
            into[state] = (cost, audit, out)

    def inserted(now):
        for _ in range(4):
            for state, (cost, audit, out) in list(now.items()):
                for other in cr.ROLES:
                    offer(now, after.get((state, other[0])), cost + 3, audit + "I", (out, other + ":"))
        return now

    now = inserted({"0": (0, "", None)})
    for role, text, fault in rows:
        then = {}
        more = 3 if fault == "truncated" else 0
        for state, (cost, audit, out) in now.items():
            offer(then, state, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                offer(then, after.get((state, role[:1])), cost + more, audit + "K", (out, f"{role}:{text}"))
                for other in cr.ROLES:
                    offer(then, after.get((state, other[0])), cost + 3 + more, audit + "R", (out, f"{other}:{text}"))
        now = inserted(then)
    cost, audit, out = min((v for k, v in now.items() if k in "0p"), key=lambda v: v[:2])
    lines = []
    while out:
        out, line = out
        lines.append(line)
    return cost, audit, hashlib.sha256("\n".join(lines[::-1]).encode()).hexdigest()


def through(rows, pending=128):
    before, cr.PENDING = cr.PENDING, pending
    repair = cr.Repair(STACKS)
    for row in rows:
        repair.turn(*row)
    cr.PENDING = before
    return repair.end()


STACKS = cr.Stacks()


def test_automaton_takes_the_language():
    for text, fits in (("", True), ("ua", True), ("sua", True), ("suaua", True), ("s", False), ("u", False), ("uas", False), ("au", False)):
        state = STACKS.bottom
        for x in text:
            state = STACKS.shifts.get((state, x)) if state is not None else None
        assert (state in STACKS.accepting) == fits
    assert len(STACKS.tops) == 4


def test_repair_is_the_least_of_all_edits():
    r = random.Random(3)
    roles = ("user", "assistant", "user", "assistant", "system", " ", "", "tool", "umpire")
    for _ in range(250):
        rows = [(r.choice(roles), f"t{i}", r.choice(FAULTS)) for i in range(r.randrange(6))]
        assert through(rows, r.choice([1, 2, 128])) == least_repair(rows) == by_states(rows)


def test_long_conversations_are_settled_on_the_way():
    r = random.Random(5)
    for size in (130, 700, 3000):
        rows = [(r.choice(("user", "assistant", "system")), f"t{i}", r.choice(FAULTS)) for i in range(size)]
        assert through(rows, 3) == through(rows) == by_states(rows)
    repair = cr.Repair(STACKS)
    for i in range(5000):
        repair.turn(("user", "assistant")[i % 2], "Yes.", "blank" if i % 7 == 0 else None)
    assert max(len(v[1]) for v in repair.versions.values()) < 2 * cr.PENDING


def expected(rows):
    """Rows of the query from rows (conv_id, turn, role, text), all in memory."""
    conversations = {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in conversations.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).digest()))
        turns = {t for t, _, _ in own if t is not None}
        faults, seen = [], set()
        for _, role, text in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else None if marks[-1] in ".!?" else "truncated")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in cr.FAULTS),
                    sum(p not in ("su", "ua", "au") for p in pairs), *by_states([(r, t, f) for (_, r, t), f in zip(own, faults)])))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = sorted((tuple(r) for r in queries.QUERIES["op13_conversation_repair"](spark, SMALL).collect()), key=str)
    assert found == expected(given)


def test_odd_rows(spark):
    r = random.Random(9)
    said = ("Yes.", "yes", "", None, " \t\n", "No!", "Long " * 5000 + ".", "café。", "Yes.", "x\x00y?")
    rows = [(c, r.choice([None, 0, 1, 2, 3, 7]), r.choice(["user", "assistant", "system", None, ""]), r.choice(said))
            for c in (None, *range(40)) for _ in range(r.randrange(9))]
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t % 50}.") for t in range(600)]
    rows += rows[:30]
    given = spark.createDataFrame([(*row, 1, "x") for row in rows], TURNS)
    found = sorted((tuple(x) for x in cr.repair(cr.damaged(given)).collect()), key=str)
    assert found == expected(rows)
    assert cr.repair(cr.damaged(given.limit(0))).count() == 0


def test_conversations_of_dropped_turns_have_zeros(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given = spark.createDataFrame([(gone, 0, "user", "Hello.", 1, "x")], TURNS)
    assert [tuple(x) for x in cr.repair(cr.damaged(given)).collect()] == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
