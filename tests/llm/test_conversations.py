"""Conversation repair against a search over all edits and against a plain dynamic programme."""
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from scrollwork.llm import conversations as cv

EMPTY = hashlib.sha256(b"").hexdigest()
FORM = re.compile("(s?(ua)+)?")


def symbols(rows):
    """Initials and faults of ordered (role, text) rows."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(marks):
    """Least (cost, edits) from the last row back, for the states '', 's', 'u' and 'a'. The test of every edit holds it, too."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    after = {"": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}
    for initial, fault in reversed(marks):
        now = {}
        for q in after:
            found, at = [], q
            for lead in ("", "I", "II"):
                moves = [("D", 4, at)]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    moves += [("R", 3 + more, turn[at])] + ([("K", more, initial)] if initial and initial in ("su" if at == "" else turn[at]) else [])
                found += [(3 * len(lead) + c + after[to][0], lead + op + after[to][1]) for op, c, to in moves]
                at = turn[at]
            now[q] = min(found)
        after = now
    return after[""]


def rebuilt(rows, edits):
    out, k, state = [], 0, ""
    for e in edits:
        role = "assistant" if state == "u" else "user"
        if e == "I":
            out.append((role, ""))
        else:
            if e == "K":
                out.append(rows[k])
            elif e == "R":
                out.append((role, rows[k][1]))
            k += 1
        if e != "D":
            state = out[-1][0][:1]
    assert k == len(rows) and FORM.fullmatch("".join(r[:1] for r, _ in out))
    return out


def summary(turns):
    """``turns``: (turn, role, text) of one conversation."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda r: (*r[:3], hashlib.sha256(r[3].encode()).digest()))
    have = [t for ok, t, _, _ in rows if ok]
    marks = symbols([r[2:] for r in rows])
    cost, audit = cheapest(marks)
    initials = [m[0] for m in marks]
    fixed = rebuilt([r[2:] for r in rows], audit)
    return (
        max(have) - min(have) + 1 - len(set(have)) if have else 0,
        *[sum(f == k for _, f in marks) for k in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest() if fixed else EMPTY,
    )


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 1:
            x = ""
        elif k == 2:
            x = re.sub("[.!?]", "", x)
        elif k == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


@pytest.mark.parametrize("n", range(6))
def test_automaton_against_every_edit(n):
    """All edit texts of up to n + 3 inserts, priced one by one."""
    rnd = random.Random(n)
    for _ in range(60 if n < 5 else 15):
        signature = "".join(rnd.choice("suaoSUAOXuaua") for _ in range(n))
        found = []
        for inserts in itertools.product(range(3), repeat=n + 1):
            if sum(inserts) > 4:
                continue
            for ops in itertools.product("DKR", repeat=n):
                cost, state, ok, text = 0, "", True, ""
                for k in range(n + 1):
                    for _ in range(inserts[k]):
                        state, cost, text = ("a" if state == "u" else "u"), cost + 3, text + "I"
                    if k == n:
                        break
                    x, op = signature[k], ops[k]
                    text += op
                    if op == "D":
                        cost += 4
                        continue
                    cost += 3 * x.isupper() + 3 * (op == "R")
                    new = x.lower() if op == "K" else "a" if state == "u" else "u"
                    if x == "X" or (state + new) not in ("s", "u", "su", "ua", "au"):
                        ok = False
                        break
                    state = new
                if ok and state in ("", "a"):
                    found.append((cost, text))
        assert cv.Suffixes().node(signature, True)[0][cv.EMPTY] == min(found)
        assert cheapest([(x.lower(), "blank" if x == "X" else "truncated" if x.isupper() else "") for x in signature]) == min(found)


def test_nodes_are_built_once():
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("uaX") for _ in range(rnd.randint(1, 7))) for _ in range(400)}, key=lambda w: w[::-1])
    graph = cv.Suffixes()
    for w in words:
        graph.node(w, True)
    assert graph.built == len({w[k:] for w in words for k in range(len(w))})


def many(seed, n=60, length=14):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.randint(0, length)):
            text = rnd.choice(["Yes.", "No!", "cut off", "", " \n", None, f"Text {rnd.random()}.", f"open {rnd.random()}", "Wirklich? "])
            rows.append((rnd.choice([c, c, c, None]) if c % 9 == 0 else c, None if rnd.random() < 0.05 else t * rnd.choice([1, 1, 1, 3]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    return rows + rnd.sample(rows, 20)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True, "k") for r in rows], "conv_id long, turn long, role string, text string, digest string, block int, blank boolean, kind string")


def got(fixed):
    hashes = {r.conv_id: r.sha256 for r in cv.text_hashes(fixed.turns).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, EMPTY)) for r in fixed.conversations.collect()}


@pytest.mark.parametrize("block, fan", [(64, 64), (3, 2)])
def test_repair(spark, block, fan):
    rows = many(block)
    groups = defaultdict(list)
    for c, *rest in rows:
        groups[c].append(rest)
    assert got(cv.repair(frame(spark, rows), block=block, fan=fan)) == {c: summary(xs) for c, xs in groups.items()}


def test_one_conversation_of_many_rows(spark):
    rnd = random.Random(8)
    rows = [(5, t, rnd.choice(["user", "assistant"]), rnd.choice(["Same.", f"{t}!", f"{t} open"])) for t in range(3000)] + [(5, 7, "user", "again.")] * 500 + [(6, 0, "user", "Long. " * 200_000)]
    fixed = cv.repair(frame(spark, rows), block=16, fan=8)
    have = got(fixed)
    assert have[5] == summary([r[1:] for r in rows if r[0] == 5]) and have[6] == summary([rows[-1][1:]])
    text = "\n".join(f"{r.role}:{r.text}" for r in fixed.turns.where("conv_id = 5").orderBy("position", "nth").collect())
    assert hashlib.sha256(text.encode()).hexdigest() == have[5][-1]


def test_query_against_brute_force(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "b."), *many(11, 40, 8)]
    rows += [(1000 + c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}.") for c in range(150) for t in range(c % 9)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    groups = {c: [] for c, *_ in rows}
    for c, *rest in damaged(rows):
        groups[c].append(rest)
    out = cv.op12_conversation_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == {c: summary(xs) for c, xs in groups.items()}
    assert out.count() == len(groups)


def test_empty(spark, tmp_path):
    fixed = cv.repair(frame(spark, []))
    assert fixed.conversations.count() == fixed.edits.count() == cv.text_hashes(fixed.turns).count() == 0
