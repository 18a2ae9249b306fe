"""Operator 13 against a plain search over all edits that carries whole audits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from loglode.llm import conversation_repair as cr

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        out += [(conv, turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, text, fault).  Least (cost, audit), with the repaired turns, by state, over whole strings."""

    def move(state, r):  # state: the initials' tail that matters
        if r == "s":
            return "s" if state == "" else None
        return {"u": "u" if state in ("", "s", "a") else None, "a": "a" if state == "u" else None}.get(r)

    def inserts(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for r in ("user", "assistant"):
                    to = move(state, r[0])
                    if to:
                        offer(best, to, (cost + 2, audit + "I", [*turns, (r, "")]))

    def offer(best, state, x):
        if state not in best or x[:2] < best[state][:2]:
            best[state] = x

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        inserts(best)
        new = {}
        for state, (cost, audit, turns) in best.items():
            offer(new, state, (cost + 3, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role and move(state, role[0]):
                offer(new, move(state, role[0]), (cost + more, audit + "K", [*turns, (role, text)]))
            for r in ("user", "assistant"):
                if move(state, r[0]):
                    offer(new, move(state, r[0]), (cost + 2 + more, audit + "R", [*turns, (r, text)]))
        best = new
    inserts(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def brute(rows, broken):
    by = defaultdict(list)
    for conv, turn, role, text in broken:
        by[conv].append((turn is not None, turn or 0, role, text))
    out = []
    for conv in {r[0] for r in rows}:
        mine, seen, faults = sorted(by[conv]), set(), []
        for _, _, role, text in mine:
            shown = VISIBLE.findall(text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for known, t, _, _ in mine if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, fixed = cheapest([(m[2], m[3], f) for m, f in zip(mine, faults)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(seed, n):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.choice([1, 2, 3, 6, 12])):
            role = r.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None, "u", "A"])
            text = r.choice(["Yes.", "no", "Why?", "", " \t", None, "long. and\ncut", "é!", "a.\n", f"{turn}."])
            rows.append((conv, r.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(n, k // 2, r.choice(["user", "assistant", "system"]), f"{r.randrange(40)}{r.choice(['.', '', '?'])}") for k in range(700)]  # one huge
    return rows + [(None, 1, "user", "Hello."), (None, None, "assistant", "x" * 3_000_000), (None, 1, "user", "Hello."), (n + 1, 0, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*x, 5, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, part int, edit string, fault int").repartition(4)


@pytest.mark.parametrize("most", [256, 3])
def test_repair_equals_plain_search(spark, most, monkeypatch):
    rows = conversations(3, 150)
    monkeypatch.setattr(cr.repair, "__defaults__", (most,))
    df = frame(spark, rows)
    broken = damage(rows)
    assert sorted(map(tuple, cr.damaged(df).collect()), key=str) == sorted(broken, key=str)
    got = cr.repaired_digests(df, cr.damaged(df)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, broken)


def test_crossings_equal_plain_search():
    r = random.Random(7)
    for _ in range(3000):
        kinds = bytes(r.randrange(12) for _ in range(r.randrange(9)))
        steps = [cr.turn_step(k) for k in kinds] + [cr.turn_step(12)]
        costs, ranks = cr.forward(steps, 0)
        end = min((0, 3), key=lambda s: (costs[s], ranks[s]))
        at = cr.crossings(steps, 0, end)
        audit = "".join(step[a][b][1] for step, a, b in zip(steps, at, at[1:]))
        rows = [("sua-"[k // 3], "", ("", "truncated", "blank")[k % 3]) for k in kinds]
        assert (costs[end], audit) == cheapest(rows)[:2]


def test_empty_table(spark):
    df = frame(spark, conversations(1, 1)).where("false")
    assert cr.repaired_digests(df, cr.damaged(df)).collect() == []
    fixed = cr.repair(df)
    assert fixed.turns.collect() == [] and fixed.report.collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = cr.op13_conversation_repair(spark, sf_dir).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, damage(rows))
