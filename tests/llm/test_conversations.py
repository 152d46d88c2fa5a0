from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyforge.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def brute(rows):
    """Every way to keep, change or delete each turn, with up to two turns inserted at each place."""
    bad = faults(rows)
    fills = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    ways = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in bad]
    best = None
    for acts in itertools.product(*ways):
        fixed = sum(3 if a == "D" else (f == "truncated") + 2 * (a[0] == "R") for a, f in zip(acts, bad))
        for gaps in itertools.product(fills, repeat=len(rows) + 1):
            cost = fixed + 2 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            audit, said = "", []
            for i, g in enumerate(gaps):
                audit += "I" * len(g)
                said += [({"u": "user", "a": "assistant"}[x], "") for x in g]
                if i < len(rows):
                    audit += acts[i][0]
                    if acts[i] != "D":
                        said.append((rows[i][0] if acts[i] == "K" else {"u": "user", "a": "assistant"}[acts[i][1]], rows[i][1]))
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, said
    return best


def test_repair_is_the_cheapest_edit(spark):
    rng = random.Random(7)
    texts = ["Hi.", "Yes!", "no end", "", " \n", "Why?"]
    convs = {c: [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(texts)) for _ in range(c % 4)] for c in range(1, 40)}
    rows = [(c, t, *x) for c, turns in convs.items() for t, x in enumerate(turns)]
    got = {r.conv_id: r for r in conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {c for c, turns in convs.items() if turns}
    for c, r in got.items():
        cost, audit, said = brute(convs[c])
        assert (r.cost, r.audit, [tuple(x) for x in r.repaired]) == (cost, audit, said), convs[c]
        bad = faults(convs[c])
        assert (r.blank, r.duplicate, r.truncated) == tuple(bad.count(k) for k in ("blank", "duplicate", "truncated"))
        initials = [x[0][:1] for x in convs[c]]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def kind(conv, turn):
    said = lambda x: " " if x is None else str(x)
    return zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20


def test_damage_nulls_ties_and_empty(spark):
    def turn_of(conv, k):
        return next(t for t in range(1000) if kind(conv, t) == k)

    gone, empty, bare, twice, user, plain = (turn_of(5, k) for k in (0, 1, 2, 3, 4, 9))
    rows = [(5, gone, "user", "Gone."), (5, empty, "user", "Emptied."), (5, bare, "user", "a. b! c?"), (5, twice, "user", "Twice."), (5, user, "assistant", "Mine."), (5, plain, None, None)]
    rows += [(6, turn_of(6, 0), "user", "Only one, dropped.")]
    got = sorted(tuple(r) for r in conversations.damage(spark.createDataFrame(rows, SCHEMA)).collect() if not r.gone)
    want = [(5, empty, "user", "", False), (5, bare, "user", "a b c", False), (5, twice, "user", "Twice.", False), (5, twice, "user", "Twice.", False), (5, user, "user", "Mine.", False), (5, plain, " ", " ", False)]
    assert got == sorted(want)
    r = {x.conv_id: x for x in conversations.op11(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert tuple(r[6])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = {t for t in (empty, bare, twice, user, plain)}
    assert r[5].gaps == max(turns) - min(turns) + 1 - len(turns) and r[5].duplicate == 1 and r[5].blank == 2

    odd = [(None, None, "user", "Null turn first."), (None, 0, "assistant", "Then."), (7, None, "user", "x."), (7, None, "assistant", "y."), (8, 1, "user", "Same."), (8, 1, "user", "Same.")]
    frame = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "'c' as gaps", "1 as pos", "2 as fault", "array(1) as repaired")
    got = {x.conv_id: x for x in conversations.repair(frame).collect()}
    assert got[None].audit == "KK" and got[None].gaps == 0
    # rows of one turn are in order of role: the answer comes first
    assert got[7].gaps == 0 and (got[7].cost, got[7].audit) == (4, "IKKI") and [tuple(x) for x in got[7].repaired] == [("user", ""), ("assistant", "y."), ("user", "x."), ("assistant", "")]
    assert got[8].duplicate == 1 and got[8].audit == "KDI"
    assert conversations.op11(frame.drop("gaps", "pos", "fault", "repaired").limit(0)).collect() == []


@pytest.mark.parametrize("n", [3000])
def test_long_conversation(spark, n):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(n)]
    got = conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert got.cost == 0 and got.audit == "K" * n and len(got.repaired) == n
    big = conversations.repair(spark.createDataFrame([(1, 0, "user", "word " * 400_000 + "."), (1, 1, "user", "word " * 400_000 + ".")], SCHEMA)).collect()[0]
    assert big.duplicate == 1 and big.audit == "KDI"
