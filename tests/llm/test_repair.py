"""Conversation repair against exhaustive search, and the blocked form against the whole one."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubmeta.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(initials, faults):
    """All edit scripts up to the cost of deleting everything."""
    n, found = len(initials), []
    limit = 2 * n

    def go(i, cost, audit, out):
        if cost > limit:
            return
        if i == n and GRAMMAR.match(out):
            found.append((cost, audit))
        go_on = [("I", 5, i, c) for c in "ua"]
        if i < n:
            go_on.append(("D", 2, i + 1, ""))
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] == "t" else 0
                go_on.append(("K", more, i + 1, initials[i] or "?"))
                go_on += [("R", 1 + more, i + 1, c) for c in "ua"]
        for sign, more, j, c in go_on:
            go(j, cost + more, audit + sign, out + c)

    go(0, 0, "", "")
    return min(found)


def _random(rng, n):
    return [str(rng.choice(["s", "u", "a", "u", "a", "t", ""])) for _ in range(n)], [str(f) for f in rng.choice(["", "", "", "b", "d", "t"], n)]


@pytest.mark.parametrize("seed", range(60))
def test_alignment_against_all_scripts(seed):
    rng = np.random.default_rng(seed)
    initials, faults = _random(rng, int(rng.integers(0, 6)))
    assert repair.align(initials, faults) == exhaustive(initials, faults)


@pytest.mark.parametrize("seed", range(40))
def test_states_give_the_same_audits_as_the_table(seed):
    rng = np.random.default_rng(seed)
    initials, faults = _random(rng, int(rng.integers(1, 120)))
    cost, audit = repair.align(initials, faults)
    none = [0] * len(initials)
    assert repair._costs_to_go(initials, faults, none, list(repair._END))[0][0] == cost
    assert repair._walk(initials, faults, none, list(repair._END), 0, True)[0] == audit


def test_a_band_never_hides_the_best():
    """The table inside the band equals the table without one wherever a repair within the bound passes."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        initials, faults = _random(rng, 30)
        bound = repair._incumbent(initials, faults)
        banded, whole = (repair._suffix_costs(initials, faults, b) for b in (bound, 10_000))
        assert banded[0].min() == whole[0].min() and (banded[0] >= whole[0, : banded.shape[1]]).all()


LOWER = [
    (1, 0, "system", "Be good."),
    (1, 1, "user", "Hi."),
    (1, 2, "assistant", "Hello!"),
    (2, 0, "user", "Hi."),
    (2, 1, "user", "Hi."),
    (2, 2, "assistant", "cut of"),
    (2, 5, "assistant", "Yes?"),
    (3, 0, None, None),
    (4, None, "user", "First."),
    (4, 7, "assistant", "Last.  \n"),
    (None, 0, "user", "Nobody."),
    (None, 0, "user", "Nobody."),
    (None, 1, "assistant", "x" * 100_000 + "."),
    (5, 1, "assistant", " \t"),
    (6, 0, "", "No role."),
    (6, 0, "tool", "Tool!"),
]
DDL = "conv_id long, turn long, role string, text string"


def _expected(rows):
    """What the digest of a table of turns should be, in plain Python."""
    by = defaultdict(list)
    for c, t, role, text, present in rows:
        by[c]
        if present:
            by[c].append((t is not None, t or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for *_, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = [r[2][:1] for r in turns]
        known = {r[1] for r in turns if r[0]}
        cost, audit = exhaustive(initials, faults) if len(turns) < 6 else repair.align(initials, faults)
        lines, at, state = [], 0, ""
        for edit in audit:
            due = "assistant" if state == "u" else "user"
            role, text = turns[at][2:] if edit != "I" else (due, "")
            at += edit != "I"
            if edit == "D":
                continue
            role = due if edit == "R" else role
            state = role[:1]
            lines.append(f"{role}:{text}")
        assert GRAMMAR.match("".join(x[0] for x in lines))
        out[c] = (
            max(known) - min(known) + 1 - len(known) if known else 0,
            *(faults.count(f) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def _got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("long", [2048, 0, 2])
def test_awkward_turns(spark, monkeypatch, long):
    """Whole conversations, and all of them (or those over two turns) in blocks of two turns."""
    monkeypatch.setattr(repair, "LONG", long)
    monkeypatch.setattr(repair, "BLOCK_BITS", 1)
    docs = spark.createDataFrame(LOWER, DDL).withColumns({c: F.lit("x") for c in ("part", "block", "fault", "long_id", "n", "seq", "present")})
    want = _expected([(*r, True) for r in LOWER])
    assert _got(repair.repair_digest(docs)) == want
    parts = defaultdict(list)
    for r in repair.repaired_conversations(docs).collect():
        parts[r["conv_id"]].append((r["part"], r["audit"]))
    assert {c: "".join(a for _, a in sorted(p)) for c, p in parts.items()} == {c: w[6] for c, w in want.items()}


@pytest.mark.parametrize("long", [2048, 40])
def test_damaged_conversations(spark, monkeypatch, long):
    monkeypatch.setattr(repair, "LONG", long)
    monkeypatch.setattr(repair, "BLOCK_BITS", 4)
    rng = np.random.default_rng(8)
    rows = []
    for c, n in enumerate([1, 2, 3, 30, 90, 260]):
        rows += [(c, t, str(rng.choice(["user", "assistant"], p=[0.6, 0.4])), str(rng.choice(["Yes.", "No!", "Well", "a b?", "c."])) + f" {rng.integers(40)}.") for t in range(n)]
    rows += [(7, 3, "user", "Again.")] * 100 + [(9, t, None, None) for t in range(3)]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    given = spark.createDataFrame(rows, DDL)
    worn = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        worn += [(c, t, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    got = _got(repair.repair_digest(repair.damaged(given), F.col("present")))
    assert got == _expected(worn)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    none = spark.createDataFrame([], DDL)
    assert repair.repaired_conversations(none).count() == 0
    assert repair.repair_digest(repair.damaged(none), F.col("present")).count() == 0
