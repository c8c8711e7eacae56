"""Repair of conversations against plain dynamic programming over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from estuarine.llm import dialogues

SOME = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")
KEY = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    """{conv: rows after damage}"""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        new = (turn, "user" if kind == 4 else role, text)
        out[conv] += [] if kind == 0 else [new, new] if kind == 3 else [new]
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        tail = SOME.findall(text)
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least(rows, marks):
    """Least (cost, audit) by trying all edits at every place, the pattern as a deterministic automaton."""
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    now = {"": (0, "")}

    def insert(states):
        for _ in range(3):
            for s, (c, w) in list(states.items()):
                for r in "ua":
                    if (s, r) in go:
                        states[go[s, r]] = min(states.get(go[s, r], (9**9, "")), (c + 5, w + "I"))
        return states

    now = insert(now)
    for (_, role, _), mark in zip(rows, marks, strict=True):
        new = {}

        def put(s, c, w):
            new[s] = min(new.get(s, (9**9, "")), (c, w))  # noqa: B023

        for s, (c, w) in now.items():
            put(s, c + 2, w + "D")
            if mark in ("", "truncated"):
                more = 5 if mark else 0
                if (s, role[:1]) in go:
                    put(go[s, role[:1]], c + more, w + "K")
                for r in "ua":
                    if (s, r) in go:
                        put(go[s, r], c + more + 1, w + "R")
        now = insert(new)
    return min(now[s] for s in ("", "a") if s in now)


def brute(rows):
    out = []
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        if not own:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", sha("")))
            continue
        marks = faults(own)
        cost, audit = least(own, marks)
        left, i = [], 0
        for letter in audit:
            if letter in "KR":
                left.append([own[i][1] if letter == "K" else None, own[i][2]])
            elif letter == "I":
                left.append([None, ""])
            i += letter != "I"
        before = ""
        for row in left:
            row[0] = row[0] if row[0] is not None else "assistant" if before[:1] == "u" else "user"
            before = row[0]
        assert GOOD.fullmatch("".join(r[0][:1] for r in left))
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, gaps, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left))))
    return out


def query(rows):
    hurt = dialogues.damage(rows)
    return dialogues.repair(hurt, gone=hurt["gone"])


def check(spark, rows, want=None):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost long, conv string")
    got = query(df)
    assert got.columns == KEY
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute(rows)))


def test_search():
    """Every kind of row, entry and exit: the two heaps against dynamic programming, ties included."""
    rng = random.Random(5)
    for _ in range(3000):
        codes = "".join(rng.choice("sua?SUA!x") for _ in range(rng.randint(0, 9)))
        rows = [(None, {"x": "q", "?": "t", "!": "t"}.get(c, c.lower()), "") for c in codes]
        marks = ["blank" if c == "x" else "truncated" if c in "SUA!" else "" for c in codes]
        assert dialogues.cheapest(codes) == least(rows, marks)


def test_cut_anywhere():
    """Tables of segments joined in order give what the whole conversation gives."""
    rng = random.Random(6)
    for _ in range(500):
        pieces = ["".join(rng.choice("sua?SUAx") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 4))]
        rows = []
        for i, codes in enumerate(pieces):
            cells = [(e, x, dialogues.cheapest(codes, e, (x,))) for e in range(4) for x in range(4)] if codes else [(e, e, (0, "")) for e in range(4)]
            cells = [{"entry": e, "exit": x, "cost": c[0], "audit": c[1]} for e, x, c in cells if c]
            rows.append({"conv": 1, "part": 0, "seq": i, "rows": len(codes), "ends": "??" if codes else "", "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "codes": codes, "cells": cells})
        total, slices = dialogues.chain(iter(rows))
        assert (total["cost"], total["audit"]) == dialogues.cheapest("".join(pieces))
        assert "".join(s[3] for s in slices) == total["audit"]


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("rows", [1024, 3])
def test_edges(spark, rows, monkeypatch):
    """Odd values, and conversations cut into segments of three rows."""
    monkeypatch.setattr(dialogues, "ROWS", rows)
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "agent"]
    texts = ["Yes.", "no", "", None, " \n", "Well?  ", "a!b", "　", "x" * 50_000, "Zürich.", "\x1c"]
    out = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in [*range(150), None] for _ in range(rng.choice([1, 1, 2, 5, 9, 14]))]
    out += [(500, t, "user" if t % 2 == 0 else "assistant", f"Text {t % 211}.") for t in range(5000)]
    out += [(501, None, "user", "Same.")] * 3000 + [(502, 3, "assistant", "Same.")]
    check(spark, out)


def test_repaired_rows(spark, monkeypatch):
    """The rows that are left hash to the digest and fit the pattern."""
    monkeypatch.setattr(dialogues, "ROWS", 16)
    table = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    hurt = dialogues.damage(table)
    left = defaultdict(list)
    for r in dialogues.repair(hurt, turns=True, gone=hurt["gone"]).collect():
        left[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    for r in query(table).collect():
        own = sorted(left[r["conv_id"]])
        assert [x[0] for x in own] == list(range(len(own)))
        assert sha("\n".join(f"{x[1]}:{x[2]}" for x in own)) == r["repaired_sha256"]
        assert GOOD.fullmatch("".join(x[1][:1] for x in own))


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert query(df).collect() == []
