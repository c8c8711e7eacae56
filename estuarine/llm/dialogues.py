"""Faults of conversations and their cheapest repair.

The edits of a conversation are the paths of a lattice: a node is (rows used up, state of the role
pattern), an edge keeps, re-roles or deletes a row, or inserts one. Bidirectional Dijkstra searches it:
a forward and a backward heap meet, all crossings of the least cost are finished, and the least
concatenated audit is taken. No audit of a node is the beginning of another one of equal cost
(what follows could only be inserts, which cost), so the least audit of a node is the right one for every way on.

Conversations of any length are worked on in segments: rows are range sorted over all tasks, and a task cuts
its rows into segments of bounded size. A conversation inside one segment is finished there. For others every
segment gives a table, the cheapest way from each state to each state; tables are joined in order,
passing rows of bounded size through one task, and each segment then applies its part of the audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.llm.common import task
from estuarine.session import materialize

#: States: nothing yet, a system row, the last row is the user's, the last row is the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a re-roled or inserted row leads: each state allows one of the two roles.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
ROWS, CHARS = 1024, 4_000_000


def _forward(codes: str, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, i, state) of the edges that leave a node.

    A row's code is its role's initial (s, u, a, else ?), upper case (else !) if truncated, x if it has to go.
    """
    yield INSERT, "I", i, NEXT[state]
    if i < len(codes):
        yield DELETE, "D", i + 1, state
        if (code := codes[i]) != "x":
            more = TRUNCATED if code.isupper() or code == "!" else 0
            yield REROLE + more, "R", i + 1, NEXT[state]
            if (to := STEP.get((state, code.lower()))) is not None:
                yield more, "K", i + 1, to


def _backward(codes: str, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, i, state) of the edges that enter a node."""
    for before in range(4):
        for j in (i, i - 1):
            if j >= 0:
                for cost, letter, at, to in _forward(codes, j, before):
                    if at == i and to == state:
                        yield cost, letter, j, before


@lru_cache(maxsize=20_000)
def cheapest(codes: str, entry: int = START, exits: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost and the ASCII-least audit of that cost from `entry` to any of `exits`; None without a way."""
    if not codes and entry in exits:
        return 0, ""
    n = len(codes)
    # rows used up come second in the heaps: keeping costs nothing, so nodes of equal cost follow in that order
    heaps = [[(0, 0, 0, entry)], [(0, 0, n, s) for s in exits]]
    labels = [{(0, entry): (0, "")}, {(n, s): (0, "") for s in exits}]
    settled: list[dict[tuple[int, int], tuple[int, str]]] = [{}, {}]
    best: tuple[int, str] | None = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, i, state = heapq.heappop(heaps[side])
        if (i, state) in settled[side]:
            continue
        _, audit = settled[side][i, state] = labels[side][i, state]
        for more, letter, j, to in (_backward if side else _forward)(codes, i, state):
            path = letter + audit if side else audit + letter
            if (met := settled[1 - side].get((j, to))) is not None:
                whole = (cost + more + met[0], met[1] + path if side else path + met[1])
                best = whole if best is None else min(best, whole)
            old = labels[side].get((j, to))
            if old is None or (cost + more, path) < old:
                labels[side][j, to] = (cost + more, path)
                heapq.heappush(heaps[side], (cost + more, n - j if side else j, j, to))
    return best


def applied(codes: str, audit: str, state: int) -> tuple[list[tuple[str, int | None, str | None]], int]:
    """(edit, row or None, new role or None) of every row that an audit leaves, and the state after it."""
    out: list[tuple[str, int | None, str | None]] = []
    i = 0
    for letter in audit:
        if letter == "K":
            state = STEP[state, codes[i].lower()]
            out.append(("K", i, None))
        elif letter in "RI":
            state = NEXT[state]
            out.append((letter, i if letter == "R" else None, ROLE[state]))
        i += letter != "I"
    return out, state


class Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv, opened: bool):
        self.conv, self.opened = conv, opened  # opened: earlier rows are elsewhere
        self.roles, self.texts, self.chars = [], [], 0
        self.initials, self.codes, self.turns = "", "", []
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, role: str, text: str, repeat: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
        bare = text.strip(SPACE)
        code = initial
        if not bare:
            self.blank += 1
            code = "x"
        elif repeat:
            self.duplicate += 1
            code = "x"
        elif bare[-1] not in ".!?":
            self.truncated += 1
            code = initial.upper() if initial != "?" else "!"
        self.initials += initial
        self.codes += code
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None and self.turns[-1:] != [turn]:
            self.turns.append(turn)

    def facts(self) -> dict:
        turns = self.turns
        illegal = sum(x + y not in LEGAL for x, y in zip(self.initials, self.initials[1:], strict=False))
        return {
            "conv": self.conv, "rows": len(self.codes), "ends": self.initials[:1] + self.initials[-1:], "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
            "turns": len(turns), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": illegal,
        }

    def repaired(self, audit: str, state: int) -> list[tuple[str, str, str]]:
        """(edit, role, text) of the rows that stay."""
        kept, _ = applied(self.codes, audit, state)
        return [(e, role or self.roles[i], "" if i is None else self.texts[i]) for e, i, role in kept]


def joined(rows: list[tuple[str, str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for _, role, text in rows).encode()


FACTS = "rows long, ends string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
TURNS = "array<struct<edit: string, role: string, text: string>>"
CELL = "array<struct<entry: int, exit: int, cost: long, audit: string>>"


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row, weight in rows:
        held.append(row)
        n += weight
        if len(held) >= size or n > chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def segments(ordered: DataFrame, turns: bool) -> DataFrame:
    """One row per segment of the sorted rows (conv, turn, role, text, gone, repeat)."""
    kind = ordered.schema[0].dataType.simpleString()
    schema = f"conv {kind}, part int, seq long, whole boolean, {FACTS}, cost long, audit string, sha string, left {TURNS}, codes string, cells {CELL}, kept {TURNS}"

    def cut(batches) -> Iterator[tuple[Segment, bool]]:
        """Segments, and whether the conversation goes on elsewhere."""
        now: Segment | None = None
        last = None
        for batch in batches:
            for conv, turn, role, text, gone, repeat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield now, now.opened
                    now, last = Segment(conv, now is None), None
                elif len(now.codes) >= ROWS or now.chars >= CHARS:
                    yield now, True
                    now = Segment(conv, True)
                if not gone:
                    now.add(turn, role, text, repeat or last == (turn, role, text))
                    last = (turn, role, text)
        if now is not None:
            yield now, True

    def run(batches):
        part = task()

        def rows():
            for seq, (seg, is_open) in enumerate(cut(batches)):
                row = seg.facts() | {"part": part, "seq": seq, "whole": not is_open}
                if is_open:
                    cells = [(e, x, cheapest(seg.codes, e, (x,))) for e in range(4) for x in range(4)] if seg.codes else [(e, e, (0, "")) for e in range(4)]
                    row["cells"] = [{"entry": e, "exit": x, "cost": c[0], "audit": c[1]} for e, x, c in cells if c]
                    row |= {"codes": seg.codes, "kept": [{"edit": "", "role": r, "text": t} for r, t in zip(seg.roles, seg.texts, strict=True)]}
                else:
                    cost, audit = cheapest(seg.codes) or (0, "")
                    left = seg.repaired(audit, START)
                    row |= {"cost": cost, "audit": audit, "sha": hashlib.sha256(joined(left)).hexdigest()}
                    if turns:
                        row["left"] = [{"edit": e, "role": r, "text": t} for e, r, t in left]
                yield row, seg.chars

        yield from _batches(rows(), arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return ordered.mapInArrow(run, schema)


def by_conversation(batches) -> Iterator[list[dict]]:
    """Rows of each conversation of a task, one after another, as an iterator that has to be used up."""
    rows = (row for batch in batches for row in batch.to_pylist())
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead["conv"]

        def own():
            nonlocal ahead
            while ahead is not None and ahead["conv"] == conv:
                row, ahead = ahead, None
                yield row
                ahead = next(rows, None)

        yield own()


def chain(rows: Iterator[dict]) -> tuple[dict, list[tuple[int, int, int, str, int]]]:
    """The facts of a conversation from its segments in order, and (part, seq, entry state, audit, place) of each."""
    total: dict = {}
    sure, ways, at = [], {START: (0, "")}, []
    cost = 0
    for row in rows:
        at.append((row["part"], row["seq"], row["codes"]))
        table = {(c["entry"], c["exit"]): (c["cost"], c["audit"]) for c in row["cells"]}
        new: dict[int, tuple[int, str]] = {}
        for (e, x), (c, audit) in table.items():
            if e in ways:
                way = (ways[e][0] + c, ways[e][1] + audit)
                new[x] = min(way, new.get(x, way))
        # what all ways have in common is decided, so only their ends are held
        same, least = commonprefix([a for _, a in new.values()]), min(c for c, _ in new.values())
        sure.append(same)
        cost += least
        ways = {x: (c - least, a[len(same) :]) for x, (c, a) in new.items()}
        if not total:
            total = {k: row[k] for k in ("conv", "rows", "ends", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")}
            continue
        for k in ("rows", "turns", "blank", "duplicate", "truncated", "illegal"):
            total[k] += row[k]
        if row["rows"]:
            if total["ends"]:
                total["illegal"] += total["ends"][-1] + row["ends"][0] not in LEGAL
            total["ends"] = (total["ends"] + row["ends"])[0] + row["ends"][-1]
        if row["low"] is not None:
            total["turns"] -= total["high"] == row["low"]
            total |= {"low": row["low"] if total["low"] is None else total["low"], "high": row["high"]}
    end = min(ways[x] for x in ENDS if x in ways)
    total |= {"cost": cost + end[0], "audit": "".join(sure) + end[1]}
    slices, state, place, k = [], START, 0, 0
    for j, (part, seq, codes) in enumerate(at):
        a, used = k, 0
        while k < len(total["audit"]) and (used < len(codes) or j == len(at) - 1):
            used += total["audit"][k] != "I"
            k += 1
        own = total["audit"][a:k]
        left, after = applied(codes, own, state)
        slices.append((part, seq, state, own, place))
        state, place = after, place + len(left)
    return total, slices


def long_ones(segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, facts, cost, audit, sha) and (conv, place, left) of conversations of several segments."""
    kind = segs.schema["conv"].dataType.simpleString()
    parts = segs.filter("not whole").select("conv", "part", "seq", *(x.split(" ")[0] for x in FACTS.split(", ")), "codes", "cells")
    schema = f"conv {kind}, part int, seq long, entry int, own string, place long, first boolean, {FACTS}, cost long, audit string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def join(batches):
        def rows():
            for own in by_conversation(batches):
                total, slices = chain(own)
                for i, (part, seq, entry, audit, place) in enumerate(slices):
                    row = {"conv": total["conv"], "part": part, "seq": seq, "entry": entry, "own": audit, "place": place, "first": i == 0}
                    yield (row | total if i == 0 else row), len(audit)

        yield from _batches(rows(), arrow)

    solved = materialize(parts.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(join, schema))
    bodies = segs.filter("not whole").select("part", "seq", "codes", "kept").join(solved.select("conv", "part", "seq", "entry", "own", "place"), ["part", "seq"])

    def apply(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row["conv"], True)
                seg.codes, seg.roles, seg.texts = row["codes"], [x["role"] for x in row["kept"]], [x["text"] for x in row["kept"]]
                left = seg.repaired(row["own"], row["entry"])
                out = {k: row[k] for k in ("conv", "part", "seq", "place")} | {"left": [{"edit": e, "role": r, "text": t} for e, r, t in left]}
                yield pa.RecordBatch.from_pylist([out], pieces)

    piece = f"conv {kind}, part int, seq long, place long, left {TURNS}"
    pieces = to_arrow_schema(_parse_datatype_string(piece))
    left = materialize(bodies.mapInArrow(apply, piece))

    def digest(batches):
        for own in by_conversation(batches):
            sha, some = hashlib.sha256(), False
            for row in own:
                conv = row["conv"]
                if row["left"]:
                    sha.update(b"\n" * some + joined([(x["edit"], x["role"], x["text"]) for x in row["left"]]))
                    some = True
            yield pa.RecordBatch.from_pylist([{"conv": conv, "sha": sha.hexdigest()}], hashes)

    hashes = to_arrow_schema(_parse_datatype_string(f"conv {kind}, sha string"))
    shas = left.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(digest, f"conv {kind}, sha string").toDF("c", "sha")
    facts = solved.filter("first").drop("part", "seq", "entry", "own", "place", "first")
    return facts.join(shas, facts["conv"].eqNullSafe(shas["c"])).drop("c"), left.select("conv", "place", "left")


def repair(
    rows: DataFrame,
    turns: bool = False,
    gone: Column | None = None,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per conversation its faults and the cheapest repair; with `turns`, the repaired rows instead.

    Rows of a conversation are taken by turn, nulls first, rows of one turn by role and text. A row's first fault
    counts: blank, duplicate (role and text of an earlier row), truncated (its last character that is no white
    space is none of .!?). The result has (id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256): turns missing between the smallest and the largest, rows by fault, pairs of
    neighbouring roles whose initials are not su, ua or au, the repair's cost, its edits in order (Keep, Rerole,
    Delete, Insert; least by ASCII among the cheapest) and a hash of the lines "role:text" it leaves. Repaired
    initials are empty or an optional s, then ua once or more often. `turns` gives
    (id, place, edit, role, text), places from 0.

    Null roles and texts are one space. A null id is a conversation of its own; null turns come first and don't
    count for gaps. A role without characters has no initial: its row is never kept as it is. Repeated rows are
    duplicates. Rows for which `gone` holds are left out, but their conversation stays in the result, with
    zeros, an empty audit and the hash of nothing if no other row is left. An empty table gives no rows; other columns
    are ignored. A conversation may be of any size: its rows are shared out over the tasks.
    """
    plain = rows.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), F.coalesce(gone, F.lit(False)).alias("gone") if gone is not None else F.lit(False).alias("gone"),
    )
    named = plain.withColumn("hash", F.unhex(F.sha2("text", 256)))
    early = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn"))["turn"]
    firsts = named.filter("not gone").groupBy("conv", "role", "hash").agg(early.alias("early")).select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "early")
    same = named["conv"].eqNullSafe(firsts["c"]) & (named["role"] == firsts["r"]) & (named["hash"] == firsts["h"])
    marked = named.join(firsts, same, "left").select("conv", "turn", "role", "text", "gone", (~F.col("turn").eqNullSafe(F.col("early"))).alias("repeat"))
    # the beginnings of role and text only choose where a task's share ends; rows alike in them stay together
    ordered = marked.repartitionByRange("conv", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    segs = materialize(segments(ordered, turns))
    facts, left = long_ones(segs)
    if turns:
        all_left = segs.filter("whole").select("conv", F.lit(0).cast("long").alias("place"), "left").unionByName(left)
        each = all_left.select("conv", "place", F.posexplode("left").alias("more", "row"))
        return each.select(F.col("conv").alias(id_col), (F.col("place") + F.col("more")).alias("place"), "row.edit", "row.role", "row.text")
    columns = [*(x.split(" ")[0] for x in FACTS.split(", ")), "cost", "audit", "sha"]
    both = segs.filter("whole").select("conv", *columns).unionByName(facts.select("conv", *columns))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return both.select(F.col("conv").alias(id_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`rows` with faults put in by the crc32 of "id:turn" modulo 20, and a column `gone` for dropped rows.

    0 drops the row, 1 empties the text, 2 takes .!? out of it, 3 repeats the row, 4 makes the role user. Nulls
    are one space first, in the name too; ids and turns themselves stay null.
    """
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in (id_col, None, turn_col)))
    kind = (F.crc32(name.cast("binary")) % 20).cast("int")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    out = rows.select(
        F.col(id_col), F.col(turn_col), F.when(kind == 4, "user").otherwise(role).alias(role_col),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("__times"),
    )
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__copy")
