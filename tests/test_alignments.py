"""Banded alignment against the whole table."""

import random

import pytest

from estuarine.operators import alignments as L
from estuarine.operators import assign as A


def plain(q, r):
    """Best local score by the whole table."""
    best, row = 0, [0] * (len(r) + 1)
    for x in q:
        new = [0]
        for j, y in enumerate(r, 1):
            new.append(max(0, row[j - 1] + (L.MATCH if x == y else L.MISMATCH), row[j] - L.GAP, new[-1] - L.GAP))
        row = new
        best = max(best, *row)
    return best


def mutated(rng, seq, rate):
    out = []
    for c in seq:
        x = rng.random()
        if x < rate * 0.7:
            out.append(rng.choice("ACGT"))
        elif x < rate * 0.85:
            out += [c, rng.choice("ACGT")]
        elif x >= rate:
            out.append(c)
    return "".join(out)


def some_pairs(n=60):
    rng = random.Random(8)
    for _ in range(n):
        r = "".join(rng.choice("ACGT") for _ in range(rng.randint(60, 300)))
        a = rng.randrange(len(r) // 2)
        q = mutated(rng, r[a : a + rng.randint(40, 200)], rng.choice([0, 0.02, 0.1]))
        yield "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))) + q, r + "N" * rng.randint(0, 3)


def test_scores():
    pairs = [*some_pairs(), ("", "ACGT"), ("ACGT", ""), ("AAAA", "TTTT"), ("ACGTACGTAC", "ACGTACGTAC")]
    got = L.align([(L.codes(q), L.codes(r)) for q, r in pairs])
    for (q, r), (score, length, matches, mismatches, gaps, q_start, q_end, s_start, s_end) in zip(pairs, got.tolist(), strict=True):
        assert score == plain(q, r)
        assert score == L.MATCH * matches + L.MISMATCH * mismatches - L.GAP * gaps and length == matches + mismatches + gaps
        if score:
            # the two stretches alone score as much, and their lengths fit the numbers
            assert plain(q[q_start - 1 : q_end], r[s_start - 1 : s_end]) == score
            assert (q_end - q_start + 1) + (s_end - s_start + 1) == 2 * (matches + mismatches) + gaps
        else:
            assert (q_start, q_end, s_start, s_end) == (0, 0, 0, 0)


def test_blocks(monkeypatch):
    """Blocks of few pairs give the same rows."""
    import numpy as np

    sizes = np.array([5, 0, 300, 20, 20, 7])
    monkeypatch.setattr(L, "TABLE", 64 * 50)
    parts = list(L._blocks(sizes, 64))
    assert sorted(i for p in parts for i in p) == list(range(6)) and len(parts) > 2


@pytest.fixture(scope="module")
def hits(spark):
    rng = random.Random(9)
    refs = [(100 + i, "".join(rng.choice("ACGT") for _ in range(300)), t) for i, t in enumerate(["Vibrio fischeri strain A", "Gadus morhua", "Unrelated thing"])]
    reads = [(1, refs[0][1][20:220]), (2, mutated(rng, refs[1][1][50:250], 0.02)), (3, "".join(rng.choice("ACGT") for _ in range(200))), (4, refs[0][1][20:220])]
    q = spark.createDataFrame(reads, "sequence_id long, seq string")
    r = spark.createDataFrame(refs, "sequence_id long, seq string, name string")
    return q, L.aligned_hits(q, r, title=r["name"]), dict(reads), {i: s for i, s, _ in refs}


def test_hits(hits):
    _, found, reads, refs = hits
    rows = {r.query_id: r for r in found.collect()}
    assert sorted(rows) == [1, 2, 4]
    assert (rows[1].ref_id, rows[1].identity, rows[1].coverage, rows[1].s_start, rows[1].s_end, rows[1].pos) == (100, 100.0, 100.0, 21, 220, 0)
    assert rows[4].score == rows[1].score == 400
    assert rows[2].ref_id == 101 and 95 < rows[2].identity < 100 and rows[2].score == plain(reads[2], refs[101])
    assert rows[1].evalue < rows[2].evalue < 1e-50


def test_identity_reaches_the_assignment(spark, hits):
    """The species of a good alignment, with its identity as confidence."""
    q, found, *_ = hits
    taken = A.hits_to_assignments(A.best_hit(found), q)
    vectors = spark.createDataFrame([(i, [0.0]) for i in (1, 2, 3, 4)], "vec_id long, embedding array<double>")
    out = {r.sequence_id: r for r in A.assign_taxonomy(vectors, None, None, None, taken).collect()}
    assert (out[1].assigned_rank, out[1].assigned_label) == ("species", "Vibrio fischeri")
    identity = {r.query_id: r.identity for r in found.collect()}
    assert out[2].blast_identity == pytest.approx(identity[2]) if identity[2] >= A.IDENTITY_MIN else out[2].assigned_rank is None
    assert out[3].assigned_rank is None
