"""Trimming with errors against edit distances of all stretches."""

import random

import pytest

from estuarine.functions.adapters import adapter_starts
from estuarine.operators import reads as R


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(seq, adapters, rate, least=3):
    found = [(0, len(seq))]
    for a in adapters:
        m, k = len(a), int(len(a) * rate)
        for s in range(len(seq)):
            for w in range(m - k, m + k + 1):
                if s + w <= len(seq) and (e := edits(seq[s : s + w], a)) <= k:
                    found.append((2 * e - m, s))
        for n in range(least, m):
            for w in range(n - int(n * rate), n + int(n * rate) + 1):
                if w <= len(seq) and (e := edits(seq[len(seq) - w :], a[:n])) <= int(n * rate):
                    found.append((2 * e - n, len(seq) - w))
    return min(found)[1]


@pytest.mark.parametrize("adapters,rate", [(R.ADAPTERS, 0.1), (["ACGTTGCAAC", "GGGATCCTTAGGCATTCCAGATTCA"], 0.13)])
def test_brute_force(adapters, rate):
    rng = random.Random(3)
    seqs = ["", "A", "ACG", adapters[0], adapters[0][:3], adapters[1][1:]]
    for _ in range(300):
        body = [rng.choice("ACGTN") for _ in range(rng.randint(0, 50))]
        a = list(rng.choice(adapters))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(a))
            a[i : i + 1] = rng.choice([[], [rng.choice("ACGT")], [a[i], rng.choice("ACGT")]])
            a = a or ["A"]
        tail = [rng.choice("ACGT") for _ in range(rng.choice([0, 0, 5]))]
        seqs.append("".join(body + a[: rng.choice([len(a), rng.randint(1, len(a))])] + tail))
    assert adapter_starts(seqs, adapters, rate, 3).tolist() == [brute(s, adapters, rate) for s in seqs]


def test_blocks(monkeypatch):
    """Reads cut by the borders of blocks."""
    from estuarine.functions import adapters as A

    monkeypatch.setattr(A, "BLOCK", 37)
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))) + rng.choice(["AGATCGGTAGAGC", "AGATCGGAGAGCAA", ""]) for _ in range(60)]
    assert adapter_starts(seqs, R.ADAPTERS, 0.1, 3).tolist() == [brute(s, R.ADAPTERS, 0.1) for s in seqs]


def test_trim(spark):
    body = "ACGT" * 15
    ends = ["AGATCGGTAGAGCTTTT", "AGATCGGAGAGC", "AGATCGGAA", "AGATCGTTTTTTT", "CTGTCTCTTAAA" + "AGATCGGAAGAGC"]
    df = spark.createDataFrame([(i, body + e) for i, e in enumerate(ends)] + [(9, None)], "sequence_id long, seq string")
    got = {r.sequence_id: r.seq for r in R.trim_adapters(df).collect()}
    assert got == {0: body, 1: body, 2: body, 3: body + ends[3], 4: body}
    exact = {r.sequence_id: r.seq for r in R.trim_adapters(df, error_rate=0).collect()}
    assert exact[0] == body + ends[0] and exact[2] == body
