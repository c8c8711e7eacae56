"""Periodic runs against a version that tries every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from estuarine.llm import periodicruns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute_runs(w):
    """(start, length, smallest period) of all runs."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda x: (x[0], x[2]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(name, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(name).encode())
    if name is not None and h % 10 == 0 and w:
        g, old = h // 10, list(w)
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [old[i] if i < a else old[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    collapsed = sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    listed = sha("".join(f"{a},{n},{q}\n" for a, n, q in runs))
    if not runs:
        return 0, None, None, None, None, listed, collapsed
    from fractions import Fraction

    a, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return len(runs), a, n, q, 1000 * n // q, listed, collapsed


def check(got, want):
    def as_rows(rows):
        return sorted(map(repr, rows))

    assert as_rows(tuple(r) for r in got) == as_rows(want)


@pytest.mark.parametrize("seed", range(4))
def test_all_runs(seed):
    """Runs that touch, nest, share words, end early; periods at and around the edges of the scales."""
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = []
            for _ in range(rng.randint(0, 6)):
                k = rng.choice([2, 3, 50])
                if rng.random() < 0.3:
                    w += [rng.randrange(k) for _ in range(rng.randint(0, 60))]
                    continue
                p = [rng.randrange(k) for _ in range(rng.choice([1, 2, 5, 8, 15, 16, 17, 24, 25, 36, 37, 54, 55, 80, 81, 82, 120]))]
                if rng.random() < 0.3:
                    p = [0] * (len(p) - 1) + [1]
                w += (p * 5)[: rng.randint(int(2.5 * len(p)), 4 * len(p))]
            texts.append(w)
        got = periodicruns.find_runs(np.array(sum(texts, []), np.int64), np.array([len(x) for x in texts], np.int64)).tolist()
        for i, w in enumerate(texts):
            assert [tuple(r[1:]) for r in got if r[0] == i] == brute_runs(w)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 12000")
    want = [(r["doc_id"], *brute(r["doc_id"], r["text"])) for r in docs.select("doc_id", "text").collect()]
    got = periodicruns.periodic_runs(docs, plant=True)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sum(r[1] for r in want) > 10
    check(got.collect(), want)


def test_edges(spark):
    long = " ".join(f"w{i * i % 997}x{i}" for i in range(3000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "same " * 23), (5, "same " * 24), (None, "a b " * 40), (None, None), (6, "a b " * 12), (6, "a b " * 12),
        (7, "tabs\tand\x1cone\x85word " * 9), (8, "中 文 " * 30 + "b c d " * 30), (9, long + " " + long + " " + long), (10, "x" * 100_000), (30, "only"), (31, "a\0b " * 30),
        *[(100 + i, " ".join(f"t{j % 40}" for j in range(i * 7))) for i in range(60)],
    ]
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, start long, n_runs string")
    for plant in (True, False):
        want = [(i, *brute(i if plant else None, t)) for i, t in rows]
        check(periodicruns.periodic_runs(docs, plant=plant).collect(), want)
    assert periodicruns.periodic_runs(docs.limit(0)).collect() == []
