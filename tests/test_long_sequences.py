"""Sequences far longer than a window give what short ones give."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from estuarine.functions import sequences as S
from estuarine.operators import kmersearch as K
from estuarine.operators import reads as R


def words(seq, k):
    return [w for i in range(len(seq) - k + 1) if not set(w := seq[i : i + k]) - set("ACGT")]


@pytest.fixture(scope="module")
def some():
    rng = random.Random(4)
    return [(i, "".join(rng.choice("ACGTN" if i % 3 else "ACGT") for _ in range(n))) for i, n in enumerate([0, 1, 3, 6, 7, 12, 13, 14, 15, 40, 90, 91])] + [(99, None), (98, "N" * 50)]


@pytest.mark.parametrize("window", [1, 5, 7, 65_536])
def test_windows(spark, some, window, monkeypatch):
    """Windows of a few bases: borders inside k-mers, chunks and runs of N."""
    monkeypatch.setattr(S, "WINDOW", window)
    df = spark.createDataFrame(some, "sequence_id long, seq string").filter("seq is not null")
    k = 4
    got = df.select("sequence_id", S.distinct_kmer_hashes(F.col("seq"), k).alias("h"), F.transform(S.kmers(F.col("seq"), k), lambda w: F.xxhash64(w)).alias("all")).collect()
    for r in got:
        assert r.h == list(dict.fromkeys(r["all"]))
    signed = {r.sequence_id: r.signature for r in R.read_signature(df, k, 5).collect()}
    coded = {}
    for r in R.encode_kmers(df, k, 6).collect():
        coded[r.sequence_id, r.chunk] = (r.input_ids, r.attention_mask)
    for i, seq in some[:-2]:
        w = words(seq, k)
        top = sorted(sorted(Counter(w).items(), key=lambda x: (-x[1], w.index(x[0])))[:5])
        assert signed[i] == hashlib.sha256(("{" + ", ".join(f'"{a}": {n}' for a, n in top) + "}").encode()).hexdigest()[:32]
        ids = [1 + sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(x)) for x in w]
        chunks = [ids[j : j + 6] for j in range(0, len(ids), 6)] or [[]]
        assert {c: coded.pop((i, c)) for c in range(len(chunks))} == {c: (x + [0] * (6 - len(x)), [1] * len(x) + [0] * (6 - len(x))) for c, x in enumerate(chunks)}
    assert set(coded) == {(98, 0)}


def test_millions_of_bases(spark):
    """A chromosome beside short reads; k-mers are counted over all windows."""
    rng = random.Random(5)
    unit, times = "".join(rng.choice("ACGT") for _ in range(1000)), 3000
    df = spark.createDataFrame([(1, unit), (2, unit[:300])], "sequence_id long, seq string")
    long = df.filter("sequence_id = 1").select(F.lit(3).cast("long").alias("sequence_id"), F.repeat("seq", times).alias("seq"))
    both = df.unionByName(long)
    assert len({r.signature for r in R.read_signature(both).collect()}) == 3
    mask = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    sizes = {r.sequence_id: tuple(r)[1:] for r in R.encode_kmers(both, 6, 512).groupBy("sequence_id").agg(F.count("chunk"), F.sum(mask)).collect()}
    assert sizes[3] == (-(-(1000 * times - 5) // 512), 1000 * times - 5) and sizes[2] == (1, 295)
    found = {(r.query_id, r.ref_id): r.share for r in K.kmer_search(both, both).collect()}
    assert set(found) == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 3)}
    assert found[2, 1] == found[2, 3] == found[1, 3] == 1.0 > found[3, 1]
