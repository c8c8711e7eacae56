"""Costly inputs are worked out once, and counts stay inside their rows."""

import numpy as np
from pyspark.sql import functions as F

from estuarine.operators import assign as A
from estuarine.operators import vectors as V


def test_votes_and_consensus_work_out_their_inputs_once(spark):
    made = {n: spark.sparkContext.accumulator(0) for n in ("neighbours", "assigned")}

    def counted(df, name):
        def run(batches):
            for pdf in batches:
                made[name].add(len(pdf))
                yield pdf

        return df.mapInPandas(run, df.schema)

    near = spark.createDataFrame([(q, r, 0.9) for q in range(20) for r in range(3)], "query_id long, ref_id long, value double")
    labels = spark.createDataFrame([(r, f"s{r // 3}") for r in range(3)], "ref_id long, species string")
    voted = A.knn_lca(counted(near, "neighbours"), labels, margin=0.0)
    assert voted.filter("assigned_label = 's0'").count() == 20
    assert made["neighbours"].value == 60

    rows = [(i, "species" if i % 4 else None, "s1" if i % 4 else None, 0.9, "knn") for i in range(40)]
    assign = spark.createDataFrame(rows, "sequence_id long, assigned_rank string, assigned_label string, confidence double, source string")
    clusters = spark.createDataFrame([(i, i % 2) for i in range(40)], "sequence_id long, cluster int")
    out = A.cluster_consensus(counted(assign, "assigned"), clusters, 0.3)
    assert out.filter("assigned_label = 's1'").count() == 40
    assert made["assigned"].value == 40


def test_kmer_vectors_are_counted_inside_the_row(spark):
    rng = np.random.default_rng(2)
    seqs = ["".join(rng.choice(list("ACGTN"), n)) for n in (0, 2, 4, 50, 300, 70_000)] + [None]
    df = spark.createDataFrame(list(enumerate(seqs)), "sequence_id long, seq string")
    out = V.embed_kmers(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    words = sorted({s[i : i + 4] for s in seqs if s for i in range(len(s) - 3)} - {None})
    slot = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("s")).collect()}
    for r in out.collect():
        want = np.zeros(64)
        s = seqs[r.sequence_id] or ""
        for i in range(len(s) - 3):
            if "N" not in s[i : i + 4]:
                want[slot[s[i : i + 4]]] += 1
        want /= max(np.sqrt((want**2).sum()), 1e-12)
        assert np.allclose(r.embedding, want)
