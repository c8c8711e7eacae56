"""Block-wise operators against brute force, with small chunks so that many blocks meet."""

import numpy as np
import pandas as pd
import pytest

from estuarine.operators import assign as A
from estuarine.operators import clustering as C
from estuarine.operators import kmersearch as K
from estuarine.operators import novelty as N
from estuarine.operators import vectors as V
from estuarine.operators.blocks import within


def frame(spark, x, label=None):
    rows = [(i, [float(v) for v in r], int(label[i]) if label is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(42)
    centres = rng.normal(size=(4, 8)) * 6
    x = np.vstack([centres[i % 4] + rng.normal(size=8) for i in range(160)] + [rng.normal(size=8) * 30 for _ in range(8)])
    x = np.vstack([x, x[:12]]).astype(np.float32)  # copies
    return x, np.array([i % 4 for i in range(160)] + [9] * 8 + [i % 4 for i in range(12)])


def dist(x, y):
    return np.sqrt(((x[:, None, :].astype(float) - y[None, :, :].astype(float)) ** 2).sum(2))


@pytest.mark.parametrize("metric,scale,runs", [("l2", 1.0, False), ("l2", 1e-8, True), ("ip", 1.0, True), ("l2", 1e6, False)])
def test_nearest_by_bounds_equals_brute_force(metric, scale, runs):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(60, 5)) * scale, rng.normal(size=(5000, 5)) * scale
    b[1000:3000] = b[rng.integers(0, 9, 2000)]  # many copies, more than the bounds' first look holds
    b[4], a[2], b[77] = np.nan, b[8], b[77] * 1e7
    if metric == "ip":
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    ids, own, other = rng.permutation(5000), rng.integers(0, 3, 60), rng.integers(0, 3, 5000)
    left, right = pd.DataFrame({"query_id": range(60), "vec": list(a), "run": own}), pd.DataFrame({"ref_id": ids, "vec": list(b), "run": other})
    out = V._kernel(12, metric, runs, 2**14)(left, right)
    assert V._firsts(b[1000:3000], np.zeros(2000), 12).size <= 9 * 12
    for q in range(60):
        value = np.round(b @ a[q] if metric == "ip" else np.sqrt(((b - a[q]) ** 2).sum(1)), 9)
        fine = np.isfinite(value) & ((other != own[q]) | (not runs))
        order = [j for j in np.lexsort((ids, -value if metric == "ip" else value)) if fine[j]][:12]
        assert out.ref_id[out.query_id == q].tolist() == ids[order].tolist()


def test_within_settles_close_calls_exactly():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 6)) + 1000, rng.normal(size=(900, 6)) + 1000
    eps = float(np.sqrt(((a[3] - b[5]) ** 2).sum()))
    i, j = (np.concatenate(x) for x in zip(*within(a, b, eps, 2**10), strict=True))
    want = np.nonzero(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) <= eps)
    assert sorted(zip(i, j, strict=True)) == sorted(zip(*want, strict=True)) and (3, 5) in set(zip(i, j, strict=True))


def test_knn_with_pivots_is_exact(spark, blobs, monkeypatch):
    x, _ = blobs
    monkeypatch.setattr(V, "choose_pivots", lambda df, n, w=None: np.array([r.vec for r in df.orderBy("id").limit(9).collect()]))
    df = frame(spark, x)
    got = {}
    for r in V.knn_join(df, df, 4, "l2").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.ref_id, r.value)
    d = np.round(dist(x, x), 9)
    for q in range(len(x)):
        best = sorted(range(len(x)), key=lambda j: (d[q, j], j))[:4]
        assert [got[q][i + 1][0] for i in range(4)] == best


def brute_dbscan(x, eps, m):
    near = dist(x, x) <= eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], c
            while todo:
                j = todo.pop()
                for k in np.nonzero(near[j] & core & (label < 0))[0]:
                    label[k] = c
                    todo.append(k)
            c += 1
    for i in np.nonzero(~core)[0]:
        hits = label[near[i] & core]
        if len(hits):
            label[i] = hits.min()
    return label


@pytest.mark.parametrize("pivots,size", [(1, 2048), (7, 16)])
def test_dbscan(spark, blobs, pivots, size):
    x, _ = blobs
    out = C.dbscan(frame(spark, x), 3.2, 5, pivots=pivots, size=size).collect()
    got = np.array([r.cluster for r in sorted(out, key=lambda r: r.vec_id)])
    assert (got == brute_dbscan(x, 3.2, 5)).all()
    assert got.max() >= 3 and (got == -1).any()


def test_coherence_chunks(spark, blobs):
    x, y = blobs
    df = frame(spark, x, y)
    got = {r.label: r.coherence for r in V.cluster_coherence(df, "label", size=10).collect()}
    for c in np.unique(y):
        d = dist(x[y == c], x[y == c])
        assert got[c] == pytest.approx(1 / (1 + d[np.triu_indices(len(d), 1)].mean()))


def test_reduce_vectors(spark, blobs):
    x, _ = blobs
    out = V.reduce_vectors(frame(spark, x), 3, unit=False).orderBy("vec_id").collect()
    c = x.astype(float) - x.astype(float).mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    basis = vt[:3].T
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), range(3)])
    assert np.allclose([r.embedding for r in out], c @ basis, atol=1e-6)


def test_mahalanobis(spark, blobs):
    x, y = blobs
    df = frame(spark, x, y)
    ref = x[y != 9].astype(float)
    mean, inv = ref.mean(0), np.linalg.inv(np.cov(ref.T, bias=True))
    want = -np.einsum("ij,jk,ik->i", x - mean, inv, x - mean)
    got = N.mahalanobis_novelty(df.filter("label <> 9"), df).orderBy("vec_id").collect()
    assert np.allclose([r.score for r in got], want, atol=1e-5)
    assert [r.label for r in got] == list(np.where(want < np.quantile(want[y != 9], 0.1), -1, 1))


def test_isolation_forest_finds_far_points(spark, blobs):
    x, y = blobs
    df = frame(spark, x, y)
    a = {r.vec_id: r for r in N.isolation_forest(df.filter("label <> 9"), df, trees=30, sample=64).collect()}
    far = [a[i].label for i in np.nonzero(y == 9)[0]]
    near = [a[i].label for i in np.nonzero(y != 9)[0]]
    assert np.mean(far) < -0.5 and np.mean(near) > 0.6
    again = N.isolation_forest(df.filter("label <> 9").repartition(5), df.repartition(3), trees=30, sample=64)
    assert {r.vec_id: r.score for r in again.collect()} == {i: r.score for i, r in a.items()}


def test_centroid_novelty(spark, blobs):
    x, y = blobs
    df = frame(spark, x, y)
    got = {r.vec_id: r.label for r in N.centroid_novelty(df.filter("label <> 9"), df, 3.2, 5).collect()}
    assert all(got[i] == -1 for i in np.nonzero(y == 9)[0])


def test_ann_recall(spark, blobs):
    x, _ = blobs
    df = frame(spark, x)
    index, centres = V.ann_index(df, lists=4)
    found = {(r.query_id, r.ref_id) for r in V.ann_search(df, index, centres, 3, nprobe=2).collect()}
    exact = {(r.query_id, r.ref_id) for r in V.knn_join(df, df, 3, "l2").collect()}
    assert len(found & exact) / len(exact) > 0.8


def test_embedder_plugs_in(spark):
    df = spark.createDataFrame([(1, "ACGT"), (2, "AA")], "sequence_id long, seq string")
    out = V.embed_reads(df, lambda seqs: [[len(s), s.count("A")] for s in seqs], 2).orderBy("sequence_id").collect()
    assert [r.embedding for r in out] == [[4.0, 1.0], [2.0, 2.0]]


def brute_search(queries, refs, k, t, top):
    words = lambda s: {s[i : i + k] for i in range(len(s) - k + 1) if not set(s[i : i + k]) & set("NX")}
    out = {}
    for q, s in queries:
        mine = words(s)
        scored = [(-len(mine & words(r)) / len(mine), i) for i, r in refs if mine] if mine else []
        out[q] = [i for v, i in sorted(scored) if -v >= t][:top]
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("hot", [10**9, 0])
def test_kmer_search_with_and_without_hot_words(spark, hot):
    rng = np.random.default_rng(0)
    base = ["".join(rng.choice(list("ACGT"), 80)) for _ in range(6)]
    refs = []
    for i in range(60):
        s = list(base[i % 6])
        for p in rng.integers(0, 80, size=i % 7):
            s[p] = "ACGTN"[rng.integers(0, 5)]
        refs.append((i, "".join(s)))
    refs += [(100 + i, refs[0][1]) for i in range(5)]
    queries = [(i, refs[i * 3][1][10:60]) for i in range(12)] + [(50, refs[0][1][10:60])]
    q = spark.createDataFrame(queries, "sequence_id long, seq string")
    r = spark.createDataFrame(refs, "sequence_id long, seq string")
    got = {}
    for row in K.kmer_search(q, r, 5, 4, 0.5, hot_pairs=hot, chunk=7).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = row.ref_id
    want = brute_search(queries, refs, 5, 0.5, 4)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == want


def test_chimera(spark):
    rng = np.random.default_rng(1)
    a, b = ("".join(rng.choice(list("ACGT"), 100)) for _ in range(2))
    reads = [a] * 6 + [b] * 5 + [a[:50] + b[50:]]
    df = spark.createDataFrame(list(enumerate(reads)), "sequence_id long, seq string")
    flagged = [r.sequence_id for r in K.chimera_screen(df).filter("is_chimera").collect()]
    assert flagged == [11]
    assert K.screen_reads(df).count() == 11


def test_components(spark):
    nodes = spark.range(40).select("id")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 19)] + [(30, 25), (25, 39)], "a long, b long")
    got = {r.id: r.component for r in C.connected_components(nodes, links).collect()}
    want = {i: (0 if i < 20 else 25 if i in (25, 30, 39) else i) for i in range(40)}
    assert got == want


def test_assign_without_references(spark):
    q = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    hits = spark.createDataFrame([(1, "Vibrio fischeri", 98.0, 5), (2, "X y", 90.0, 6)], "sequence_id long, taxonomy string, identity double, taxid long")
    out = {r.sequence_id: r for r in A.assign_taxonomy(q, None, None, None, hits).collect()}
    assert (out[1].assigned_rank, out[1].assigned_label, out[1].confidence, out[1].source) == ("species", "Vibrio fischeri", 0.98, "none+blast")
    assert out[2].assigned_rank is None and out[2].source == "none"


def test_estimate_k_range(spark, blobs):
    x, _ = blobs
    assert 2 <= C.estimate_k(frame(spark, x), 6) <= 6


def test_spread_keeps_rows(spark):
    from estuarine.session import spread

    assert spread(spark.range(100).coalesce(1)).count() == 100
