"""Hierarchical density clustering against a plain dendrogram."""

from collections import Counter

import numpy as np
import pytest

from estuarine.operators import hierarchy as H


def brute_tree(x, min_samples):
    """Distinct vectors with weights, core distances and the spanning tree's edges in order."""
    u, first, weight = np.unique(x, axis=0, return_index=True, return_counts=True)
    order = np.argsort(first)
    u, first, weight = u[order], first[order], weight[order]
    d = np.round(np.sqrt(((u[:, None] - u[None]) ** 2).sum(2)), 9)
    core = []
    for i in range(len(u)):
        near = np.argsort(d[i], kind="stable")
        core.append(d[i][near[np.searchsorted(np.cumsum(weight[near]), min_samples + 1)]])
    w = np.round(np.maximum(np.maximum(d, np.array(core)[:, None]), np.array(core)[None]), 9)
    a, b = np.triu_indices(len(u), 1)
    root, tree = list(range(len(u))), []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in np.lexsort((first[b], first[a], w[a, b])):
        i, j = find(a[k]), find(b[k])
        if i != j:
            root[i] = j
            tree.append((w[a[k], b[k]], int(a[k]), int(b[k])))
    return first, weight, np.array(core), tree


def brute_hdbscan(x, least, min_samples):
    """Labels by top-down splitting of the dendrogram, excess of mass, as rows of distinct vectors."""
    first, weight, core, tree = brute_tree(x, min_samples)
    top = {i: i for i in range(len(first))}
    kids, level, count = {}, {}, {i: int(w) for i, w in enumerate(weight)}
    owner = list(range(len(first)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for n, (w, a, b) in enumerate(tree):
        i, j = find(a), find(b)
        new = len(first) + n
        kids[new], level[new], count[new] = (top[i], top[j]), w, count[top[i]] + count[top[j]]
        owner[j] = i
        top[i] = new

    def leaves(n):
        todo, out = [n], []
        while todo:
            n = todo.pop()
            todo += kids.get(n, ())
            out += [n] if n < len(first) else []
        return out

    density = lambda w: 1 / max(w, H.LEAST)
    clusters, todo = [], [(2 * len(first) - 2, 0.0, None)]
    while todo:
        n, birth, up = todo.pop()
        own = {"birth": birth, "up": up, "rows": {}, "kids": []}
        clusters.append(own)
        me = len(clusters) - 1
        if up is not None:
            clusters[up]["kids"].append(me)
        while True:
            if n < len(first):  # a heavy point of its own
                own["rows"][n] = density(round(core[n], 9))
                break
            x_, y_ = kids[n]
            big = [k for k in (x_, y_) if count[k] >= least]
            for k in (x_, y_):
                if k not in big:
                    own["rows"] |= dict.fromkeys(leaves(k), density(level[n]))
            if len(big) == 2:
                todo += [(k, density(level[n]), me) for k in big]
                break
            if not big:
                break
            n = big[0]
    size = lambda c: sum(weight[i] for i in clusters[c]["rows"]) + sum(size(k) for k in clusters[c]["kids"])
    label, value, chosen = {}, {}, {}
    for c in reversed(range(len(clusters))):
        own = clusters[c]
        s = sum(weight[i] * (d - own["birth"]) for i, d in own["rows"].items()) + sum(size(k) * (clusters[k]["birth"] - own["birth"]) for k in own["kids"])
        inner = sum(value[k] for k in own["kids"])
        chosen[c] = own["up"] is not None and round(s, 9) >= round(inner, 9)
        value[c] = s if chosen[c] else inner
    deepest = {}
    for c in reversed(range(len(clusters))):
        deepest[c] = max([*clusters[c]["rows"].values(), *(deepest[k] for k in clusters[c]["kids"])], default=0)
    out = {}
    for c, own in enumerate(clusters):
        label[c] = label[own["up"]] if own["up"] is not None and label[own["up"]] is not None else c if chosen[c] else None
        for i, d in own["rows"].items():
            peak = None
            if label[c] is not None:
                g = clusters[label[c]]
                peak = max([*g["rows"].values(), *(clusters[k]["birth"] for k in g["kids"])])
            out[i] = (label[c], min(1.0, d / peak) if peak else 0.0, 1 - d / deepest[c])
    return first, out


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def blobs(n=2000, seed=0):
    """Clusters of very different densities and sizes, one inside another, far rows and copies."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n * s // 20, 3)) * r + c for s, r, c in [(5, 0.2, (0, 0, 0)), (4, 1.0, (8, 0, 0)), (4, 3.0, (0, 25, 0)), (1, 0.1, (9, 1, 0)), (3, 0.3, (8, 8, 8)), (1, 20.0, (0, 0, 0))]]
    x = np.vstack(parts)
    return np.vstack([x, x[: n // 20], np.repeat(x[:1], n // 20, axis=0)])


@pytest.mark.parametrize("n,size,pivots", [(2000, 256, 9)])
def test_hdbscan(spark, n, size, pivots):
    x = np.round(blobs(n), 6)
    first, want = brute_hdbscan(x, 10, 5)
    got = {r.vec_id: r for r in H.hdbscan(frame(spark, x), 10, 5, size=size, pivots=pivots).collect()}
    assert len(got) == len(x)
    names = {}
    for i, f in enumerate(first):
        label, probability, score = want[i]
        r = got[int(f)]
        assert (r.cluster < 0) == (label is None)
        if label is not None:
            assert names.setdefault(r.cluster, label) == label
        assert r.probability == pytest.approx(probability, abs=1e-6)
        assert r.outlier_score == pytest.approx(score, abs=1e-6)
    assert len(set(names.values())) == len(names) >= 5
    lows = [min(r.vec_id for r in got.values() if r.cluster == c) for c in sorted(names)]
    assert lows == sorted(lows)
    copies = Counter(got[i].cluster for i in range(len(x)) if (x[i] == x[0]).all())
    assert len(copies) == 1


def test_small_tables(spark):
    assert H.hdbscan(frame(spark, np.zeros((0, 3)))).collect() == []
    few = H.hdbscan(frame(spark, np.arange(12.0).reshape(4, 3)), 10, 5).collect()
    assert [r.cluster for r in few] == [-1] * 4


def test_epsilon(spark):
    """Clusters that part below the bound are one; the root may be a cluster only if that is allowed."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(40, 2)) * 0.1 + c for c in [(0, 0), (1, 0), (9, 0), (9, 9)]])
    apart = Counter(r.cluster for r in H.hdbscan(frame(spark, x), 10, 5, cluster_selection_epsilon=2.0).collect() if r.cluster >= 0)
    assert len(apart) == 3 and max(apart.values()) >= 75
    one = H.hdbscan(frame(spark, x[:40]), 15, 5, allow_single_cluster=True).collect()
    assert {r.cluster for r in one} == {0}


def tree_of(spark, x, **options):
    _, points = H.folded(frame(spark, x), "vec_id")
    got = H.reachability_tree(points, 5, **options)[1].collect()
    first, _, _, tree = brute_tree(x, 5)
    want = {(int(first[a]), int(first[b])): w for w, a, b in tree}
    assert {(r.a, r.b) for r in got} == set(want)
    assert [r.w for r in got] == pytest.approx([want[r.a, r.b] for r in got], abs=2e-9)


def test_tables_grow_with_rows(spark, monkeypatch):
    """No stored table has a forest per pair of blocks: small blocks cost no more rows."""
    x = np.round(blobs(1000), 6)
    sizes = []

    def counted(df, store=H.materialize):
        out = store(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(H, "materialize", counted)
    tree_of(spark, x, size=32, pivots=4)
    assert max(sizes) <= 20 * len(x)


def clumps():
    """Clumps of more rows than a list has, far apart: their lists do not reach each other."""
    rng = np.random.default_rng(5)
    return np.round(np.vstack([rng.normal(size=(30, 3)) + 40 * rng.normal(size=3) for _ in range(9)]), 6)


def lattice():
    """All short distances are equal."""
    return np.stack(np.meshgrid(*[np.arange(7.0)] * 3), axis=-1).reshape(-1, 3)


@pytest.mark.parametrize("rows,pivots", [(clumps, 5), (lattice, 3)])
def test_tree_beyond_the_lists(spark, rows, pivots):
    tree_of(spark, rows(), pivots=pivots, size=100, length=7)
