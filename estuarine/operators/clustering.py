"""Clustering of vectors: k-means, bisecting, density based."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.operators.blocks import chunk_rows, grid_apply, matrix, within
from estuarine.operators.ordered import ranked
from estuarine.operators.vectors import (
    _cell_radius,
    as_doubles,
    assign_cells,
    choose_pivots,
    probe_cells,
)
from estuarine.session import materialize


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("__features", array_to_vector(as_doubles(F.col("embedding"))))


def kmeans(vectors: DataFrame, k: int, seeds: tuple[int, ...] = (42,), max_iter: int = 300) -> DataFrame:
    """k-means labels of the seed with the lowest cost."""
    rows = _features(vectors)
    models = [
        KMeans(k=k, seed=s, maxIter=max_iter, featuresCol="__features", predictionCol="cluster").fit(rows) for s in seeds
    ]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("__features")


def estimate_k(vectors: DataFrame, upper: int = 20, lower: int = 2) -> int:
    """k in `lower`..`upper` at the largest second difference of the k-means cost.

    Kept offset: the index of the second difference plus two, inside the range.
    """
    rows = _features(vectors)
    candidates = list(range(lower, upper + 1))
    costs = [
        KMeans(k=k, seed=42, maxIter=50, featuresCol="__features").fit(rows).summary.trainingCost for k in candidates
    ]
    bends = np.diff(costs, 2)
    at = int(np.argmax(bends)) + 2 if len(bends) else len(candidates) - 1
    return candidates[min(at, len(candidates) - 1)]


def hierarchical(vectors: DataFrame, k: int) -> DataFrame:
    """k groups by repeated bisection."""
    rows = _features(vectors)
    model = BisectingKMeans(k=k, seed=42, featuresCol="__features", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("__features")


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over `links` (a, b).

    Each round takes the smallest label around a node, then jumps to the label's own
    label, so path lengths halve. Rounds are written out and stop when nothing changes.
    """
    both = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    )
    state = materialize(nodes.select("id", F.col("id").alias("component")))
    while True:
        around = (
            both.join(state.select(F.col("id").alias("b"), F.col("component").alias("c")), "b")
            .groupBy("a")
            .agg(F.min("c").alias("c"))
        )
        low = state.join(around.withColumnRenamed("a", "id"), "id", "left").select(
            "id", "component", F.least("component", F.coalesce("c", "component")).alias("low")
        )
        target = low.select(F.col("id").alias("low"), F.col("low").alias("jump"))
        moved = materialize(
            low.join(target, "low", "left").select("id", F.coalesce("jump", "low").alias("component"), (F.coalesce("jump", "low") != F.col("component")).alias("moved"))
        )
        state = moved.select("id", "component")
        if moved.filter("moved").isEmpty():
            return state


def _links(eps: float):
    """Chains of rows within eps: one link from each row to the first one it connects to."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        ids = np.unique(np.concatenate([a, b]))
        ia, ib = np.searchsorted(ids, a), np.searchsorted(ids, b)
        root = np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in within(matrix(left["vec"]), matrix(right["vec"]), eps):
            while (root[root] != root).any():
                root = root[root]
            x, y = root[ia[i]], root[ib[j]]
            apart = x != y
            for pair in np.unique(np.minimum(x, y)[apart] * len(ids) + np.maximum(x, y)[apart]).tolist():
                p, q = find(pair // len(ids)), find(pair % len(ids))
                root[max(p, q)] = min(p, q)
        final = np.array([find(i) for i in range(len(ids))])
        keep = final != np.arange(len(ids))
        return pd.DataFrame({"a": ids[keep], "b": ids[final[keep]]})

    return kernel


def _near_weight(eps: float):
    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        w = right["weight"].to_numpy(dtype=np.int64)
        out = np.zeros(len(left), dtype=np.int64)
        for i, j in within(matrix(left["vec"]), matrix(right["vec"]), eps):
            first = np.flatnonzero(np.diff(i, prepend=-1))
            if len(first):
                out[i[first]] = np.add.reduceat(w[j], first)
        return pd.DataFrame({"id": left["id"].to_numpy(), "near": out})

    return kernel


def _lowest_label(eps: float):
    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        labels = right["component"].to_numpy()
        rows, found = [], []
        ids = left["id"].to_numpy()
        for i, j in within(matrix(left["vec"]), matrix(right["vec"]), eps):
            first = np.flatnonzero(np.diff(i, prepend=-1))
            if len(first):
                rows.append(ids[i[first]])
                found.append(np.minimum.reduceat(labels[j], first))
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"id": np.concatenate(rows or none), "component": np.concatenate(found or none)})

    return kernel


def dbscan(
    vectors: DataFrame,
    eps: float,
    min_samples: int,
    key: str = "vec_id",
    border: bool = True,
    min_cluster_size: int = 1,
    size: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """Density clusters (key, cluster); -1 is noise, clusters count from 0 by smallest core id.

    Equal vectors become one weighted point, so copies cost nothing. Neighbourhoods are
    looked for only in cells within eps of a point. The block kernels return one count,
    one link or one label per row, never the neighbour pairs.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), as_doubles(F.col("embedding")).alias("vec"))
    points = materialize(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    chosen = choose_pivots(points, points.count(), pivots)
    size = size or chunk_rows(chosen.shape[1] if len(chosen) else 1)
    placed = materialize(assign_cells(points, chosen))
    radius = _cell_radius(placed, len(chosen))
    flat = placed.drop("pivot_distance")
    reach = lambda d: np.full(len(d), eps)
    probe = lambda df: probe_cells(df.drop("cell", "pivot_distance"), chosen, radius, reach)
    near = grid_apply(probe(placed), flat, "cell", "id", "id", _near_weight(eps), "id long, near long", size)
    core_ids = near.groupBy("id").agg(F.sum("near").alias("near")).filter(F.col("near") >= min_samples).select("id")
    core_ids = materialize(core_ids)
    core = flat.join(core_ids, "id", "left_semi")
    links = grid_apply(
        probe(core).select("cell", "id", "vec"), core.select("cell", "id", "vec"), "cell", "id", "id", _links(eps), "a long, b long", size
    )
    parts = connected_components(core_ids, links)
    if border:
        rest = probe(flat.join(core_ids, "id", "left_anti")).select("cell", "id", "vec")
        edge = grid_apply(
            rest, core.join(parts, "id").select("cell", "id", "vec", "component"), "cell", "id", "id",
            _lowest_label(eps), "id long, component long", size,
        )
        parts = parts.unionByName(edge.groupBy("id").agg(F.min("component").alias("component")))
    labelled = points.join(parts, "id", "left")
    sizes = labelled.filter(F.col("component").isNotNull()).groupBy("component").agg(F.sum("weight").alias("members"))
    kept = sizes.filter(F.col("members") >= min_cluster_size).select("component")
    numbers = ranked(kept, [], [F.col("component")], "number").select("component", (F.col("number") - 1).alias("cluster"))
    by_point = labelled.join(numbers, "component", "left").select("vec", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
    return rows.join(by_point, "vec").select(F.col("id").alias(key), "cluster")


def dbscan_star(vectors: DataFrame, eps: float, min_samples: int, min_cluster_size: int, key: str = "vec_id", **blocks) -> DataFrame:
    """Density clusters of core points only, small clusters turned into noise.

    At one level of mutual reachability, points are linked when both are core and lie
    within eps, which is the core part of `dbscan`.
    """
    return dbscan(vectors, eps, min_samples, key, border=False, min_cluster_size=min_cluster_size, **blocks)
