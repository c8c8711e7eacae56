"""Novelty detectors: (vec_id, score, label), label -1 for novel and 1 for known."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from estuarine.functions.vectors import l2
from estuarine.operators.blocks import matrix
from estuarine.operators.clustering import dbscan
from estuarine.operators.ordered import exact_quantiles, top_per_group
from estuarine.operators.vectors import (
    TIE_DIGITS,
    as_doubles,
    centroids,
    cluster_coherence,
    knn_join,
)
from estuarine.session import materialize

# Detector settings.
TREES, TREE_SAMPLE, CONTAMINATION = 100, 256, 0.1
NEIGHBOURS, LOF_NEIGHBOURS, QUANTILE = 5, 20, 0.95
ABUNDANCE_MIN = 0.001
EULER_GAMMA = 0.5772156649015329


def _label(novel) -> object:
    return F.when(novel, -1).otherwise(1).alias("label")


def _threshold(df: DataFrame, value: str, q: float) -> DataFrame:
    """One-row frame with the exact quantile of a column."""
    return exact_quantiles(df.select(value), [], value, {"threshold": q})


def knn_novelty(ref: DataFrame, query: DataFrame, k: int = NEIGHBOURS, quantile: float = QUANTILE) -> DataFrame:
    """Novel if the mean distance to the k nearest references passes the reference quantile.

    The threshold is a quantile of the k-th distances inside the reference, each point
    counting as its own first neighbour.
    """
    inner = knn_join(ref, ref, k, "l2").groupBy("query_id").agg(F.max("value").alias("kth"))
    outer = knn_join(query, ref, k, "l2").groupBy("query_id").agg(F.avg("value").alias("mean_distance"))
    cut = F.broadcast(_threshold(inner, "kth", quantile))  # one row
    return outer.join(cut).select(
        F.col("query_id").alias("vec_id"),
        (-F.col("mean_distance")).alias("score"),
        _label(F.col("mean_distance") > F.col("threshold")),
    )


def centroid_novelty(
    ref: DataFrame, query: DataFrame, eps: float, min_samples: int, quantile: float = QUANTILE
) -> DataFrame:
    """Novel if farther from every reference cluster centre than most members are from theirs."""
    labels = dbscan(ref, eps, min_samples)
    members = ref.join(labels, "vec_id").filter(F.col("cluster") != -1)
    centres = materialize(centroids(members))
    # rounded like the search results it is compared with
    gap = F.round(l2(F.col("embedding"), F.col("centroid")), TIE_DIGITS)
    inner = members.join(centres, "cluster").select(gap.alias("d"))
    cut = F.broadcast(_threshold(inner, "d", quantile))  # one row
    nearest = knn_join(
        query, centres.select(F.col("cluster").cast("long").alias("vec_id"), F.col("centroid").alias("embedding")), 1, "l2"
    )
    return nearest.join(cut).select(
        F.col("query_id").alias("vec_id"),
        (-F.col("value")).alias("score"),
        _label(F.col("value") > F.col("threshold")),
    )


def lof(ref: DataFrame, query: DataFrame, k: int = LOF_NEIGHBOURS, contamination: float = CONTAMINATION) -> DataFrame:
    """Local outlier factor of queries against a reference.

    Reference densities leave the point itself out. The score is the negative factor;
    novel lies below the contamination quantile of the reference's own scores.
    """
    around = materialize(
        knn_join(ref, ref, k + 1, "l2").filter(F.col("query_id") != F.col("ref_id")).transform(
            lambda d: top_per_group(d.drop("rank"), ["query_id"], [F.asc("value"), F.asc("ref_id")], k)
        )
    )
    kth = materialize(around.groupBy(F.col("query_id").alias("ref_id")).agg(F.max("value").alias("kdist")))

    def density(pairs: DataFrame) -> DataFrame:
        reach = F.greatest("value", "kdist")
        return pairs.join(kth, "ref_id").groupBy("query_id").agg((1 / (F.avg(reach) + 1e-10)).alias("lrd"))

    lrd_ref = materialize(density(around).withColumnRenamed("query_id", "ref_id").withColumnRenamed("lrd", "lrd_ref"))

    def factor(pairs: DataFrame, own: DataFrame) -> DataFrame:
        mean = pairs.join(lrd_ref, "ref_id").groupBy("query_id").agg(F.avg("lrd_ref").alias("m"))
        return mean.join(own, "query_id").select("query_id", (-F.col("m") / F.col("lrd")).alias("score"))

    inner = factor(around, lrd_ref.select(F.col("ref_id").alias("query_id"), F.col("lrd_ref").alias("lrd")))
    cut = F.broadcast(_threshold(inner, "score", contamination))  # one row
    found = materialize(knn_join(query, ref, k, "l2"))
    return factor(found, density(found)).join(cut).select(
        F.col("query_id").alias("vec_id"), "score", _label(F.col("score") < F.col("threshold"))
    )


def _distance(mean: np.ndarray, inverse: np.ndarray):
    @pandas_udf("double")
    def squared(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        c = matrix(v) - mean
        return pd.Series(np.einsum("ij,jk,ik->i", c, inverse, c))

    return squared


def _moments(rows: DataFrame, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of `vec`, from one aggregation of d*d sums."""

    def sums(batches):
        total, cross, n = np.zeros(d), np.zeros((d, d)), 0
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["vec"])
                total, cross, n = total + x.sum(axis=0), cross + x.T @ x, n + len(x)
        yield pd.DataFrame({"i": np.arange(d * d + d + 1), "x": np.concatenate([cross.ravel(), total, [n]])})

    # d*d + d + 1 numbers per task, added up by position
    parts = rows.select("vec").mapInPandas(sums, "i int, x double")
    flat = np.array([r.x for r in parts.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])
    n = flat[-1]
    mean = flat[d * d : d * d + d] / n
    return n, mean, flat[: d * d].reshape(d, d) / n - np.outer(mean, mean)


def _scored_against(ref: DataFrame, query: DataFrame, mean: np.ndarray, cov: np.ndarray, contamination: float) -> DataFrame:
    squared = _distance(mean, np.linalg.pinv(cov, hermitian=True))
    scored = lambda df: df.select("vec_id", F.round(-squared(as_doubles(F.col("embedding"))), 9).alias("score"))
    cut = F.broadcast(_threshold(scored(ref), "score", contamination))  # one row
    return scored(query).join(cut).select("vec_id", "score", _label(F.col("score") < F.col("threshold")))


def mahalanobis_novelty(ref: DataFrame, query: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Squared Mahalanobis distance to the reference mean; novel above its upper quantile."""
    d = len(ref.select("embedding").head()[0])
    _, mean, cov = _moments(ref.select(as_doubles(F.col("embedding")).alias("vec")), d)
    return _scored_against(ref, query, mean, cov, contamination)


def _concentrated(x: np.ndarray, h: int, start: np.ndarray, rounds: int = 30) -> tuple[float, np.ndarray, np.ndarray]:
    """(log determinant, mean, covariance) after concentration steps on a sample held in memory."""
    best = None
    for i in range(rounds + 1):
        mean, cov = x[start].mean(0), np.cov(x[start].T, bias=True).reshape(x.shape[1], -1)
        size = np.linalg.slogdet(cov + 1e-12 * np.eye(len(cov)))[1]
        if i and best is not None and size >= best[0] - 1e-12:
            break
        # the subset at the start is smaller, so its determinant says nothing
        best = (size, mean, cov) if i or len(start) >= h else None
        c = x - mean
        start = np.argsort(np.einsum("ij,jk,ik->i", c, np.linalg.pinv(cov, hermitian=True), c), kind="stable")[:h]
    return best


def robust_location(
    rows: DataFrame, support: float | None = None, starts: int = 30, sample: int = 2000, finalists: int = 2, rounds: int = 30
) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the part of the rows (id, vec) with the smallest covariance determinant.

    Fast minimum covariance determinant: small random subsets of a bounded sample, chosen by a hash of the id, are concentrated there, and
    the best few of them on all rows. A step takes the `support` share (by default just over half) of the
    rows that lie nearest, by an exact quantile, and their moments, until the determinant stands still. At last all rows
    within the 0.975 quantile of a chi-squared distance count (its quantiles by the cube-root rule).
    """
    d = len(rows.select("vec").head()[0])
    x = np.array([r.vec for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()], dtype=np.float64)
    total = rows.count()
    share = support or min(1.0, (total + d + 1) / (2 * total))
    h = max(min(len(x), d + 1), int(np.ceil(share * len(x))))
    rng = np.random.default_rng(42)
    tried = [_concentrated(x, h, rng.choice(len(x), min(d + 1, len(x)), replace=False), 3) for _ in range(starts)]

    def nearest(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        c = x - mean
        return np.argsort(np.einsum("ij,jk,ik->i", c, np.linalg.pinv(cov, hermitian=True), c), kind="stable")[:h]

    found = []
    for _, mean, cov in sorted(tried, key=lambda t: t[0])[:finalists]:
        _, mean, cov = _concentrated(x, h, nearest(mean, cov))
        size = np.inf
        for _ in range(rounds):
            near = rows.select("vec", _distance(mean, np.linalg.pinv(cov, hermitian=True))("vec").alias("far"))
            limit = _threshold(near, "far", share).first()[0]
            _, new_mean, new_cov = _moments(near.filter(F.col("far") <= limit), d)
            new = np.linalg.slogdet(new_cov + 1e-12 * np.eye(d))[1]
            if new >= size - 1e-4:
                break
            size, mean, cov = new, new_mean, new_cov
        found.append((size, mean, cov))
    _, mean, cov = min(found, key=lambda t: t[0])
    near = rows.select("vec", _distance(mean, np.linalg.pinv(cov, hermitian=True))("vec").alias("far"))
    chi = lambda z: d * (1 - 2 / (9 * d) + z * np.sqrt(2 / (9 * d))) ** 3
    scale = _threshold(near, "far", 0.5).first()[0] / chi(0.0)
    if scale > 0:
        _, mean, cov = _moments(near.filter(F.col("far") <= chi(1.959964) * scale), d)
    return mean, cov


def robust_envelope(ref: DataFrame, query: DataFrame, contamination: float = CONTAMINATION, support: float | None = None, **search) -> DataFrame:
    """Squared Mahalanobis distance to the robust centre of the reference, which outliers in it don't move; novel above its upper quantile."""
    rows = materialize(ref.select(F.col("vec_id").alias("id"), as_doubles(F.col("embedding")).alias("vec")))
    mean, cov = robust_location(rows, support, **search)
    return _scored_against(ref, query, mean, cov, contamination)


def _grow(x: np.ndarray, seed: int) -> list[tuple]:
    """One random tree as rows (feature, cut, left, right, adjusted depth at leaves)."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.nonzero(spread > 0)[0]
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[at] = (-1, 0.0, -1, -1, depth + expected_depth(len(rows)))
            return at
        f = int(rng.choice(usable))
        low = x[rows, f].min()
        cut = low + rng.random() * spread[f]
        side = x[rows, f] < cut
        nodes[at] = (f, cut, build(rows[side], depth + 1), build(rows[~side], depth + 1), 0.0)
        return at

    build(np.arange(len(x)), 0)
    return nodes


def expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def isolation_forest(
    ref: DataFrame,
    query: DataFrame,
    trees: int = TREES,
    sample: int = TREE_SAMPLE,
    contamination: float = CONTAMINATION,
    seed: int = 42,
) -> DataFrame:
    """Isolation forest fitted on the standardised reference.

    Each tree takes the `sample` rows of lowest seeded hash, found by a partial top-n,
    and is grown by a task of its own; the forest is bounded by trees * sample nodes.
    The score is positive for known rows; the reference quantile is zero.
    """
    dims = len(ref.select("embedding").head()[0])
    moments = ref.select(F.posexplode(as_doubles(F.col("embedding"))).alias("i", "x")).groupBy("i").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s")
    )
    stats = {r.i: (r.m, r.s) for r in moments.collect()}  # one row per dimension
    mean = np.array([stats[i][0] for i in range(dims)])
    scale = np.array([stats[i][1] or 1.0 for i in range(dims)])
    ids = ref.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    ids = ids.withColumn("h", F.xxhash64("vec_id", "tree", F.lit(seed)))
    picks = top_per_group(ids, ["tree"], [F.asc("h"), F.asc("vec_id")], sample)
    # picks has at most trees * sample rows of three numbers
    drawn = ref.select("vec_id", as_doubles(F.col("embedding")).alias("vec")).join(F.broadcast(picks), "vec_id")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "vec_id"])
        tree = int(pdf["tree"].iloc[0])
        rows = _grow((matrix(pdf["vec"]) - mean) / scale, seed * 1000 + tree)
        out = pd.DataFrame(rows, columns=["feature", "cut", "left", "right", "depth"])
        return out.assign(tree=tree, node=np.arange(len(out)), size=len(pdf))

    # at most trees * 2 * sample small rows
    forest = drawn.groupBy("tree").applyInPandas(
        grow, "feature int, cut double, left int, right int, depth double, tree int, node int, size int"
    ).toPandas()
    grown = [t.sort_values("node") for _, t in forest.groupby("tree")]
    packed = [tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")) for t in grown]
    norm = expected_depth(int(forest["size"].max()))

    @pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = (matrix(v) - mean) / scale
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, depth in packed:
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(feature[at], 0)] < cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += depth[at]
        return pd.Series(-np.exp2(-(total / len(packed)) / norm))

    scored = lambda df: df.select("vec_id", score(as_doubles(F.col("embedding"))).alias("raw"))
    cut = F.broadcast(_threshold(scored(ref), "raw", contamination))  # one row
    return scored(query).join(cut).select(
        "vec_id", (F.col("raw") - F.col("threshold")).alias("score"), _label(F.col("raw") < F.col("threshold"))
    )


def ensemble(results: list[DataFrame], voting: str = "hard") -> DataFrame:
    """Combine detectors: majority of labels (ties are novel) or sign of the mean score."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    votes = rows.groupBy("vec_id").agg(F.sum("label").alias("votes"), F.avg("score").alias("score"))
    novel = F.col("votes") <= 0 if voting == "hard" else F.col("score") <= 0
    return votes.select("vec_id", "score", _label(novel))


Detector = Callable[[DataFrame, DataFrame], DataFrame]


def analyze_novelty(ref: DataFrame, query: DataFrame, detectors: list[Detector] | None = None) -> DataFrame:
    """Novel when any detector says so and the row is abundant enough.

    `query` may carry `abundance`; rarer rows than the limit count as known.
    """
    detectors = detectors or [isolation_forest, knn_novelty]
    rows = detectors[0](ref, query)
    for d in detectors[1:]:
        rows = rows.unionByName(d(ref, query))
    any_novel = rows.groupBy("vec_id").agg(F.min("label").alias("label"))
    if "abundance" in query.columns:
        any_novel = any_novel.join(query.select("vec_id", "abundance"), "vec_id")
        rare = F.col("abundance") < ABUNDANCE_MIN
        return any_novel.select("vec_id", F.when(rare, 1).otherwise(F.col("label")).alias("label"))
    return any_novel


def novelty_report(labels: DataFrame, query: DataFrame) -> DataFrame:
    """Totals with the novel share, and coherence of the query clusters when given."""
    total = labels.agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.count_if(F.col("label") == -1).alias("novel_candidates"),
    ).withColumn("novel_percentage", F.col("novel_candidates") * 100.0 / F.col("total_sequences"))
    if "cluster" not in query.columns:
        return total
    return cluster_coherence(query).join(F.broadcast(total))  # one row


def novel_summary(novel: DataFrame, ref: DataFrame, n: int = 5) -> DataFrame:
    """Distance of novel rows to the nearest reference, overall (cluster null) and per cluster.

    Cluster rows list the `n` first members; noise only counts in the overall row.
    """
    nearest = knn_join(novel, ref, 1, "l2").select(F.col("query_id").alias("vec_id"), F.col("value").alias("d"))
    rows = materialize(nearest.join(novel.select("vec_id", "cluster"), "vec_id"))
    stats = [
        F.count(F.lit(1)).alias("n_sequences"),
        F.avg("d").alias("avg_distance"),
        F.stddev_pop("d").alias("std_distance"),
        F.min("d").alias("min_distance"),
        F.max("d").alias("max_distance"),
    ]
    overall = rows.agg(*stats).select(F.lit(None).cast("int").alias("cluster"), "*")
    members = rows.filter(F.col("cluster") != -1)
    per = members.groupBy(F.col("cluster").cast("int").alias("cluster")).agg(*stats)
    first = top_per_group(members, ["cluster"], [F.asc("vec_id")], n)
    reps = first.groupBy(F.col("cluster").cast("int").alias("cluster")).agg(
        F.array_sort(F.collect_list("vec_id")).alias("representatives")
    )
    none = F.lit(None).cast("array<bigint>").alias("representatives")
    return per.join(reps, "cluster").unionByName(overall.select("*", none))
