"""Nearest neighbours, vector stores, projections and cluster descriptions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from estuarine.functions.sequences import kmer_windows, kmers
from estuarine.functions.vectors import l2, normalize
from estuarine.operators.blocks import CHUNK, Bounds, chunk_rows, distances, grid_apply, matrix, pair_distances
from estuarine.operators.ordered import top_per_group
from estuarine.session import materialize

TIE_DIGITS = 9
# A store of n vectors gets sqrt(n / PIVOT_ROWS) pivots.
PIVOT_ROWS = 4096


def as_doubles(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def _firsts(b: np.ndarray, runs: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of every distinct vector of a run: copies beyond them are nobody's neighbours."""
    rows = np.column_stack([b + 0.0, runs])
    _, same = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    start = np.flatnonzero(np.diff(same[order], prepend=-1))
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    return np.sort(order[place < k])


def _kernel(k: int, metric: str, exclude: bool, elements: int = 2**21):
    """The k nearest of a chunk: bounds in single precision leave a few candidates, which are compared exactly."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(left["vec"]), matrix(right["vec"])
        q, r = left["query_id"].to_numpy(), right["ref_id"].to_numpy()
        place = np.unique(r, return_inverse=True)[1]
        own, other = np.full(len(a), -1), np.full(len(b), -1)
        if exclude:
            runs, _ = pd.factorize(pd.concat([left["run"], right["run"]], ignore_index=True))
            own, other = runs[: len(a)], runs[len(a) :]
        order = np.lexsort((place, other))
        order = order[_firsts(b[order], other[order], k)]
        b, r, place, other = b[order], r[order], place[order], other[order]
        turn = np.argsort(own, kind="stable")
        a, q, own = a[turn], q[turn], own[turn]
        bounds = Bounds(a, b, metric)
        sample = np.unique(np.linspace(0, len(b) - 1, min(len(b), max(2048, 16 * k))).astype(int))
        step = max(1, elements // len(b))
        ids, refs, found = [], [], []

        def hide(cost: np.ndarray, start: int, cols: np.ndarray) -> None:
            """References of a query's own run are out of reach; both sides are in the order of runs."""
            for run in np.unique(own[start : start + len(cost)]):
                if run >= 0:
                    x, y = np.searchsorted(own, [run, run + 1]) - start, np.searchsorted(cols, [run, run + 1])
                    cost[max(x[0], 0) : max(x[1], 0), y[0] : y[1]] = np.inf

        for start in range(0, len(a), step):
            rows = slice(start, min(start + step, len(a)))
            some = bounds.upper(rows, sample)
            low = bounds.lower(rows)
            if exclude:
                hide(some, start, other[sample])
                hide(low, start, other)
            some[np.isnan(some)] = np.inf
            kth = np.partition(some, k - 1, axis=1)[:, k - 1] if k <= some.shape[1] else np.full(len(some), np.inf)
            # a tie at TIE_DIGITS may lie farther by one unit
            mask = low <= bounds.limit(kth, rows, 2 * 10.0**-TIE_DIGITS)[:, None]
            if len(b) > len(sample) and np.count_nonzero(mask) > 64 * k * len(mask):
                width = 2 * bounds.slop * (bounds.nb**2 + 2 * bounds.na[rows, None] * bounds.nb if metric == "l2" else bounds.na[rows, None] * bounds.nb)
                some = low + 2 * width.astype(low.dtype)
                some[np.isnan(some)] = np.inf
                kth = np.minimum(kth, np.partition(some, k - 1, axis=1)[:, k - 1])
                mask = low <= bounds.limit(kth, rows, 2 * 10.0**-TIE_DIGITS)[:, None]
            if exclude:
                mask &= low < np.inf
            i, j = np.divmod(np.flatnonzero(mask), len(b))
            value = np.empty(len(i))
            for part in range(0, len(i), elements // 16):
                at = slice(part, part + elements // 16)
                x = start + i[at]
                value[at] = np.einsum("ij,ij->i", a[x], b[j[at]]) if metric == "ip" else pair_distances(a, b, x, j[at])
            value = np.round(value, TIE_DIGITS)
            fine = np.isfinite(value)
            i, j, value = i[fine], j[fine], value[fine]
            by = np.lexsort((place[j], -value if metric == "ip" else value, i))
            i, j, value = i[by], j[by], value[by]
            head = np.searchsorted(i, i)
            kept = np.arange(len(i)) - head < k
            ids.append(q[start + i[kept]])
            refs.append(r[j[kept]])
            found.append(value[kept])
        return pd.DataFrame({"query_id": np.concatenate(ids), "ref_id": np.concatenate(refs), "value": np.concatenate(found)})

    return best


def choose_pivots(vectors: DataFrame, rows: int, wanted: int | None = None) -> np.ndarray:
    """Vectors picked by a hash of their id; their number grows with the root of the rows."""
    count = wanted or max(1, math.ceil(math.sqrt(rows / PIVOT_ROWS)))
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(count).select("vec").collect()
    return np.array([r.vec for r in picked], dtype=np.float64)


def assign_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add `cell` (nearest pivot) and `pivot_distance`."""

    def nearest(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            cell = np.empty(len(pdf), dtype=np.int32)
            dist = np.empty(len(pdf))
            for start, d in distances(matrix(pdf["vec"]), pivots):
                cell[start : start + len(d)] = d.argmin(axis=1)
                dist[start : start + len(d)] = d.min(axis=1)
            yield pdf.assign(cell=cell, pivot_distance=dist)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInPandas(nearest, f"{kinds}, cell int, pivot_distance double")


def probe_cells(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, reach) -> DataFrame:
    """One row per (query, cell to visit): cells whose ball is within the query's reach.

    `reach(distance_to_pivots)` gives the search radius of each query row.
    """

    def visit(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            for start, d in distances(matrix(pdf["vec"]), pivots):
                hit = d - radius[None, :] <= reach(d)[:, None] + 1e-9
                rows, cells = np.nonzero(hit)
                yield pdf.iloc[start + rows].assign(cell=cells.astype(np.int32))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInPandas(visit, f"{kinds}, cell int")


def _cell_radius(placed: DataFrame, cells: int) -> np.ndarray:
    radius = np.full(cells, -np.inf)
    for r in placed.groupBy("cell").agg(F.max("pivot_distance").alias("m")).collect():  # one row per pivot
        radius[r.cell] = r.m
    return radius


def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    metric: str = "ip",
    query_key: str = "vec_id",
    ref_key: str = "vec_id",
    exclude_run: str | None = None,
) -> DataFrame:
    """Exact k nearest references per query: (query_id, ref_id, value, rank).

    `ip` compares unit vectors by inner product, `l2` raw vectors by distance. References
    are grouped around pivots. The k members closest to each pivot bound a query's
    k-th distance, and cells that cannot hold anything closer are not visited. Visited
    cells are compared chunk by chunk, keeping k rows per query and chunk. Ties at nine
    decimals go to the smaller reference id. With `exclude_run` (references of the
    query's own run do not count) all cells are visited.
    """
    unit = (lambda c: normalize(c)) if metric == "ip" else as_doubles
    run = [F.col(exclude_run).alias("run")] if exclude_run else []
    q = queries.select(F.col(query_key).alias("query_id"), unit(F.col("embedding")).alias("vec"), *run)
    r = refs.select(F.col(ref_key).alias("ref_id"), unit(F.col("embedding")).alias("vec"), *run)
    rows = r.count()
    pivots = choose_pivots(r.withColumnRenamed("ref_id", "id"), rows)
    if len(pivots) <= 1:
        q, r = q.withColumn("cell", F.lit(0)), r.withColumn("cell", F.lit(0))
    else:
        placed = materialize(assign_cells(r, pivots))
        radius = _cell_radius(placed, len(pivots))
        near = top_per_group(placed.select("cell", "pivot_distance", "ref_id"), ["cell"], [F.asc("pivot_distance"), F.asc("ref_id")], k)
        inner: dict[int, list[float]] = {}
        for row in near.collect():  # k numbers per pivot
            inner.setdefault(row.cell, []).append(row.pivot_distance)
        cells = np.repeat(list(inner), [len(x) for x in inner.values()]).astype(int)
        steps = np.concatenate([np.array(x) for x in inner.values()])
        everything = exclude_run is not None or len(steps) < k

        def reach(d: np.ndarray) -> np.ndarray:
            if everything:
                return np.full(len(d), np.inf)
            return np.partition(d[:, cells] + steps[None, :], k - 1, axis=1)[:, k - 1]

        q, r = probe_cells(q, pivots, radius, reach), placed.drop("pivot_distance")
    dims = pivots.shape[1] if len(pivots) else 1
    # a few pairs of chunks for every core, or tables of middle size are compared by a handful of tasks
    even = math.ceil(rows / (2 * math.sqrt(q.sparkSession.sparkContext.defaultParallelism)))
    return _grid_knn(q, r, k, metric, exclude_run is not None, min(chunk_rows(dims), max(CHUNK, even)))


def _grid_knn(q: DataFrame, r: DataFrame, k: int, metric: str, exclude: bool = False, size: int = CHUNK) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in q.schema}
    ref_kind = r.schema["ref_id"].dataType.simpleString()
    schema = f"query_id {kinds['query_id']}, ref_id {ref_kind}, value double"
    found = grid_apply(q, r, "cell", "query_id", "ref_id", _kernel(k, metric, exclude), schema, size)
    order = [F.desc("value") if metric == "ip" else F.asc("value"), F.asc("ref_id")]
    return top_per_group(found, ["query_id"], order, k, "rank")


def search_vectors(
    queries: DataFrame, store: DataFrame, k: int, exclude_same_run: bool = False, run: str = "run_id"
) -> DataFrame:
    """k nearest stored vectors by Euclidean distance."""
    return knn_join(queries, store, k, "l2", exclude_run=run if exclude_same_run else None)


def ann_index(vectors: DataFrame, lists: int = 1, key: str = "vec_id", seed: int = 42):
    """Inverted lists around k-means centres: (indexed rows with `cell`, centres).

    One list makes the search exact. How many lists a larger store gets is the caller's
    choice, whatever its size; `ann_recall` measures what a choice costs.
    """
    rows = vectors.select(F.col(key).alias("ref_id"), as_doubles(F.col("embedding")).alias("vec"))
    if lists == 1:
        return rows.withColumn("cell", F.lit(0)), np.zeros((1, 1))
    featured = rows.withColumn("features", array_to_vector("vec"))
    model = KMeans(k=lists, seed=seed, maxIter=20, predictionCol="cell").fit(featured)
    return model.transform(featured).drop("features"), np.array(model.clusterCenters())


def ann_search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, nprobe: int, key: str = "vec_id") -> DataFrame:
    """Approximate k nearest by distance, looking into the `nprobe` closest lists."""
    q = queries.select(F.col(key).alias("query_id"), as_doubles(F.col("embedding")).alias("vec"))
    if len(centres) == 1:
        q = q.withColumn("cell", F.lit(0))
    else:
        radius = np.zeros(len(centres))
        n = min(nprobe, len(centres))
        q = probe_cells(q, centres, radius, lambda d: np.partition(d, n - 1, axis=1)[:, n - 1])
    first = index.select("vec").head()
    return _grid_knn(q, index, k, "l2", size=chunk_rows(len(first.vec) if first else 1))


def ann_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(neighbours, found, recall) of an approximate search against an exact one."""
    pair = ["query_id", "ref_id"]
    hit = exact.select(*pair).join(found.select(*pair, F.lit(1).alias("hit")), pair, "left")
    n, got = F.count(F.lit(1)), F.count("hit")
    return hit.agg(n.alias("neighbours"), got.alias("found"), (got / n).alias("recall"))


def consolidate(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Stored vectors plus those of runs the store does not have."""
    run = ["dataset", "run_id"]
    fresh = new.join(existing.select(*run).distinct(), run, "left_anti")
    return existing.unionByName(fresh)


def centroids(vectors: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean vector per cluster; sums are combined before the shuffle."""
    parts = (
        vectors.select(cluster, F.posexplode(as_doubles(F.col("embedding"))).alias("i", "x"))
        .groupBy(cluster, "i")
        .agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    )
    # one entry per dimension
    return parts.groupBy(cluster).agg(
        F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("n").alias("size")
    ).select(cluster, F.col("c.x").alias("centroid"), "size")


def cluster_representatives(vectors: DataFrame, n: int = 5, cluster: str = "cluster", key: str = "vec_id") -> DataFrame:
    """The n members nearest to each cluster centre, noise left out."""
    rows = vectors.filter(F.col(cluster) != -1)
    scored = rows.join(centroids(rows, cluster), cluster).select(
        cluster, key, F.round(l2(F.col("embedding"), F.col("centroid")), TIE_DIGITS).alias("distance")
    )
    return top_per_group(scored, [cluster], [F.asc("distance"), F.asc(key)], n, "position")


def cluster_stats(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, size) with the number of clusters and noise rows."""
    sizes = labels.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    totals = sizes.agg(
        F.count_if(F.col(cluster) != -1).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col(cluster) == -1, F.col("size"))), F.lit(0)).alias("n_noise"),
    )
    return sizes.join(F.broadcast(totals))  # one row


def calinski_harabasz(vectors: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Between over within dispersion from cluster sums alone."""
    cells = (
        vectors.select(cluster, F.posexplode(as_doubles(F.col("embedding"))).alias("i", "x"))
        .groupBy(cluster, "i")
        .agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    )
    dims = cells.groupBy("i").agg(
        F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between_raw"),
        F.sum("s").alias("s"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
    )
    b = F.sum(F.col("between_raw") - F.col("s") * F.col("s") / F.col("n"))
    w = F.sum(F.col("q") - F.col("between_raw"))
    n, k = F.max("n"), F.max("k")
    return dims.agg(
        k.alias("n_clusters"), F.when((k > 1) & (w > 0), (b / (k - 1)) / (w / (n - k))).alias("calinski_harabasz")
    )


def silhouette(vectors: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean silhouette on squared Euclidean distances, which needs cluster sums only."""
    rows = vectors.select(array_to_vector(as_doubles(F.col("embedding"))).alias("features"), F.col(cluster).cast("double").alias("prediction"))
    score = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(rows)
    return vectors.sparkSession.range(1).select(F.lit(float(score)).alias("silhouette"))


def cluster_coherence(vectors: DataFrame, cluster: str = "cluster", key: str = "vec_id", size: int | None = None) -> DataFrame:
    """1 / (1 + mean pairwise distance) per cluster; 0 for single members, noise left out.

    Chunk pairs yield one partial sum each; every unordered pair is counted twice.
    """
    rows = vectors.filter(F.col(cluster) != -1)
    side = rows.select(F.col(cluster).alias("cluster"), F.col(key).alias("id"), as_doubles(F.col("embedding")).alias("vec"))
    kind = side.schema["cluster"].dataType.simpleString()
    first = None if size else side.select("vec").head()
    size = size or chunk_rows(len(first.vec) if first else 1)

    def partial(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        total = sum(d.sum() for _, d in distances(matrix(left["vec"]), matrix(right["vec"])))
        return pd.DataFrame({"cluster": [left["cluster"].iloc[0]], "total": [total]})

    sums = grid_apply(side, side, "cluster", "id", "id", partial, f"cluster {kind}, total double", size)
    sums = sums.groupBy("cluster").agg(F.sum("total").alias("total"))
    n = F.col("size")
    counts = side.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    mean = F.col("total") / (n * (n - 1))
    return counts.join(sums, "cluster").select(
        F.col("cluster").alias(cluster), "size", F.when(n < 2, 0.0).otherwise(1 / (1 + mean)).alias("coherence")
    )


def embed_kmers(reads: DataFrame, k: int = 4, dims: int = 64, key: str = "sequence_id") -> DataFrame:
    """Hashed k-mer frequency vectors of unit length, one per row; counted inside the row, so nothing is shuffled."""
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int")
    slots = F.flatten(F.transform(kmer_windows(F.col("seq"), k), lambda part: F.transform(kmers(part, k), slot)))
    kind = reads.schema[key].dataType.simpleString()

    def count(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            found = column.flatten().to_numpy(zero_copy_only=False)  # without the slots of nulls
            ends = np.concatenate([[0], np.cumsum(sizes)])
            step = max(1, 2**22 // dims)
            for start in range(0, batch.num_rows, step):
                n = min(step, batch.num_rows - start)
                row = np.repeat(np.arange(n), sizes[start : start + n])
                counts = np.bincount(row * dims + found[ends[start] : ends[start + n]], minlength=n * dims).astype(np.float64)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dims, dims, dtype=np.int32)), pa.array(counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), vectors], names=[key, "counts"])

    counted = reads.select(key, slots.alias("slots")).mapInArrow(count, f"`{key}` {kind}, counts array<double>")
    return counted.select(key, normalize(F.col("counts")).alias("embedding"))


def embed_reads(reads: DataFrame, embedder, dims: int, key: str = "sequence_id") -> DataFrame:
    """Vectors from a user's model: `embedder(list_of_sequences) -> array [n, dims]`."""
    kind = reads.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = np.asarray(embedder(pdf["seq"].tolist()), dtype=np.float64).reshape(len(pdf), dims)
                yield pd.DataFrame({key: pdf[key], "embedding": list(out)})

    return reads.select(key, "seq").mapInPandas(run, f"`{key}` {kind}, embedding array<double>")


def reduce_vectors(vectors: DataFrame, n: int, key: str = "vec_id", unit: bool = True) -> DataFrame:
    """First n principal components of the centred vectors, scaled to unit length.

    A component's sign makes its largest loading positive.
    """
    rows = vectors.select(key, array_to_vector(as_doubles(F.col("embedding"))).alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(rows)
    model = PCA(k=n, inputCol="centred", outputCol="pc").fit(scaler.transform(rows))
    basis = model.pc.toArray()
    top = np.abs(basis).argmax(axis=0)
    basis = basis * np.where(basis[top, np.arange(n)] < 0, -1.0, 1.0)
    mean = scaler.mean.toArray()

    @pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((matrix(v) - mean) @ basis)) if len(v) else pd.Series([], dtype=object)

    reduced = project(as_doubles(F.col("embedding")))
    out = vectors.select(key, reduced.alias("embedding"))
    return out.select(key, normalize(F.col("embedding")).alias("embedding")) if unit else out


def project_2d(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """Plot coordinates from the first two components."""
    flat = reduce_vectors(vectors, 2, key, unit=False)
    return flat.select(key, F.get("embedding", 0).alias("x"), F.get("embedding", 1).alias("y"))
