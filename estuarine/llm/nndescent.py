"""Near-duplicate vectors by NN-descent.

A neighbour graph with `k` neighbours per vector is started from blocks of vectors that lie next to each
other in the order of random-hyperplane codes, and refined by rounds in which every vector compares
its neighbours, and those that have it as a neighbour, with each other. Edges at the threshold are
the links. Where all of a vector's neighbours are links its list is saturated: then its group, the
component over somewhat weaker edges, gets lists as long as the group, by exact comparison in blocks.
An audit against exact scans for a bounded set of vectors decides whether more rounds are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estuarine.llm.common import grouped
from estuarine.llm.unionfind import components
from estuarine.session import materialize

BLOCK = 256
GRID = 512


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame, str]:
    """(id, grp, vec) per usable row, (node, grp, vec, w) per distinct vector, and numpy's name of the type.

    A group holds the vectors of one label and one length.
    """
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(fine).filter(F.coalesce(sound, F.lit(False)))

    def run(batches):
        for batch in batches:
            vec = [np.asarray(x, kind).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary())], names=["id", "grp", "vec"])

    group = F.concat_ws(":", F.size(v), F.col(label_col).cast("string"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), group.alias("grp"), v.alias("vec")).mapInArrow(run, "id long, grp string, vec binary")
    folded = rows.groupBy("grp", "vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("w"))
    return rows, materialize(folded), kind


def _edges(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["a", "b", "sim"])

    for part in found:
        held.append(part)
        n += len(part[0])
        if n > size:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _best(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar others of every vector of a block."""
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    near = np.argpartition(-sim, k - 1, 1)[:, :k]
    return np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(sim, near, 1).ravel()


def start(nodes: DataFrame, kind: str, k: int, orders: int) -> DataFrame:
    """First neighbours, from blocks of the sorted codes of several random-hyperplane orders."""

    def coded(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids, groups, raw = batch.column(0), batch.column(1), batch.column(2)
            sizes = np.array([len(r) for r in raw.to_pylist()])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = unit(raw.take(pa.array(at)).to_pylist(), kind)
                for r in range(orders):
                    key = (int(size), r)
                    if key not in planes:
                        planes[key] = np.random.default_rng([3, r]).normal(size=(x.shape[1], 40))
                    code = ((x @ planes[key] > 0) @ (1 << np.arange(39, -1, -1))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([groups.take(pa.array(at)), pa.array([r] * len(at), pa.int32()), pa.array(code), ids.take(pa.array(at)), raw.take(pa.array(at))], names=["grp", "r", "code", "node", "vec"])

    def blocks(batches):
        def found():
            for rows in grouped(batches, 2, BLOCK):
                if len(rows) > 1:
                    yield _best(np.array([x[2] for x in rows]), unit([x[3] for x in rows], kind), k)

        yield from _edges(found())

    codes = nodes.select("node", "grp", "vec").mapInArrow(coded, "grp string, r int, code long, node long, vec binary")
    order = ["grp", "r", "code", "node"]
    return codes.repartitionByRange(*order).sortWithinPartitions(*order).select("grp", "r", "node", "vec").mapInArrow(blocks, "a long, b long, sim double")


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of every vector."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).select("*", place.alias("place")).filter(F.col("place") <= k).drop("place")


def refine(edges: DataFrame, nodes: DataFrame, kind: str, k: int) -> DataFrame:
    """One round: neighbours of a common neighbour, either way, are compared; the k best stay."""
    both = nearest(edges.union(edges.select("b", "a", "sim")), 2 * k)
    worst = edges.groupBy("a").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n"))
    bar = worst.select(F.col("a").alias("node"), F.when(F.col("n") >= k, F.col("worst")).otherwise(-2.0).alias("bar"))
    member = both.select(F.col("a").alias("hub"), F.col("b").alias("node")).union(nodes.select(F.col("node").alias("hub"), "node"))
    rows = member.join(nodes.select("node", "vec"), "node").join(bar, "node", "left").select("hub", "node", "vec", F.coalesce("bar", F.lit(-2.0)).alias("bar"))

    def run(batches):
        def found():
            for got in grouped(batches, 1):
                if len(got) > 1:
                    ids, bars = np.array([x[1] for x in got]), np.array([x[3] for x in got])
                    a, b, sim = _best(ids, unit([x[2] for x in got], kind), k)
                    better = sim > np.repeat(bars, len(a) // len(ids))
                    yield a[better], b[better], sim[better]

        yield from _edges(found())

    new = rows.repartition("hub").sortWithinPartitions("hub").mapInArrow(run, "a long, b long, sim double")
    return nearest(edges.union(new), k)


def _forest(near: np.ndarray) -> np.ndarray:
    """A root for each row of a symmetric matrix of links."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            root[i] = i
            front = np.array([i])
            while len(front):
                reached = near[front].any(0) & (root < 0)
                front = np.flatnonzero(reached)
                root[front] = i
    return root


def group_links(groups: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(node, links, other) from exact comparison of all pairs inside each group, in blocks.

    `groups` is (comp, node, w, vec). `links` are weighted and to be summed per node; `other` is a
    node linked with it, directly or over the block, enough to connect what is connected.
    """
    sizes = groups.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / GRID).cast("int").alias("n"))
    slots = groups.join(sizes, "comp").withColumn("s", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = slots.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("comp", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "s", "node", "w", "vec")

    def run(batches):
        for rows in grouped(batches, 3):
            ids, w = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
            side = np.array([r[3] for r in rows])
            x = unit([r[6] for r in rows], kind)
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if rows[0][1] != rows[0][2]:
                near &= side[:, None] != side[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ w), pa.array(ids[_forest(near)])], names=["node", "links", "other"])

    order = ["comp", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "s", "node", "w", "vec").mapInArrow(run, "node long, links long, other long")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a")).distinct()


def links_of(edges: DataFrame, nodes: DataFrame, kind: str, threshold: float, loose: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) for linked nodes, weighted, and pairs (a, b) that connect what is linked."""
    strong = materialize(edges.filter(F.col("sim") >= threshold))
    full = strong.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("node")
    weak = edges.filter(F.col("sim") >= loose)
    ends = weak.select(F.col("a").alias("id")).union(weak.select(F.col("b").alias("id"))).distinct()
    comp = components(ends, weak).withColumnRenamed("id", "node")
    dense = comp.join(full, "node", "left_semi").select("component").distinct()
    crowd = materialize(comp.join(dense, "component", "left_semi").select(F.col("component").alias("comp"), "node"))
    exact = materialize(group_links(crowd.join(nodes.select("node", "w", "vec"), "node"), kind, threshold))
    sparse = _pairs(strong.join(crowd.select(F.col("node").alias("a")), "a", "left_anti"))
    weights = nodes.select(F.col("node").alias("b"), "w")
    counted = sparse.join(weights, "b").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("links"))
    counted = counted.union(exact.groupBy("node").agg(F.sum("links").alias("links")))
    return materialize(counted), materialize(strong.select("a", "b").union(exact.filter("node <> other").select("node", "other")))


def audit(nodes: DataFrame, found: DataFrame, kind: str, threshold: float, sample: int = 256) -> float:
    """Share of the true links of `sample` linked or unlinked nodes that were found; 1 if there are none.

    The sample are the nodes with the smallest hashes: half of all, half of those with a link.
    """
    by_hash = [F.xxhash64("node"), F.col("node")]
    some = nodes.orderBy(*by_hash).limit(sample // 2).select("node")
    linked = found.orderBy(*by_hash).limit(sample // 2).select("node")
    asked = nodes.join(F.broadcast(some.union(linked).distinct()), "node").select("node", "grp", "vec").collect()
    if not asked:
        return 1.0
    groups: dict[str, list[int]] = {}
    for i, r in enumerate(asked):
        groups.setdefault(r["grp"], []).append(i)
    queries = {g: (np.array([asked[i]["node"] for i in at]), unit([bytes(asked[i]["vec"]) for i in at], kind)) for g, at in groups.items()}

    def run(batches):
        for batch in batches:
            kinds = np.array(batch.column(1).to_pylist(), object)
            for g in set(kinds.tolist()) & set(queries):
                at = np.flatnonzero(kinds == g)
                ids, x = queries[g]
                part = batch.take(pa.array(at))
                near = unit(part.column(2).to_pylist(), kind) @ x.T >= threshold
                near &= np.asarray(part.column(0))[:, None] != ids[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.asarray(part.column(3)) @ near)], names=["node", "n"])

    true = nodes.select("node", "grp", "vec", "w").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    hit = F.least("n", F.coalesce("links", F.lit(0)))
    got = true.join(found, "node", "left").agg(F.sum(hit).alias("hit"), F.sum("n").alias("all")).first()
    return got["hit"] / got["all"] if got["all"] else 1.0


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    k: int = 10,
    orders: int = 6,
    rounds: int = 2,
    recall: float = 0.99,
    most_rounds: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    report: Callable[[float], None] | None = None,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `vectors`.

    Links join vectors with equal labels whose cosine, in double precision, is `threshold` or more; no
    pair below it is linked. Equal vectors are folded and count with their number. After `rounds`
    rounds the audit's recall is handed to `report`; below `recall` more rounds follow.

    Rows whose vector is null, empty, zero or has null or non-finite components, or whose label is
    null, link with nothing. A row without id links with nothing and stays, with a null component.
    Vectors of different lengths never link. Rows with one id count as one vector's copies.
    Other columns are ignored; an empty table gives no rows.
    """
    loose = max(threshold - 0.03, 0.0)
    rows, nodes, kind = nodes_of(vectors, id_col, vec_col, label_col)
    edges = materialize(nearest(start(nodes, kind, k, orders), k))
    done = 0
    while True:
        for _ in range(max(1, rounds - done)):
            edges = materialize(refine(edges, nodes, kind, k))
            done += 1
        found, pairs = links_of(edges, nodes, kind, threshold, loose, k)
        share = audit(nodes, found, kind, threshold)
        if report:
            report(share)
        if share >= recall or done >= most_rounds:
            break
    label = components(nodes.select(F.col("node").alias("id")), pairs).withColumnRenamed("id", "node")
    facts = nodes.select("node", "grp", "vec", "w").join(label, "node").join(found, "node", "left")
    facts = facts.select("grp", "vec", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component")
    usable = rows.join(facts, ["grp", "vec"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    usable = usable.toDF("__id", "n_links", "component")
    out = vectors.select(F.col(id_col).cast("long").alias(id_col)).join(usable, F.col(id_col) == F.col("__id"), "left")
    component = F.coalesce("component", F.col(id_col))
    return out.select(F.col(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))
