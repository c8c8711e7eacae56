"""Nearest vectors by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is put into one of its leaves. A query walks the tree
best bin first: a priority queue holds nodes by the inner product that their best vector may be
expected to have, and leaves are taken as they come out. How many leaves are visited is calibrated: the exact
neighbours of some queries are found by a scan, and visits are widened until the leaves visited hold the
wanted share of them, for the queries used in choosing and for others that only audit.
Queries then meet the vectors of their leaves in tiles of bounded size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estuarine.llm.common import ranges, starts
from estuarine.session import materialize

BRANCHES = 8
#: Vectors of a tile and, on average, queries of a tile.
TILE = 16_384
#: Queries whose exact neighbours are scanned for, half of them to choose the visits, half to audit.
CALIBRATION = 256


@dataclass
class Tree:
    """Nodes in depth-first order; `leaf` is a leaf's number, or -1."""

    centre: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def expected(self, q: np.ndarray) -> np.ndarray:
        """(queries, nodes): the inner product to be expected of a node's best vector."""
        return q @ self.centre.T + np.sqrt((q * q).sum(1))[:, None] * self.spread

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector: the nearest centre on every level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            below = np.array(self.children[node])
            near = _nearest(x[rows], self.centre[below])
            todo += [(int(c), rows[near == i]) for i, c in enumerate(below) if (near == i).any()]
        return out

    def visit(self, expected: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves of one query, best bin first."""
        heap, out = [(-expected[0], 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
            for child in self.children[node]:
                heapq.heappush(heap, (-expected[child], child))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Labels of k-means, started from far-apart rows drawn by their squared distance."""
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and far.max() > 0:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    label = _nearest(x, c)
    for _ in range(rounds):
        c = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(len(c))])
        new = _nearest(x, c)
        if (new == label).all():
            break
        label = new
    return label


def fit(x: np.ndarray, total: int, per_leaf: int) -> Tree:
    """A tree on the sample `x` of `total` vectors, with about `per_leaf` of them in a leaf."""
    rng = np.random.default_rng(7)
    most = max(8, per_leaf * len(x) // max(total, 1))
    centre, spread, children, leaf = [], [], [], []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        own, part = len(centre), x[rows]
        mean = part.mean(0)
        deviation = np.sqrt(((part - mean) ** 2).sum(1).mean() / x.shape[1])
        centre.append(mean)
        spread.append(deviation * np.sqrt(2 * np.log(max(2.0, len(rows) * total / len(x)))))
        children.append([])
        leaf.append(-1)
        label = kmeans(part, BRANCHES, rng) if len(rows) > most else np.zeros(len(rows), int)
        groups = np.unique(label)
        if len(groups) < 2:
            leaf[own] = leaves
            leaves += 1
        else:
            children[own] = [grow(rows[label == g]) for g in groups]
        return own

    grow(np.arange(len(x)))
    return Tree(np.array(centre), np.array(spread), children, np.array(leaf))


def unpack(column: pa.Array, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)


def best_pairs(q: np.ndarray, x: np.ndarray, first: np.ndarray, met: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best rows and some more for every query; `met` lists who meets whom.

    Ties go to the row with the smaller `first`. The products of whole blocks may be off in their last bit, so a
    few rows more than k are kept.
    """
    qi, ri, si = [], [], []
    for asked, rows in met:
        for a in range(0, len(asked), 256):
            part = asked[a : a + 256]
            s = q[part] @ x[rows].T
            least = np.partition(s, len(rows) - k, 1)[:, len(rows) - k] if len(rows) > k else np.full(len(part), -np.inf)
            i, j = np.nonzero(s >= (least - 1e-12 * np.abs(least))[:, None])
            qi.append(part[i])
            ri.append(rows[j])
            si.append(s[i, j])
    if not qi:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, r, s = np.concatenate(qi), np.concatenate(ri), np.concatenate(si)
    order = np.lexsort((first[r], -s, i))
    i, r = i[order], r[order]
    keep = _place(i) < k + 12
    return i[keep], r[keep]


def _place(key: np.ndarray) -> np.ndarray:
    """Position of every element among the equal ones before it; equal ones lie together."""
    new = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))


def ranked(q: np.ndarray, x: np.ndarray, ids: list[list[int]], met: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, id, score) of the k best ids of every query, best first, each id once."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for own in ids for i in own), np.int64, int(n.sum()))
    at = starts(n)[:-1]
    i, r = best_pairs(q, x, flat[at] if len(n) else flat, met, k)
    # summed pair by pair, so that a score doesn't depend on the block it was found in
    score = np.concatenate([(q[i[a : a + 4096]] * x[r[a : a + 4096]]).sum(1) for a in range(0, len(i), 4096)]) if len(i) else np.zeros(0)
    i, score, r, name = np.repeat(i, n[r]), np.repeat(score, n[r]), np.repeat(r, n[r]), flat[ranges(at[r], n[r])]
    order = np.lexsort((-score, name, i))
    i, r, name, score = i[order], r[order], name[order], score[order]
    once = (np.diff(i, prepend=-1) != 0) | (np.diff(name, prepend=name[:1] - 1) != 0)
    i, r, name, score = i[once], r[once], name[once], score[once]
    order = np.lexsort((name, -score, i))
    order = order[_place(i[order]) < k]
    return i[order], r[order], name[order], score[order]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(id, size, vec) of the rows that take part, and numpy's name of the numbers."""
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    v = F.col(vec_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))) & F.exists(v, lambda x: x != 0)
    fine = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(F.coalesce(sound, F.lit(False)))

    def run(batches):
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column(1)), np.int64)
            at = starts(size)
            raw = np.asarray(batch.column(1).flatten()).astype(kind).tobytes()
            width = np.dtype(kind).itemsize
            vec = [raw[a * width : b * width] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(vec, pa.binary())], names=["id", "size", "vec"])

    wide = v if kind == "<f4" else v.cast("array<double>")
    return fine.select(F.col(id_col).cast("long").alias("id"), wide.alias("v")).mapInArrow(run, "id long, size long, vec binary"), kind


def cells_of(rows: DataFrame, tree: Tree, kind: str, ids: int) -> DataFrame:
    """(leaf, vec, ids) per distinct vector, with its smallest `ids` ids: no more can be among the nearest."""
    order = Window.partitionBy("vec").orderBy("id")
    folded = rows.select("id", "vec").withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= ids)
    folded = folded.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))

    def run(batches):
        for batch in batches:
            if len(batch):
                leaf = tree.place(unpack(batch.column(0), kind))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(0), batch.column(1)], names=["leaf", "vec", "ids"])

    return folded.mapInArrow(run, "leaf long, vec binary, ids array<long>").withColumn("node", F.monotonically_increasing_id())


def calibrated(cells: DataFrame, asked: DataFrame, tree: Tree, kind: str, k: int, recall: float) -> tuple[int, float]:
    """Leaves to visit, and the recall that the auditing queries have with them."""
    chosen = asked.orderBy(F.xxhash64("query_id"), "node").limit(CALIBRATION).select("query_id", "vec").collect()
    q = np.frombuffer(b"".join(r["vec"] for r in chosen), kind).astype(np.float64).reshape(len(chosen), -1)

    def scan(batches):
        for batch in batches:
            x, ids, leaf = unpack(batch.column(0), kind), batch.column(1).to_pylist(), np.asarray(batch.column(2))
            for a in range(0, len(x), TILE):
                part = slice(a, a + TILE)
                every = [(np.arange(len(q)), np.arange(len(x[part])))]
                i, r, name, score = ranked(q, x[part], ids[part], every, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, name, score, leaf[part][r])], names=["i", "id", "score", "leaf"])

    near = _first(cells.select("vec", "ids", "leaf").mapInArrow(scan, "i long, id long, score double, leaf long"), "i", k + 1)
    own = [r["query_id"] for r in chosen]
    true: list[list[int]] = [[] for _ in chosen]
    for r in sorted(near.collect(), key=lambda r: (r["i"], -r["score"], r["id"])):
        if r["id"] != own[r["i"]] and len(true[r["i"]]) < k:
            true[r["i"]].append(r["leaf"])
    position = np.zeros(tree.leaves, np.int64)
    reached: tuple[list[int], list[int]] = ([], [])
    for i, expected in enumerate(tree.expected(q)):
        position[tree.visit(expected, tree.leaves)] = np.arange(tree.leaves)
        reached[i % 2].extend(position[true[i]].tolist())
    visits = 1
    while True:
        shares = [float(np.mean(np.array(x) < visits)) if x else 1.0 for x in reached]
        if min(shares) >= recall or visits >= tree.leaves:
            return visits, shares[1]
        visits = min(tree.leaves, visits + max(1, visits // 8))


def _first(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows (score, id) of every key, each id once."""
    once = Window.partitionBy(key, "id").orderBy(F.desc("score"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    dealt = found.repartition(key).withColumn("__n", F.row_number().over(once)).filter("__n = 1")
    return dealt.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k).drop("__n")


def search(cells: DataFrame, asked: DataFrame, tree: Tree, kind: str, k: int, visits: int) -> DataFrame:
    """(node, id, score): the k best ids in the leaves that each distinct query vector visits."""
    counts = np.zeros(tree.leaves, np.int64)
    for r in cells.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    # neighbouring leaves share a group up to the size of a tile; a larger leaf is a group of several blocks
    group = np.zeros(tree.leaves, np.int64)
    size: list[int] = []
    for i, n in enumerate(counts.tolist()):
        if not size or size[-1] + n > TILE:
            size.append(0)
        size[-1] += n
        group[i] = len(size) - 1
    blocks = [max(1, -(-n // TILE)) for n in size]

    def walk(batches):
        for batch in batches:
            if not len(batch):
                continue
            out: list[tuple[int, int, bytes, list[int]]] = []
            for name, vec, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tree.expected(unpack(batch.column(1), kind)), strict=True):
                to: dict[int, list[int]] = {}
                for leaf in tree.visit(expected, visits):
                    if counts[leaf]:
                        to.setdefault(int(group[leaf]), []).append(leaf)
                out += [(g, name, vec, leaves) for g, leaves in to.items()]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["grp", "node", "vec", "leaves"])

    queries = asked.select("node", "vec").dropDuplicates(["node"])
    ways = materialize(queries.mapInArrow(walk, "grp long, node long, vec binary, leaves array<long>"))
    salts = [1] * len(size)
    for r in ways.groupBy("grp").count().collect():
        salts[r["grp"]] = -(-r["count"] // TILE)

    def each(values: list[int], at) -> F.Column:
        return F.element_at(F.lit(np.array(values, np.int32)), at.cast("int") + 1)

    def dealt(n, name: str):
        return F.pmod(F.xxhash64(name), n).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = cells.withColumn("grp", each(group.tolist(), F.col("leaf")).cast("long"))
    left = left.withColumn("block", dealt(each(blocks, F.col("grp")), "node")).withColumn("salt", every(each(salts, F.col("grp"))))
    right = ways.withColumn("salt", dealt(each(salts, F.col("grp")), "node")).withColumn("block", every(each(blocks, F.col("grp"))))
    key = ["grp", "block", "salt"]

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        if len(vectors) and len(queries):
            x, ids, leaf = unpack(vectors.column("vec"), kind), vectors.column("ids").to_pylist(), np.asarray(vectors.column("leaf"))
            rows = {int(v): np.flatnonzero(leaf == v) for v in np.unique(leaf)}
            names, wanted = np.asarray(queries.column("node")), queries.column("leaves").to_pylist()
            all_q = unpack(queries.column("vec"), kind)
            order = sorted(range(len(names)), key=lambda i: wanted[i][0])
            for a in range(0, len(order), 512):
                part = order[a : a + 512]
                by_leaf: dict[int, list[int]] = {}
                for i, j in enumerate(part):
                    for v in wanted[j]:
                        if v in rows:
                            by_leaf.setdefault(v, []).append(i)
                i, _, name, score = ranked(all_q[part], x, ids, [(np.array(i), rows[v]) for v, i in by_leaf.items()], k)
                parts.append((names[part][i], name, score))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["node", "id", "score"])

    a, b = left.select(*key, "leaf", "vec", "ids").groupBy(*key), right.select(*key, "node", "vec", "leaves").groupBy(*key)
    return _first(a.cogroup(b).applyInArrow(meet, "node long, id long, score double"), "node", k)


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    recall: float = 0.95,
    sample: int = 2_000_000,
    per_leaf: int = 128,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score, visits, recall) for the rows whose id is divisible by `every`.

    Nearness is the largest inner product, in double precision; ties go to the smaller id. A query gets
    its `k` nearest found (all candidates, if fewer) among all rows but its own. `recall` is the wanted share of the true neighbours,
    as measured against scans for 256 queries; the column of that name is what the auditing half of them
    got, `visits` the leaves visited. The tree is fitted on a sample of about `sample` numbers; every vector is indexed, and where
    visits have to be widened to all leaves the result is exact. Equal vectors are folded: they keep their k + 1 smallest ids.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    without id. Vectors meet those of their own length only, each length is a search of its own. Rows alike in id and vector count once; an
    id with several vectors is found by its best one, never meets itself, and as a query has one list per
    vector. Other columns are ignored; an empty table gives no rows.
    """
    rows, kind = usable(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    out = None
    for size in rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("id") % every == 0).alias("some")).orderBy("size").collect():
        if not size["some"]:
            continue
        d, n = size["size"], size["n"]
        own = rows.filter(F.col("size") == d)
        share = min(1.0, sample / d / n)
        drawn = own.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
        x = unpack(drawn.select("vec").toArrow().column("vec"), kind)
        tree = fit(x if len(x) else np.zeros((1, d)), n, per_leaf)
        cells = materialize(cells_of(own, tree, kind, k + 1))
        asks = own.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec").distinct()
        asked = materialize(asks.join(cells.select("node", "vec"), "vec"))
        visits, got = calibrated(cells, asked, tree, kind, k, recall)
        top = search(cells, asked, tree, kind, k + 1, visits)
        found = asked.select("query_id", "node").join(top, "node").filter("id <> query_id")
        order = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = found.select("query_id", "rank", F.col("id").alias(id_col), "score", F.lit(visits).alias("visits"), F.lit(got).alias("recall"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double, visits int, recall double")
    return out
