"""Hierarchical density clustering (HDBSCAN): spanning tree, condensed tree, stable clusters.

The tree of mutual reachability distances grows in Boruvka rounds over the edges of neighbour lists. A list tells
how short an edge that is not in it can be at best, so most groups know that their shortest edge out is a listed one. The rows
that may have a shorter one look for it in the cells that can hold it, exactly; a row gives one edge, no pairs are written.

Only merges of two groups of `min_cluster_size` rows or more shape the condensed tree. They are found
without a dendrogram: two groups below that size are merged along an edge that is the shortest way out for both,
and where the shortest ways out lead to a group of that size, all groups on the way join it, each at its own edge. The remaining edges are the real splits; there are fewer
of them than rows / `min_cluster_size`, and their tree alone is worked out in one place, with numbers only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.operators.blocks import CHUNK, Bounds, chunk_rows, distances, grid_apply, matrix, pair_distances
from estuarine.operators.ordered import ranked
from estuarine.operators.vectors import TIE_DIGITS, _cell_radius, as_doubles, assign_cells, knn_join
from estuarine.session import materialize

#: A tree of n rows has sqrt(n / PIVOT_ROWS) pivots.
PIVOT_ROWS = 256
#: Distances below this count as this, so that equal rows have a finite density.
LEAST = 1e-9


def neighbour_lists(points: DataFrame, length: int) -> DataFrame:
    """(query_id, ref_id, value, rank): the `length` nearest rows of each row, itself included; `points` has (id, vec)."""
    rows = points.select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"))
    return knn_join(rows, rows, length, "l2")


def core_distances(points: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): the distance within which a row has `min_samples` others; `points` has (id, vec, weight), `near` lists longer than that."""
    near = near.filter(F.col("rank") <= min_samples + 1).join(points.select(F.col("id").alias("ref_id"), "weight"), "ref_id")
    listed = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "weight"))).alias("near"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("core"))

    def step(s, x):
        reached = s["n"] >= min_samples + 1
        return F.struct((s["n"] + x["weight"]).alias("n"), F.when(reached, s["core"]).otherwise(x["value"]).alias("core"))

    return listed.select(F.col("query_id").alias("id"), F.aggregate("near", start, step)["core"].alias("core"))


def _way_out(alpha: float, elements: int = 2**21):
    """Kernel: each left row's shortest edge, of `reach` or less, to the right rows of other groups, ties by ids.

    Bounds in single precision leave a few candidates, whose distances are taken exactly.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(left["vec"]), matrix(right["vec"])
        ids, refs = left["id"].to_numpy(), right["id"].to_numpy()
        own, other = left["c"].to_numpy(), right["c"].to_numpy()
        core, cores, reach = left["core"].to_numpy(), right["core"].to_numpy(), left["reach"].to_numpy()
        bounds = Bounds(a, b, "l2")
        floor = (alpha * cores) ** 2 * (1 - 1e-6)

        def weight(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.empty(len(i))
            for part in range(0, len(i), elements // 16):
                x, y = i[part : part + elements // 16], j[part : part + elements // 16]
                d = np.round(pair_distances(a, b, x, y), TIE_DIGITS) / alpha
                out[part : part + elements // 16] = np.round(np.maximum(np.maximum(d, core[x]), cores[y]), TIE_DIGITS)
            return out

        step, kept = max(1, elements // len(b)), []
        for start in range(0, len(a), step):
            rows = slice(start, min(start + step, len(a)))
            square = bounds.na[rows] ** 2
            low = bounds.lower(rows)
            if low.dtype == np.float64:  # values that are not finite are settled by differences
                low[np.isnan(low)] = -np.inf
            low = np.maximum(low, (floor[None] - square[:, None]).astype(low.dtype))
            low[own[rows, None] == other[None]] = np.inf
            best = low.argmin(1)
            place = np.arange(len(best))
            least = np.where(low[place, best] < np.inf, weight(start + place, best), np.inf)
            least = np.where(np.isfinite(least), np.minimum(least, reach[rows]), reach[rows])
            # distances that are equal when rounded may lie farther by one unit
            limit = bounds.limit((alpha * least) ** 2 - square, rows, 2 * alpha * 10.0**-TIE_DIGITS)
            i, j = np.divmod(np.flatnonzero((low <= limit[:, None]) & (low < np.inf)), len(b))
            w = weight(start + i, j)
            fine = np.isfinite(w) & (w <= reach[start + i])
            i, j, w = start + i[fine], j[fine], w[fine]
            lo, hi = np.minimum(ids[i], refs[j]), np.maximum(ids[i], refs[j])
            order = np.lexsort((hi, lo, w, i))
            first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
            kept.append(pd.DataFrame({"id": ids[i[first]], "w": w[first], "a": lo[first], "b": hi[first]}))
        return pd.concat(kept, ignore_index=True)

    return kernel


def _roots(parents: DataFrame) -> DataFrame:
    """(c, up) with every `up` replaced by the last one on the way up; an `up` without a row ends it."""

    def above(rows: DataFrame, over: DataFrame, name: str) -> DataFrame:
        over = over.select(F.col("c").alias("up"), F.col("up").alias("__top"))
        return rows.join(over, "up", "left").select("c", *([] if name == "up" else ["up"]), F.coalesce("__top", "up").alias(name))

    parents = materialize(parents)
    while True:
        twice = above(parents, parents, "up")
        moved = materialize(above(above(twice, twice, "up"), parents, "top").select("c", "up", (F.col("top") != F.col("up")).alias("moved")))
        parents = moved.select("c", "up")
        if moved.filter("moved").isEmpty():
            return parents


def spanning_forest(edges: DataFrame, bounds: DataFrame, search=None) -> DataFrame:
    """(w, a, b): the minimum spanning forest, ties by (a, b), of an edge table and of the edges that `search` finds.

    `bounds` has (id, bound): an edge of a row that is not in `edges` is not below its bound. A group whose shortest edge is
    below the bounds of all its rows merges along it. Once these are less than half of the groups, `search(open)`
    gives every row of `open` (id, c, bound, reach), that is those with a bound within the shortest edge `reach` of their group c,
    the shortest edge to another group, (id, w, a, b), and each group the `reach` that was searched, (c, reach). The group with most such rows
    is left out; so every round halves the groups.
    """
    key, none = F.struct("w", "a", "b"), F.lit(float("inf"))
    rest = materialize(edges.select("w", "a", "b").distinct().select("w", "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    state = materialize(bounds.select("id", F.col("id").alias("c"), "bound"))
    chosen: list[DataFrame] = []

    def picks(groups: DataFrame) -> DataFrame:
        """The groups with their shortest edges, if they have any."""
        ends = rest.select(F.col("ca").alias("c"), F.struct(key.alias("k"), F.col("cb").alias("o")).alias("e"))
        ends = ends.unionByName(rest.select(F.col("cb").alias("c"), F.struct(key.alias("k"), F.col("ca").alias("o")).alias("e")))
        best = ends.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.o", "e.k.*")
        return groups.join(best, "c", "left").withColumn("sure", F.coalesce(F.col("w") < F.col("bound"), F.lit(False)))

    while True:
        groups = materialize(state.groupBy("c").agg(F.min("bound").alias("bound")))
        total = groups.count()
        if total <= 1:
            break
        pick = materialize(picks(groups))
        if search and 2 * pick.filter("sure").count() < total - 1:
            reach = pick.filter("not sure").select("c", F.coalesce("w", none).alias("reach"))
            open_ = state.join(reach, "c").filter("bound <= reach")
            most = open_.groupBy("c").count().orderBy(F.desc("count"), "c").first()
            found, searched = search(materialize(open_.filter(F.col("c") != most["c"])), state)
            at = state.select(F.col("id"), F.col("c").alias("to"))
            fresh = found.select("w", "a", "b").distinct()
            for side in "ab":
                fresh = fresh.join(at.select(F.col("id").alias(side), F.col("to").alias(f"c{side}")), side)
            rest = materialize(rest.unionByName(fresh.select(*rest.columns)))
            # edges of a searched row that are still unknown are not below the one found, or the reach
            state = state.join(searched, "c", "left").join(found.select("id", F.col("w").alias("found")), "id", "left")
            state = materialize(state.select("id", "c", F.greatest("bound", F.when(F.col("reach").isNotNull(), F.coalesce("found", "reach"))).alias("bound")))
            pick = picks(groups).join(searched, "c", "left").withColumn("sure", F.col("w").isNotNull() & (F.col("sure") | F.col("reach").isNotNull()))
            pick = materialize(pick.drop("reach"))
        pick = pick.filter("sure" if search else "w is not null")
        if pick.isEmpty():  # what is left cannot be joined by a finite edge
            break
        chosen.append(pick.select("w", "a", "b").distinct())
        other = pick.select(F.col("c").alias("o"), F.col("o").alias("back"))
        # of two groups that chose each other the smaller is the root
        mutual = F.coalesce(F.col("back") == F.col("c"), F.lit(False)) & (F.col("c") < F.col("o"))
        up = _roots(pick.select("c", "o").join(other, "o", "left").select("c", F.when(mutual, F.col("c")).otherwise(F.col("o")).alias("up")))
        state = materialize(state.join(up, "c", "left").select("id", F.coalesce("up", "c").alias("c"), "bound"))
        for side in ("ca", "cb"):
            rest = rest.join(up.select(F.col("c").alias(side), "up"), side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
        rest = rest.filter("ca <> cb").groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(key).alias("k"))
        rest = materialize(rest.select("k.*", "ca", "cb"))
    out = edges.select("w", "a", "b").limit(0)
    for part in chosen:
        out = out.unionByName(part)
    return out


def folded(vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, vec) per row, and (id, vec, weight) per distinct vector."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), as_doubles(F.col("embedding")).alias("vec"))
    return rows, materialize(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))


def reachability_tree(
    points: DataFrame, min_samples: int, alpha: float = 1.0, size: int | None = None, pivots: int | None = None, length: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """((id, weight, core), (w, a, b)): the spanning tree of mutual reachability distances of `folded` points.

    It starts from lists of `length` neighbours; `size` is the number of rows in a chunk of the searches behind them.
    """
    length = max(length or 3 * min_samples + 1, min_samples + 1)
    near = materialize(neighbour_lists(points, length))
    cores = core_distances(points, near, min_samples)
    wanted = pivots or max(1, math.ceil(math.sqrt(points.count() / PIVOT_ROWS)))
    picked = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("id", "vec").collect()
    chosen = np.array([r.vec for r in picked], dtype=np.float64)
    placed = materialize(assign_cells(points.join(cores, "id"), chosen))
    rows = placed.count()
    radius = _cell_radius(placed, len(chosen))
    dims = chosen.shape[1] if chosen.ndim > 1 else 1
    even = math.ceil(rows / (2 * math.sqrt(points.sparkSession.sparkContext.defaultParallelism)))
    size = size or min(chunk_rows(dims), max(CHUNK, even))

    a, b = (placed.select(F.col("id").alias(x), F.col("core").alias(f"core_{x}")) for x in ("query_id", "ref_id"))
    listed = near.filter("query_id <> ref_id").join(a, "query_id").join(b, "ref_id")
    weight = F.round(F.greatest(F.col("value") / alpha, "core_query_id", "core_ref_id"), TIE_DIGITS)
    edges = listed.select(weight.alias("w"), F.least("query_id", "ref_id").alias("a"), F.greatest("query_id", "ref_id").alias("b"))
    # a row that is in no full list knows all its edges
    last = near.filter(F.col("rank") == length).select(F.col("query_id").alias("id"), "value")
    bound = F.when(F.col("value").isNull(), F.lit(float("inf"))).otherwise(F.round(F.greatest(F.col("value") / alpha, "core"), TIE_DIGITS))
    bounds = placed.select("id", "core").join(last, "id", "left").select("id", bound.alias("bound"))

    def search(open_: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = {r.id for r in picked}
        known = {r.id: r for r in state.join(placed.select("id", "core"), "id").filter(F.col("id").isin(list(wanted))).collect()}  # one row per pivot
        group = np.array([known[r.id].c if r.id in known else -1 for r in picked])
        core = np.array([known[r.id].core if r.id in known else np.inf for r in picked])

        def hop(batches):
            """A pivot of another group bounds the way out."""
            for pdf in batches:
                if not len(pdf):
                    continue
                out = np.full(len(pdf), np.inf)
                own, mine = pdf["c"].to_numpy(), pdf["core"].to_numpy()
                for start, d in distances(matrix(pdf["vec"]), chosen):
                    at = slice(start, start + len(d))
                    way = np.maximum(np.maximum(d / alpha, core[None]), mine[at, None])
                    out[at] = np.where(own[at, None] == group[None], np.inf, way).min(1) + 10.0**-TIE_DIGITS
                yield pdf.assign(hop=out)

        def visit(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                own, reach = pdf["core"].to_numpy(), pdf["reach"].to_numpy()
                for start, d in distances(matrix(pdf["vec"]), chosen):
                    at = slice(start, start + len(d))
                    least = np.maximum((d - radius[None]) / alpha, own[at, None])
                    hit = (least <= reach[at, None] + 1e-9) & np.isfinite(radius)[None]
                    at, cells = np.nonzero(hit)
                    yield pdf.iloc[start + at].assign(cell=cells.astype(np.int32))

        kinds = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        asked = open_.join(placed.select("id", "vec", "core"), "id")
        asked = materialize(asked.mapInPandas(hop, f"{kinds(asked)}, hop double"))
        searched = materialize(asked.groupBy("c").agg(F.min(F.least("reach", "hop")).alias("reach")))
        left = asked.drop("reach", "hop").join(searched, "c").filter("bound <= reach").select("id", "vec", "core", "c", "reach")
        left = left.mapInPandas(visit, f"{kinds(left)}, cell int")
        right = placed.join(state.select("id", "c"), "id").select("cell", "id", "vec", "core", "c")
        found = grid_apply(left, right, "cell", "id", "id", _way_out(alpha), "id long, w double, a long, b long", size)
        return materialize(found.groupBy("id").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("id", "e.*")), searched

    tree = spanning_forest(edges, bounds, search)
    return placed.select("id", "weight", "core"), materialize(tree)


def contract(points: DataFrame, tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((id, weight, piece, w, a, b), (w, a, b, pa, pb)): when each row's group first has `least` rows, and the real splits.

    `piece` is the group that grew from the first such group without meeting another one, (w, a, b) the
    edge that brought the row into a group of that size; rows that never are in one are missing.
    """
    heavy = F.col("weight") >= least
    level = F.round("core", TIE_DIGITS).alias("w")
    done = [points.filter(heavy).select("id", "weight", F.col("id").alias("piece"), level, F.col("id").alias("a"), F.col("id").alias("b"))]
    open_ = points.filter(~heavy).select("id", "weight", F.col("id").alias("c"))
    a, b = (points.select(F.col("id").alias(x), F.col("id").alias(f"c{x}"), F.col("weight").alias(f"n{x}"), heavy.alias(f"l{x}")) for x in "ab")
    edges = materialize(tree.join(a, "a").join(b, "b"))
    splits = [edges.filter("la and lb")]
    edges = edges.filter("not (la and lb)")
    while not edges.isEmpty():
        key = F.struct("w", "a", "b")
        ends = [
            edges.filter(f"not l{x}").select(F.col(f"c{x}").alias("c"), F.struct(key.alias("k"), F.col(f"c{y}").alias("o"), F.col(f"n{x}").alias("n"), F.col(f"n{y}").alias("on")).alias("e"))
            for x, y in ("ab", "ba")
        ]
        pick = materialize(ends[0].unionByName(ends[1]).groupBy("c").agg(F.min("e").alias("e")).select("c", "e.o", "e.n", "e.on", "e.k.*"))
        # the shortest ways out lead to a larger group, or to two groups that chose each other
        pairs = pick.join(pick.select(F.col("c").alias("o"), F.col("o").alias("back")), "o", "left").withColumn("pair", F.coalesce(F.col("back") == F.col("c"), F.lit(False)))
        first = F.col("pair") & (F.col("c") < F.col("o"))
        ends_in = pairs.filter(first).select(F.col("c").alias("up"), (F.col("n") + F.col("on")).alias("sum"))
        tops = _roots(pairs.select("c", F.when(first, F.col("c")).otherwise(F.col("o")).alias("up")))
        found = pairs.drop("up").join(tops, "c").join(ends_in, "up", "left").withColumn("big", F.coalesce(F.col("sum") >= least, F.lit(True)))
        moves = materialize(found.filter("big or pair").select("c", F.col("up").alias("to"), F.coalesce("sum", F.lit(least)).alias("n"), "big", "w", "a", "b"))
        used = moves.select(F.col("a").alias("va"), F.col("b").alias("vb")).distinct()
        rest = edges.join(used, (F.col("a") == F.col("va")) & (F.col("b") == F.col("vb")), "left_anti")
        moved = open_.join(moves, "c", "left")
        if len(splits) % 4 == 0:  # else the plan of a later round holds all rounds before
            moved = materialize(moved)
        done.append(moved.filter("big").select("id", "weight", F.col("to").alias("piece"), "w", "a", "b"))
        open_ = moved.filter("not coalesce(big, false)").select("id", "weight", F.coalesce("to", "c").alias("c"))
        for x in "ab":
            step = moves.select(F.col("c").alias(f"c{x}"), "to", "n", "big")
            rest = rest.join(step, f"c{x}", "left")
            rest = rest.withColumns({f"c{x}": F.coalesce("to", f"c{x}"), f"n{x}": F.coalesce("n", f"n{x}"), f"l{x}": F.coalesce("big", f"l{x}")}).drop("to", "n", "big")
        rest = materialize(rest)
        splits.append(rest.filter("la and lb"))
        edges = rest.filter("not (la and lb)")
    rows, real = done[0], splits[0]
    for x in done[1:]:
        rows = rows.unionByName(x)
    for x in splits[1:]:
        real = real.unionByName(x)
    return materialize(rows), real.select("w", "a", "b", F.col("ca").alias("pa"), F.col("cb").alias("pb"))


NODE = "node long, parent long, w double, a long, b long, until double, depth int"


def condensed(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """Nodes of the condensed tree: pieces, and the groups that real splits join.

    (w, a, b) is the edge with which a node begins, null for pieces; `until` the distance at which it joins
    its parent, null for the root. Joined nodes have negative numbers.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        top = {int(p): int(p) for p in pdf.loc[pdf["pb"].isna(), "pa"]}
        node = {p: [p, None, None, None, None, None] for p in top}
        up = dict.fromkeys(top)

        def find(p: int) -> int:
            root = p
            while up[root] is not None:
                root = up[root]
            while p != root:
                up[p], p = root, up[p]
            return root

        joins = pdf[pdf["pb"].notna()].sort_values(["w", "a", "b"])
        for i, (w, a, b, pa, pb) in enumerate(zip(joins["w"], joins["a"], joins["b"], joins["pa"], joins["pb"], strict=True)):
            x, y = find(int(pa)), find(int(pb))
            new = -1 - i
            node[new] = [new, None, w, int(a), int(b), None]
            for z in (x, y):
                node[top[z]][1], node[top[z]][5] = new, w
            up[y] = x
            top[x] = new
        depth: dict[int, int] = {}
        for n in sorted(node, key=lambda n: (n >= 0, n)):  # later joins first, then pieces
            depth[n] = 0 if node[n][1] is None else depth[node[n][1]] + 1
        out = pd.DataFrame([[*node[n], depth[n]] for n in node], columns=["node", "parent", "w", "a", "b", "until", "depth"])
        return out.astype({"node": "int64", "parent": "Int64", "a": "Int64", "b": "Int64", "w": "float64", "until": "float64", "depth": "int32"})

    none = F.lit(None)
    ends = pieces.select(none.cast("double").alias("w"), none.cast("long").alias("a"), none.cast("long").alias("b"), F.col("piece").alias("pa"), none.cast("long").alias("pb"))
    together = ends.unionByName(splits.select("w", "a", "b", "pa", "pb")).withColumn("all", F.lit(True))
    return together.groupBy("all").applyInPandas(build, NODE)


def climb(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add `node`: the last node on the way up from a row's piece that begins before the row's own edge."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    hops = [nodes.select("node", F.col("parent").alias("up"))]
    while 2 ** len(hops) <= deepest:
        last = hops[-1]
        hops.append(materialize(last.join(last.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")).filter("up is not null")))
    begin = nodes.select(F.col("node").alias("up"), F.struct("w", "a", "b").alias("begin"))
    out = rows.withColumn("node", F.col("piece"))
    for hop in reversed(hops):
        way = hop.filter("up is not null").join(begin, "up")
        out = out.join(way, "node", "left")
        out = out.withColumn("node", F.when(F.col("begin") < F.struct("w", "a", "b"), F.col("up")).otherwise(F.col("node"))).drop("up", "begin")
    return materialize(out)


def stable(nodes: DataFrame, facts: DataFrame, epsilon: float, single: bool) -> DataFrame:
    """(node, cluster, top, deepest, persistence): the chosen cluster of every node, and what rows are measured against.

    `facts` has (node, rows, density, peak): number, summed and largest density of the rows that leave a group at a
    node. A cluster is chosen where it is at least as stable as what it splits into.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("depth", ascending=False)
        parent = {int(n): None if pd.isna(p) else int(p) for n, p in zip(pdf["node"], pdf["parent"], strict=True)}
        until = {int(n): w for n, w in zip(pdf["node"], pdf["until"], strict=True)}
        birth = {n: 0.0 if parent[n] is None else 1 / max(until[n], LEAST) for n in parent}
        rows = dict(zip(pdf["node"].astype(int), pdf["rows"].fillna(0), strict=True))
        density = dict(zip(pdf["node"].astype(int), pdf["density"].fillna(0.0), strict=True))
        top = dict(zip(pdf["node"].astype(int), pdf["peak"].fillna(0.0), strict=True))
        below: dict[int, list[int]] = {n: [] for n in parent}
        size, stability, value, deepest, chosen = dict(rows), {}, {}, {}, {}
        for n in parent:  # deepest first
            for c in below[n]:
                size[n] += size[c]
                density[n] += size[c] * birth[c]
                top[n] = max(top[n], birth[c])
            stability[n] = density[n] - size[n] * birth[n]
            deepest[n] = max([top[n], *(deepest[c] for c in below[n])])
            inner = sum(value[c] for c in below[n])
            chosen[n] = (parent[n] is not None or single) and round(stability[n], 9) >= round(inner, 9)
            value[n] = stability[n] if chosen[n] else inner
            if parent[n] is not None:
                below[parent[n]].append(n)
        peak = max(deepest.values(), default=0.0)
        owner: dict[int, int | None] = {}
        for n in reversed(list(parent)):  # from the root
            above = None if parent[n] is None else owner[parent[n]]
            owner[n] = above if above is not None else n if chosen[n] else None
        if epsilon > 0:  # clusters that part closer than epsilon go up to the first that does not
            lifted = {}
            for n in {o for o in owner.values() if o is not None}:
                at = n
                while parent[at] is not None and until[at] < epsilon and (single or parent[parent[at]] is not None):
                    at = parent[at]
                lifted[n] = at
            targets = set(lifted.values())
            for n in reversed(list(parent)):
                above = None if parent[n] is None else owner[parent[n]]
                owner[n] = above if above is not None else n if n in targets else None
        members: dict[int, float] = {}
        for n, o in owner.items():
            if o is not None:
                members[o] = members.get(o, 0) + rows[n]
        keep = {o: min(1.0, stability[o] / (members[o] * peak)) if members[o] and peak else 1.0 for o in members}
        out = [(n, owner[n], top[owner[n]] if owner[n] is not None else None, deepest[n], keep.get(owner[n])) for n in parent]
        return pd.DataFrame(out, columns=["node", "cluster", "top", "deepest", "persistence"]).astype({"cluster": "Int64", "top": "float64", "persistence": "float64"})

    joined = nodes.select("node", "parent", "until", "depth").join(facts, "node", "left")
    return joined.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(choose, "node long, cluster long, top double, deepest double, persistence double")


def hdbscan(
    vectors: DataFrame,
    min_cluster_size: int = 10,
    min_samples: int = 5,
    alpha: float = 1.0,
    cluster_selection_epsilon: float = 0.0,
    allow_single_cluster: bool = False,
    key: str = "vec_id",
    size: int | None = None,
    pivots: int | None = None,
    length: int | None = None,
) -> DataFrame:
    """Density clusters of any densities: (key, cluster, probability, outlier_score, persistence).

    -1 is noise; clusters count from 0 by their smallest row. `probability` is a row's density against its
    cluster's peak, `outlier_score` what it lacks of the densest part of its group, `persistence` the
    cluster's stability against that of a group of the highest density. Ties of distances, at nine decimals, go by ids. Equal
    vectors are folded and count with their number; `min_samples` counts the others, not the row itself.
    """
    rows, points = folded(vectors, key)
    if points.isEmpty():
        none = F.lit(None).cast("double")
        return rows.select(F.col("id").alias(key), F.lit(-1).alias("cluster"), none.alias("probability"), none.alias("outlier_score"), none.alias("persistence"))
    weights, tree = reachability_tree(points, min_samples, alpha, size, pivots, length)
    grown, splits = contract(weights, tree, min_cluster_size)
    nodes = materialize(condensed(grown.select("piece").distinct(), splits))
    placed = climb(grown, nodes).withColumn("density", 1 / F.greatest("w", F.lit(LEAST)))
    facts = placed.groupBy("node").agg(F.sum("weight").alias("rows"), F.sum(F.col("weight") * F.col("density")).alias("density"), F.max("density").alias("peak"))
    chosen = materialize(stable(nodes, facts, cluster_selection_epsilon, allow_single_cluster))
    found = placed.join(chosen, "node").select(
        "id", "cluster", F.when(F.col("cluster").isNotNull(), F.least(F.lit(1.0), F.col("density") / F.col("top"))).otherwise(0.0).alias("probability"),
        (1 - F.col("density") / F.col("deepest")).alias("outlier_score"), "persistence",
    )
    found = materialize(found)
    firsts = found.filter("cluster is not null").groupBy("cluster").agg(F.min("id").alias("first"))
    numbers = ranked(firsts, [], [F.col("first")], "number").select("cluster", (F.col("number") - 1).cast("int").alias("number"))
    named = points.select("id", "vec").join(found, "id", "left").join(numbers, "cluster", "left")
    out = rows.join(named.drop("id"), "vec")
    zero = F.coalesce("probability", F.lit(0.0))
    return out.select(F.col("id").alias(key), F.coalesce("number", F.lit(-1)).alias("cluster"), zero.alias("probability"), F.coalesce("outlier_score", F.lit(1.0)).alias("outlier_score"), "persistence")
