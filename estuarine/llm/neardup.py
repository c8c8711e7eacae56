"""Near-duplicate documents by a signature-coordinate inverted join.

Documents with equal shingle sets are folded first. Every class posts its node under each
(coordinate, value) of its MinHash signature. Two signatures of K coordinates with T or more in
common share a value among the K - T + 1 rarest of either, so only those are posted (prefix), and
classes with fewer than T values that anyone else has are skipped. Pairs that meet are held
against the match threshold T on their whole signatures, and the survivors against their whole
shingle sets.

A posting list is never expanded into its pairs. Its members are compared with a few of them, the
hubs; pairs with T matches, there or between members that no hub has joined, make loose groups, and
every pair that shares a posting and has T matches lies inside one. In a loose group each class is held
against its best hub by whole sets. Classes that this leaves outside the group's largest component are
compared with the whole group, in blocks, without a row per pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estuarine.llm.common import grouped, slices, strings
from estuarine.llm.shingles import Signatures, WordHasher
from estuarine.llm.unionfind import components
from estuarine.session import materialize


#: Classes in a block of the comparison inside groups.
BLOCK = 256


def _key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def shingled(docs: DataFrame, coordinates: int, id_col: str, text_col: str, length: int = 2) -> DataFrame:
    """(id, n, key, sig): set size, a 128-bit name of the set, its signature."""

    def run(batches):
        hasher, signer = WordHasher(), Signatures(coordinates)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = hasher.shingle_sets(strings(part, "text"), length)
                ids = part.column(0)
                keys = [_key(s) if len(s) else b"-%d" % i for s, i in zip(sets, ids.to_pylist(), strict=True)]
                sigs = [signer.of(s) if len(s) else np.zeros(0, np.int32) for s in sets]
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sigs)]), pa.int32()), pa.array(np.concatenate(sigs)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), flat], names=["id", "n", "key", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, key binary, sig array<int>")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(node, set) for the given nodes, read again from their texts."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = hasher.shingle_sets(strings(part, "text"), length)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the nodes grow with the corpus: they are never broadcast, whatever their number here
    return rows.join(nodes.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(run, "node long, set binary")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one, two = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to connect what a symmetric matrix connects."""
    seen, out = np.zeros(len(near), bool), []
    for i in range(len(near)):
        front = [] if seen[i] else [i]
        seen[i] = True
        while front:
            x = front.pop()
            new = np.flatnonzero(near[x] & ~seen)
            seen[new] = True
            out += [(x, y) for y in new.tolist()]
            front += new.tolist()
    return out


def _overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections in a block, from the values that two sets or more have."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    use = count[code] > 1
    row, code = row[use], rank[code[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        at = slice(*np.searchsorted(code, [start, start + columns]))
        part = np.zeros((len(sets), columns), np.float32)
        part[row[at], code[at] - start] = 1
        out += part @ part.T
    return out


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links of classes that are not `done` with all of their group `grp`, by whole sets.

    Groups are cut into blocks of bounded size, those of the open classes first; a pair of blocks
    meets if one of the two is open, and gives the links that connect what is linked in it.
    """
    count = lambda c: F.ceil(F.sum(F.when(c, 1).otherwise(0)) / BLOCK).cast("int")
    sizes = members.groupBy("grp").agg(count(~F.col("done")).alias("n_open"), count(F.col("done")).alias("n_done"))
    hash_ = F.xxhash64("node")
    slot = F.when(F.col("done"), F.col("n_open") + F.pmod(hash_, F.greatest("n_done", F.lit(1)))).otherwise(F.pmod(hash_, F.greatest("n_open", F.lit(1)))).cast("int")
    placed = members.join(sizes, "grp").withColumn("s", slot)
    others = F.when(F.col("done"), F.sequence(F.lit(0), F.col("n_open") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_open") + F.col("n_done") - 1))
    dealt = placed.withColumn("t", F.explode(others)).select("grp", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "node", "set")

    def run(batches):
        for rows in grouped(batches, 3):
            ids, sets = [r[3] for r in rows], [np.frombuffer(r[4], np.uint64) for r in rows]
            both, n = _overlaps(sets), np.array([len(s) for s in sets])
            near = 100 * both.astype(np.int64) >= percent * (n[:, None] + n[None, :] - both.astype(np.int64))
            np.fill_diagonal(near, False)
            found = _forest(near)
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], names=["a", "b"])

    order = ["grp", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "node", "set").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, percent: int = 80, coordinates: int = 32, matches: int = 16, id_col: str = "doc_id", text_col: str = "text", length: int = 2
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `docs`.

    Two documents are linked if 100 * intersection >= percent * union of their sets of shingles
    of `length` words. `component_id` is the smallest id reachable over links. With 32 coordinates a pair at
    80 % has 16 or more in common with a chance over 0.9999; found pairs are confirmed on whole sets.

    Null and empty texts, and texts without words, have no shingles and no links: each is a
    component of its own. A row without id is linked with nothing and stays, with a null component.
    Repeated rows come back each, with the same component. Other columns are ignored; an empty
    table gives no rows. Ids are long integers; rows with one id are taken for one document.
    """
    named = docs.filter(F.col(id_col).isNotNull())
    rows = materialize(shingled(named, coordinates, id_col, text_col, length))
    classes = materialize(rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("node"), F.first("sig").alias("sig")))
    posted = classes.select("node", "sig", F.posexplode("sig").alias("c", "v")).select("node", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v")).alias("value"))
    # written first, so that the join can split the rows of a common value
    shared = materialize(posted.groupBy("value").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"))
    own = Window.partitionBy("node")
    ranked = posted.join(shared, "value").select("node", "value", F.count(F.lit(1)).over(own).alias("m"), F.row_number().over(own.orderBy("freq", "value")).alias("place"))
    prefix = ranked.filter(F.col("place") <= F.col("m") - matches + 1).select("value", "node", "m")
    lists = materialize(prefix.join(classes.select("node", "sig"), "node"))

    # hubs: the class with most values that others have, the smallest, and the smallest by a hash
    one = F.struct("node", "sig")
    picks = F.array(F.max_by(one, F.struct("m", -F.col("node"))), F.min_by(one, F.col("node")), F.min_by(one, F.xxhash64("node")))
    centres = materialize(lists.groupBy("value").agg(picks.alias("hubs"))).select("value", F.explode(F.array_distinct("hubs")).alias("h"))
    same = F.size(F.filter(F.zip_with("sig", "p", lambda x, y: x == y), lambda x: x))
    hub = centres.select("value", F.col("h.node").alias("a"), F.col("h.sig").alias("p"))
    met = lists.join(hub, (lists["value"] == hub["value"]) & (F.col("node") != F.col("a")) & (same >= matches))
    spokes = materialize(met.select("a", F.col("node").alias("b"), same.alias("same")).distinct())
    nodes = lists.select(F.col("node").alias("id")).distinct()
    loose = components(nodes, spokes)
    # members of one list that its hubs have not brought together
    placed = lists.join(loose.withColumnRenamed("id", "node"), "node")
    apart = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("value")
    left = materialize(placed.join(apart, "value"))
    right = left.select(F.col("value").alias("w"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("sig").alias("p"))
    stray = left.join(right, (F.col("value") == F.col("w")) & (F.col("component") < F.col("cb")) & (same >= matches))
    stray = materialize(stray.select(F.col("node").alias("a"), "b").distinct())
    loose = components(nodes, spokes.select("a", "b").union(stray))

    groups = loose.join(loose.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "component")
    sets = materialize(_sets(named, groups.select(F.col("id").alias("node")), id_col, text_col, length))
    best = spokes.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a"))
    links = materialize(_similar(best, sets, percent))
    firm = components(groups.select("id"), links)
    parts = firm.withColumnRenamed("component", "part").join(groups.select("id", F.col("component").alias("grp")), "id")
    sizes = parts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("grp").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ = materialize(parts.join(main, "grp").select("grp", F.col("id").alias("node"), (F.col("part") == F.col("main")).alias("done")))
    more = _block_links(open_.join(sets, "node"), percent)
    label = components(nodes, materialize(links.union(more)))

    found = classes.select("key", "node").join(label.select(F.col("id").alias("node"), "component"), "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    out = rows.select("id", "n", "key").join(found, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    out = out.withColumn("kept", F.col(id_col) == F.col("component_id"))
    nameless = shingled(docs.filter(F.col(id_col).isNull()).withColumn(id_col, F.lit(0).cast("long")), coordinates, id_col, text_col, length)
    none = F.lit(None).cast("long")
    return out.unionByName(nameless.select(none.alias(id_col), F.col("n").alias("n_shingles"), none.alias("component_id"), F.lit(True).alias("kept")))
