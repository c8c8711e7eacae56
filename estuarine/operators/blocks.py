"""Block-wise comparison of two row sets under a shared key.

Rows of a key are cut into chunks of bounded size on both sides, and every pair of
chunks meets in one small group. A kernel reduces that group to a few rows per input
row (best matches, counts, links), so no pair of rows is ever written out, and a key
holding most of the data becomes many groups instead of one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 2048
# Numbers in a chunk of vectors.
NUMBERS = 2**22


def with_chunks(df: DataFrame, key: str, row_id: str, size: int, name: str) -> DataFrame:
    """Add `<name>` (chunk of the row) and `<name>s` (chunks of its key).

    Chunks come from a hash of the row id, so recomputation gives the same ones.
    """
    counts = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(f"{name}s"))
    return df.join(counts, key).withColumn(
        name, F.pmod(F.xxhash64(row_id), F.col(f"{name}s")).cast("int")
    )


def grid_apply(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_id: str,
    right_id: str,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    size: int = CHUNK,
) -> DataFrame:
    """Run `kernel(left_chunk, right_chunk)` for every chunk pair of every shared key."""
    # fresh column identities, so a frame can be compared with itself
    left, right = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (left, right))
    a = with_chunks(left, key, left_id, size, "__lc")
    b = with_chunks(right, key, right_id, size, "__rc")
    a_sizes = a.select(key, "__lcs").distinct()
    b_sizes = b.select(key, "__rcs").distinct()
    spread_a = a.join(b_sizes, key).withColumn("__rc", F.explode(F.sequence(F.lit(0), F.col("__rcs") - 1)))
    spread_b = b.join(a_sizes, key).withColumn("__lc", F.explode(F.sequence(F.lit(0), F.col("__lcs") - 1)))
    cells = [key, "__lc", "__rc"]
    ga = spread_a.select(*cells, *[c for c in left.columns if c != key]).groupBy(*cells)
    gb = spread_b.select(*cells, *[c for c in right.columns if c != key]).groupBy(*cells)
    empty = pd.DataFrame(columns=[f.strip().split(" ")[0] for f in schema.split(",")])

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return kernel(x, y) if len(x) and len(y) else empty

    return ga.cogroup(gb).applyInPandas(run, schema)


def matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def chunk_rows(dims: int) -> int:
    """Rows of a chunk of vectors: NUMBERS numbers, so that a row is copied to few chunks and a task's memory is bounded."""
    return max(CHUNK, NUMBERS // max(dims, 1))


def distances(a: np.ndarray, b: np.ndarray, elements: int = 2**20):
    """Euclidean distances in row slices: products of centred vectors, differences where those would cancel."""
    centre = _centre(b)
    x, y = a - centre, b - centre
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    rows = max(1, elements // max(len(b), 1))
    for start in range(0, len(a), rows):
        at = slice(start, start + rows)
        scale = nx[at, None] + ny[None, :]
        square = scale - 2 * (x[at] @ y.T)
        # values that are not finite compare as false and are worked out by differences, too
        i, j = np.nonzero(~(square > 1e-3 * scale))
        out = np.sqrt(np.maximum(square, 0))
        for part in range(0, len(i), elements // 8):
            p, q = i[part : part + elements // 8], j[part : part + elements // 8]
            out[p, q] = pair_distances(a, b, start + p, q)
        yield start, out


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of listed pairs, by differences."""
    return np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))


def _centre(b: np.ndarray) -> np.ndarray:
    fine = b[np.isfinite(b).all(1)]
    return fine.mean(0) if len(fine) else np.zeros(b.shape[1])


class Bounds:
    """Bounds on the cost of all pairs from products in single precision.

    The cost is |b|^2 - 2ab of centred vectors for `l2`, which is the squared distance less |a|^2,
    and -ab for `ip`. A product of d numbers errs by less than `slop` times the lengths; a term of
    that size is part of the product, so a bound holds for each pair by itself.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, metric: str):
        centre = _centre(b) if metric == "l2" else 0.0
        self.metric, self.x, self.y = metric, a - centre, b - centre
        self.na, self.nb = np.sqrt((self.x**2).sum(1)), np.sqrt((self.y**2).sum(1))
        top = max((float(np.max(n[np.isfinite(n)], initial=0.0)) for n in (self.na, self.nb)), default=0.0)
        self.kind = np.float32 if 1e-12 < top < 1e15 else np.float64
        self.slop = max(1e-5, 2e-7 * (a.shape[1] + 4))
        self.low = self._right(-self.slop)

    def _right(self, slop: float, cols=slice(None)) -> np.ndarray:
        y, nb = self.y[cols], self.nb[cols]
        parts = [y, nb] if self.metric == "ip" else [y, nb**2 * (1 + slop), nb]
        return np.ascontiguousarray(np.column_stack(parts).astype(self.kind).T)

    def _left(self, slop: float, rows) -> np.ndarray:
        x, na = self.x[rows], self.na[rows]
        parts = [-x, slop * na] if self.metric == "ip" else [-2 * x, np.ones(len(x)), 2 * slop * na]
        return np.column_stack(parts).astype(self.kind)

    def lower(self, rows) -> np.ndarray:
        return self._left(-self.slop, rows) @ self.low

    def upper(self, rows, cols: np.ndarray) -> np.ndarray:
        return self._left(self.slop, rows) @ self._right(self.slop, cols)

    def limit(self, cost: np.ndarray, rows, more: float) -> np.ndarray:
        """The cost of pairs farther by `more`, rounded up."""
        cost = cost.astype(np.float64)
        square = self.na[rows] ** 2
        if self.metric == "ip":
            out = cost + more
        else:
            out = (np.sqrt(np.maximum(cost + square, 0)) + more) ** 2 - square
        return (out + 1e-6 * (np.abs(out) + square) + 1e-30).astype(self.kind)


def within(a: np.ndarray, b: np.ndarray, eps: float, elements: int = 2**21):
    """Yield (i, j) of the pairs at a distance of `eps` or less, by rows; close calls are settled by differences."""
    bounds = Bounds(a, b, "l2")
    step = max(1, elements // max(len(b), 1))
    for start in range(0, len(a), step):
        rows = slice(start, min(start + step, len(a)))
        low = bounds.lower(rows)
        limit = bounds.limit(eps**2 - bounds.na[rows] ** 2, rows, 0.0)
        i, j = np.divmod(np.flatnonzero(low <= limit[:, None]), max(len(b), 1))
        ni, nj = bounds.na[start + i], bounds.nb[j]
        # the width of the bounds and what the limit was rounded up by
        width = 4 * bounds.slop * (nj**2 + 2 * ni * nj) + 4e-6 * (ni**2 + eps**2)
        open_ = np.flatnonzero(low[i, j] + width > eps**2 - ni**2)
        keep = np.ones(len(i), bool)
        for part in range(0, len(open_), elements // 16):
            o = open_[part : part + elements // 16]
            keep[o] = pair_distances(a, b, start + i[o], j[o]) <= eps
        yield start + i[keep], j[keep]
