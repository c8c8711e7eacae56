"""Comparison of all report pairs, block by block.

Reports are numbered in the order of their ids and cut into blocks of bounded size. Each pair of blocks is a cell, and a
cell counts shared organisms in one matrix. An organism goes only to the cells of blocks that hold it, as two
lists of places, so no row per pair is shuffled; a cell streams its lists and writes its pairs slice by slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.operators.ordered import ranked
from estuarine.session import materialize

#: Reports in a block at most: a cell's matrix has this many rows and columns.
BLOCK = 1024
#: Counts taken at once, and pairs in a batch of output.
STEP = 2**16
#: Most partitions of the cells; further cells share them one after another.
PARTITIONS = 2000


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists and the length of each."""
    return np.asarray(column.flatten()).astype(np.int64), np.asarray(pc.fill_null(column.value_lengths(), 0)).astype(np.int64)


def add_shared(shared: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], step: int = STEP) -> None:
    """Add 1 to `shared[a, b]` for every row and every a of its left and b of its right list.

    Long lists go through products of 0/1 matrices, exact in single precision, short ones are added one by one.
    """
    (a, m), (b, n) = left, right
    at_a, at_b = (np.concatenate([[0], np.cumsum(x)]) for x in (m, n))
    work = np.concatenate([[0], np.cumsum(m * n)])
    first = 0
    while first < len(m):
        # a row alone has at most as many counts as the matrix has places
        last = max(int(np.searchsorted(work, work[first] + max(step, shared.size), side="right")) - 1, first + 1)
        last = min(last, first + 4096, len(m))
        x, y = a[at_a[first] : at_a[last]], b[at_b[first] : at_b[last]]
        row_x, row_y = np.repeat(np.arange(last - first), m[first:last]), np.repeat(np.arange(last - first), n[first:last])
        if (work[last] - work[first]) * 64 > shared.size * (last - first):
            ones = np.zeros((last - first, shared.shape[0]), np.float32), np.zeros((last - first, shared.shape[1]), np.float32)
            ones[0][row_x, x] = 1
            ones[1][row_y, y] = 1
            shared += (ones[0].T @ ones[1]).astype(np.int64)
        else:
            times = n[first:last][row_x]
            skip = np.cumsum(times) - times
            other = np.arange(int(times.sum())) + np.repeat(at_b[first:last][row_x] - at_b[first] - skip, times)
            np.add.at(shared, (np.repeat(x, times), y[other]), 1)
        first = last


def _pairs(shared: np.ndarray, one: pa.StructArray, two: pa.StructArray, same: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The cell's pairs with what is known of both reports; those above the diagonal if the blocks are the same."""
    rows = max(1, STEP // max(len(two), 1))
    for start in range(0, len(one), rows):
        a, b = np.divmod(np.arange(start * len(two), min(start + rows, len(one)) * len(two)), len(two))
        if same:
            a, b = a[a < b], b[a < b]
        if len(a):
            sides = [side.field(c).take(pa.array(at)) for side, at in ((one, a), (two, b)) for c in ("report_id", "s", "h", "d")]
            yield pa.RecordBatch.from_arrays([*sides, pa.array(shared[a, b])], schema=schema)


def all_pairs(counts: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """(report_id_1, s1, h1, d1, report_id_2, s2, h2, d2, shared) for all report pairs in the order of their ids.

    `counts` has one row per (report_id, organism_id), `known` (report_id, s, h, d) one per report. Null organisms are
    shared with none.
    """
    spark = counts.sparkSession
    placed = materialize(ranked(known.filter("report_id is not null"), [], [F.col("report_id")], "i"))
    reports = placed.count()
    # enough cells for every core
    blocks = max(math.ceil(reports / block), math.ceil(2 * math.sqrt(spark.sparkContext.defaultParallelism)))
    size = max(1, math.ceil(reports / blocks))
    blocks = max(1, math.ceil(reports / size))
    place = F.col("i") - 1
    placed = placed.withColumns({"block": F.floor(place / size).cast("int"), "slot": F.pmod(place, F.lit(size)).cast("int")})

    held = counts.filter("organism_id is not null").select("report_id", "organism_id").join(placed.select("report_id", "block", "slot"), "report_id")
    lists = materialize(held.groupBy("organism_id", "block").agg(F.collect_list("slot").alias("slots")))
    side = lambda b, s: lists.select("organism_id", F.col("block").alias(b), F.col("slots").alias(s))
    met = side("i", "left").join(side("j", "right").hint("merge"), "organism_id").filter("i < j or (i = j and size(left) > 1)")

    known_of = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "report_id", "s", "h", "d"))).alias("reports"))
    cell = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = known_of.select("block", cell.alias("other"), "reports")
    of = spread.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("kind"), "reports")
    cells = met.select("i", "j", F.lit(2).alias("kind"), "left", "right").unionByName(of, allowMissingColumns=True)
    # both sides' reports come before the lists
    parts = min(blocks * (blocks + 1) // 2, PARTITIONS)
    cells = cells.repartition(parts, "i", "j").sortWithinPartitions("i", "j", "kind")

    kind = known.schema["report_id"].dataType.simpleString()
    ddl = ", ".join(f"report_id_{n} {kind}, s{n} long, h{n} double, d{n} double" for n in (1, 2)) + ", shared long"
    schema = _arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, shared = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)) for c in ("i", "j", "kind")])
            edges = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                i, j, what = key[:, start].tolist()
                if (i, j) != now:
                    if now:
                        yield from _pairs(shared, sides[0], sides[-1], now[0] == now[1], schema)
                    now, sides, shared = (i, j), [], None
                part = batch.slice(start, end - start)
                if what < 2:
                    sides.append(part.column("reports").flatten())
                if what == 1 or (i == j and what == 0):
                    shared = np.zeros((len(sides[0]), len(sides[-1])), np.int64)
                if what == 2:
                    add_shared(shared, _lists(part.column("left")), _lists(part.column("right")))
        if now:
            yield from _pairs(shared, sides[0], sides[-1], now[0] == now[1], schema)

    return cells.mapInArrow(count, ddl)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
