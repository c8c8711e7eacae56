"""All report pairs against brute force."""

import math

import numpy as np
import pytest

from estuarine.operators import reportgrid as G
from estuarine.operators import trends as T


@pytest.mark.parametrize("block", [4, 1024])
def test_every_pair_of_reports_is_compared(spark, block):
    rng = np.random.default_rng(8)
    items = {10 * r: set(rng.integers(0, 30, int(rng.integers(1, 25))).tolist()) for r in range(23)}
    items[230] = {1000}  # shares nothing
    rows = [(r, i) for r, held in items.items() for i in held for _ in range(1 + (r + i) % 3)] + [(None, 1), (0, None), (10, None)]
    out = T.compare_all_reports(spark.createDataFrame(rows, "report_id long, organism_id long"), block=block).collect()

    def shannon(r):
        n = [1 + (r + i) % 3 for i in items[r]] + [1] * (r in (0, 10))
        return -sum(x / sum(n) * math.log(x / sum(n)) for x in n)

    # a null organism counts for its report and is shared with none
    size = {r: len(held) + (r in (0, 10)) for r, held in items.items()}
    want = {(a, b): (len(items[a] & items[b]), size[a], size[b]) for a in items for b in items if a < b}
    got = {(r["report_id_1"], r["report_id_2"]): (r["shared"], r["size_1"], r["size_2"]) for r in out}
    assert len(out) == len(want) == 24 * 23 // 2 and got == want
    for r in out:
        assert abs(r["shannon_diff"] - abs(shannon(r["report_id_1"]) - shannon(r["report_id_2"]))) < 1e-9
        assert r["total"] == r["size_1"] + r["size_2"] - r["shared"] and r["jaccard"] == r["shared"] / r["total"]


def test_ids_that_are_text_and_few_reports(spark):
    seqs = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "y"), ("c", "z")], "report_id string, organism_id string")
    got = {(r["report_id_1"], r["report_id_2"], r["shared"]) for r in T.compare_all_reports(seqs).collect()}
    assert got == {("a", "b", 1), ("a", "c", 0), ("b", "c", 0)}
    assert T.compare_all_reports(seqs.filter("report_id = 'a'")).count() == 0
    assert T.compare_all_reports(seqs.filter("report_id = 'q'")).count() == 0


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_long_and_short_lists_are_counted_alike(share):
    rng = np.random.default_rng(3)
    x, y = rng.random((5000, 40)) < share, rng.random((5000, 30)) < share
    lists = lambda t: (np.nonzero(t)[1], t.sum(1))
    shared = np.zeros((40, 30), np.int64)
    G.add_shared(shared, lists(x), lists(y), step=1000)
    assert (shared == x.astype(np.int64).T @ y.astype(np.int64)).all()


def test_the_query_has_every_pair(spark):
    import __spark_entry__ as entry

    out = entry.queries()["batch_compare"](spark, "/root/testdata/sf0.001")
    reports = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey").distinct().collect()}
    assert {(r[0], r[1]) for r in out.select("report_id_1", "report_id_2").collect()} == {(a, b) for a in reports for b in reports if a < b}
