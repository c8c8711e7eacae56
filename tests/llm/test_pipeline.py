"""The pipeline's stages, each against brute force on its own input."""

import numpy as np

import corpus_pipeline
import __spark_entry__ as entry
from estuarine.session import materialize
from tests.llm import helpers
from tests.llm.test_operators import check_packed, library_ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF))
        rows = docs.collect()
        assert i == 4 or docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows} if i < 4 else {}
        seen.append(len(after))
        if name == "quality_rules":
            failed = {k for k, t in before.items() if (b := helpers.base_rules(t))[0] < 10 or 100 * b[4] > 20 * b[0]}
            assert not failed & set(after) and all(before[k] == t for k, t in after.items())
        elif name == "line_dedup":
            lines = [x.strip() for t in after.values() for x in t.split("\n") if x.strip()]
            assert len(lines) == len(set(lines)) and set(lines) <= {x.strip() for t in before.values() for x in t.split("\n")}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "minhash":
            want = helpers.near_duplicates(before.items())
            assert after == {k: t for k, t in before.items() if want[k][1] == k}
        elif name == "suffix_array":
            want = dict(zip(before, helpers.repeated(before.values()), strict=True))
            assert set(after) == {k for k, w in want.items() if w[1] < w[0] or not w[0]}
        else:
            check_packed(rows, {k: [*library_ids(t), 2] for k, t in before.items()})
    assert seen[0] > seen[1] > 0
    assert {r["sequence_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["sequence_id"] for r in rows}


def test_minhash_takes_five_words(spark):
    """Documents alike by two-word shingles but not by five-word ones stay."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(100)]
    edited = lambda at: " ".join("new%d" % i if i in at else w for i, w in enumerate(words))
    texts = [" ".join(words), edited({10, 30, 50, 70, 90}), edited({55}), "one two three", "one two three", "one two"]
    texts += [" ".join(f"v{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(5)]
    five = lambda t: frozenset(tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4)))
    sets = list(map(five, texts))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = helpers.roots(range(len(sets)), pairs)
    got = corpus_pipeline.minhash(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SF)
    assert {r["doc_id"] for r in got.collect()} == set(want.values()) and want[1] == 1 and want[2] == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "some words here " * 9, None, None, None)], docs.schema))
    for table in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            table = materialize(stage(spark, table, SF))
        assert table.count() >= 0
