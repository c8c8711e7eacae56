"""Closed-form cases, skew and block behaviour of the core operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from estuarine.functions import mathx
from estuarine.functions import sequences as S
from estuarine.operators import diversity as D
from estuarine.operators import reads as R
from estuarine.operators.identity import fuzzy_match, identify_organisms
from estuarine.operators.lineage import attach_names
from estuarine.operators.ordered import exact_quantiles, ranked, running_totals
from estuarine.operators.rates import FixedWindow, SlidingLog, rate_audit
from estuarine.operators.textjoin import first_containing


def test_lgamma(spark):
    values = [0.5, 1.0, 2.0, 3.5, 9.9, 10.0, 170.0, 1e4, 1e7, 1e12]
    rows = spark.createDataFrame([(v,) for v in values], "z double")
    for z, got in rows.select("z", mathx.lgamma(F.col("z"))).collect():
        assert got == pytest.approx(math.lgamma(z), rel=1e-11, abs=1e-10)


def test_single_taxon(spark):
    df = spark.createDataFrame([("a", "x", 3000)], "sample_id string, taxon string, n long")
    r = D.alpha_diversity(df).first()
    assert (r.richness, r.abundance) == (1, 3000)
    assert r.shannon == pytest.approx(0, abs=1e-12)
    assert r.chao1 == r.ace == r.berger_parker == 1.0
    assert r.effective_species == pytest.approx(1.0)
    assert r.fisher_alpha == pytest.approx(0.0969, abs=1e-3)
    assert D.inequality(df).first().gini_reference == pytest.approx(1.0)


def test_spectrum_metrics_match_taxon_loop(spark):
    rng = random.Random(3)
    counts = [rng.choice([1, 1, 1, 2, 2, 3, 7, 7, 40]) for _ in range(60)]
    df = spark.createDataFrame([("s", f"t{i}", c) for i, c in enumerate(counts)], "sample_id string, taxon string, n long")
    ordered, total = sorted(counts, reverse=True), sum(counts)
    cum = np.cumsum(ordered)
    d = D.dominance(df).first()
    assert d.species_for_50_percent == int((cum * 2 <= total).sum()) + 1
    assert d.species_for_80_percent == int((cum * 5 <= total * 4).sum()) + 1
    assert d.top_5_species_percentage == pytest.approx(cum[4] / total * 100)
    x, y = np.arange(1, 61) / 60, cum / total
    g = D.inequality(df).first()
    assert g.gini_reference == pytest.approx(1 - 2 * float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()))
    ranks = D.rank_abundance(df).orderBy("rank").collect()
    assert [r.n for r in ranks] == ordered


def test_empty_and_zero_groups(spark):
    df = spark.createDataFrame([("a", "x", 0)], "sample_id string, taxon string, n long")
    assert D.alpha_diversity(df).count() == 0
    assert D.rank_abundance(df).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_and_totals_with_a_hot_key(spark, parts):
    """One key holds most rows and is spread over several sorted slices."""
    rows = [("hot" if i % 10 else f"k{i}", i * 37 % 1009, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v long, id long").repartition(parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = running_totals(df, ["k"], [F.col("v"), F.col("id")], {"rank": F.lit(1).cast("long"), "run": F.col("v")})
        got = {(r.k, r.id): (r.rank, r.run) for r in out.collect()}
        whole = {r.id: r.rank for r in ranked(df, [], [F.col("v"), F.col("id")]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want, state = {}, {}
    for k, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, s = state.get(k, (0, 0))
        state[k] = want[(k, i)] = (n + 1, s + v)
    assert got == want
    assert whole == {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=501), "b": rng.integers(0, 5, size=100).astype(float), "c": np.array([4.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k string, x double")
    probs = {"q1": 0.25, "q5": 0.5, "q95": 0.95}
    for r in exact_quantiles(df, ["k"], "x", probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(float(np.quantile(data[r.k], p)))


def test_kmers_and_encoding(spark):
    df = spark.createDataFrame([(1, "ATCGATCG"), (2, "ACNGT"), (3, "AC")], "sequence_id long, seq string")
    got = {r[0]: r[1] for r in df.select("sequence_id", S.kmers(F.col("seq"), 3)).collect()}
    assert got == {1: ["ATC", "TCG", "CGA", "GAT", "ATC", "TCG"], 2: [], 3: []}
    assert df.select(S.kmers(F.col("seq"), 3, clean=False)).collect()[1][0] == ["ACN", "CNG", "NGT"]
    rows = R.encode_kmers(df, 3, 4).orderBy("sequence_id", "chunk").collect()
    assert rows[0].input_ids == [14, 55, 25, 36] and rows[0].attention_mask == [1, 1, 1, 1]
    assert (rows[1].chunk, rows[1].input_ids, rows[1].attention_mask) == (1, [14, 55, 0, 0], [1, 1, 0, 0])
    assert [r.chunk for r in rows if r.sequence_id == 3] == [0]


def test_kmers_of_a_long_text_take_linear_time(spark):
    df = spark.range(1).select(F.repeat(F.lit("ACGTTGCA"), 60_000).alias("seq"))
    assert df.select(F.size(S.kmers(F.col("seq"), 12))).first()[0] == 480_000 - 11


def test_quality_filter_fixture(spark):
    rows = [(0, "ATCGATCGATCG"), (1, "ATCGNNNNNATCG"), (2, "ATCG"), (3, "A" * 1000), (4, "GCTAGCTAGCTA")]
    df = spark.createDataFrame(rows, "sequence_id long, seq string")
    kept = R.quality_filter(df, 10, 500, 20, 3)
    assert sorted(r.sequence_id for r in kept.collect()) == [0, 4]


def test_quality_cut_and_adapters(spark):
    q = [30, 30, 30, 8, 7, 25, 3]
    df = spark.createDataFrame([(q,), ([40, 40],), ([2, 2, 2],)], "qual array<int>")
    # walking from the end the sums of 20 - q are 17, 12, 25, 37, 27, 17, 7
    assert [r[0] for r in df.select(R.quality_cut(F.col("qual"))).collect()] == [3, 2, 0]
    body = "ACGT" * 15
    seqs = [body + "AGATCGGAAGAGCTTTT", body + "AGATCG", body + "AG", body]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "sequence_id long, seq string")
    out = {r.sequence_id: r.seq for r in R.trim_adapters(df).collect()}
    assert out == {0: body, 1: body, 2: body + "AG", 3: body}


def test_marker_order(spark):
    df = spark.createDataFrame([("has 16S and 18s", "AC"), ("none", "ACOIT"), ("none", "AC")], "description string, seq string")
    got = [r[0] for r in df.select(S.marker_gene(F.col("description"), F.col("seq"))).collect()]
    assert got == ["18S", "COI", None]


def test_limiters():
    w = FixedWindow(2, 60)
    assert [w.step(t)[0] for t in (0, 10, 59, 60, 61, 62)] == [True, True, False, True, True, False]
    s = SlidingLog(2, 60)
    # a denied event leaves no trace
    assert [s.step(t)[0] for t in (0, 50, 55, 60, 111, 112)] == [True, True, False, True, True, False]


@pytest.mark.parametrize("kind", ["fixed", "sliding"])
def test_rate_audit_matches_a_plain_walk(spark, kind):
    rng = random.Random(5)
    events = [(i, rng.choice("aaab"), t) for i, t in enumerate(sorted(rng.sample(range(40_000), 600)))]
    df = spark.createDataFrame(events, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(6)
    got = {r.id: (r.allowed, r.retry_after) for r in rate_audit(df, "k", "ts", "id", 3, 300, kind).collect()}
    limiter = {"fixed": FixedWindow, "sliding": SlidingLog}[kind]
    walk = {k: limiter(3, 300_000_000) for k in "ab"}
    want = {}
    for i, k, t in events:
        ok, wait = walk[k].step(t * 1_000_000)
        want[i] = (ok, wait / 1e6)
    assert got == want


def test_first_containing(spark):
    names = spark.createDataFrame([("Alpha beta", 1), ("beta gamma", 2), ("xbetax", 3), ("z", 4)], "name string, pos long")
    needles = spark.createDataFrame([("BETA",), ("z",), ("am",), ("absent",), ("",)], "needle string")
    got = {r.needle: r.name for r in first_containing(needles, "needle", names, "name", "pos").collect()}
    assert got == {"BETA": "Alpha beta", "z": "z", "am": "beta gamma"}


def test_first_containing_long_needles(spark):
    names = spark.createDataFrame([("a long name of one", 2), ("THE long name of two", 1), (None, 0)], "name string, pos long")
    needles = spark.createDataFrame([("Long name of",), ("name of one",), ("name of three",), ("ng na",), (None,)], "needle string")
    got = {r.needle: r.pos for r in first_containing(needles, "needle", names, "name", "pos").collect()}
    assert got == {"Long name of": 1, "name of one": 2, "ng na": 1}


def test_attached_names_are_not_broadcast(spark):
    """Substrings of all names are many times their input, which the optimiser does not see."""
    reads = spark.createDataFrame([(7, "Genus species"), (12, "x"), (3, "none")], "sequence_id long, description string")
    table = spark.createDataFrame([(3, "Exact", 1), (100, "Unit 712", 3), (101, "Unit 12", 2)], "sequence_id long, name string, pos long")
    out = attach_names(reads, table)
    assert {r.sequence_id: r.name for r in out.collect()} == {3: "Exact", 7: "Unit 712", 12: "Unit 12"}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("BroadcastExchange") == 1  # the row of needle lengths


def joined_rows(df):
    """Rows that the joins of an executed plan gave, the largest."""
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name.endswith("JoinExec"):
            found.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in name else []
        for child in inner + [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


def test_groups_of_one_lineage_are_compared_once(spark):
    schema = "signature string, kingdom string, phylum string, genus string, species string"
    known = [(i, "s", f"king {i}", "phyl", "g", "x" if i % 2 else None) for i in range(200)]
    groups = [(i, *([("s", "king 7", "phylum", "g", "x"), ("s", "other", "phyl", "g", None), (None, "king 7", "phyl", "g", "x")][i % 3])) for i in range(3000)]
    out = identify_organisms(spark.createDataFrame(groups, f"group_id long, {schema}"), spark.createDataFrame(known, f"organism_id long, {schema}"))
    rows = {r.group_id: r for r in out.collect()}
    assert len(rows) == 3000
    assert all((rows[i].organism_id, rows[i].match_tier) == ("1", 2) for i in range(0, 3000, 3))  # fuzzy, smallest id
    assert all(rows[i].is_new and rows[i].match_tier is None for i in range(3000) if i % 3)
    assert joined_rows(out) < 5000


def test_fuzzy_match(spark):
    df = spark.createDataFrame([("vibrio", "vib", True), ("vibrio", "vibex", True), ("abc", "abd", False), ("", "a", False)], "a string, b string, w boolean")
    assert all(r[0] == r[1] for r in df.select(fuzzy_match(F.col("a"), F.col("b")), "w").collect())
