"""Report pairs: a report in many pairs, and organisms alike by class."""

import numpy as np
from pyspark.sql import functions as F

from estuarine.operators import identity as I
from estuarine.operators import trends as T


def test_a_leading_report_is_not_copied_to_its_pairs(spark):
    rng = np.random.default_rng(4)
    items = {r: set(rng.integers(0, 60, 40 if r == 7 else 6).tolist()) for r in range(30)}
    items[30] = {1000}  # shares nothing
    rows = [(r, i) for r, held in items.items() for i in held for _ in range(1 + (r + i) % 2)]
    seqs = spark.createDataFrame(rows, "report_id long, organism_id long")
    out = T.compare_reports(seqs, T.leading_pairs(T.organism_counts(seqs)))
    # organisms of both sides as one table would hold all of the leading report's for every pair
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["report_id_1"], r["report_id_2"]): (r["shared"], r["size_1"], r["size_2"], r["only_1"], r["only_2"], r["total"]) for r in out.collect()}
    n = lambda a, b: (len(a & b), len(a), len(b), len(a - b), len(b - a), len(a | b))
    assert got == {(r, 7): n(held, items[7]) for r, held in items.items() if r != 7}


def test_names_stay_out_of_the_tables_of_pairs(spark):
    rng = np.random.default_rng(9)
    name = lambda n: [f"name{rng.integers(5)}", None][int(rng.integers(5) == 0)]
    ranks = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]
    organisms = {i: (f"s{rng.integers(3)}" if i else None, "k", "p", f"c{rng.integers(2)}", "o", "f", f"genus{rng.integers(2)}", name(i)) for i in range(40)}
    held = {r: set(rng.integers(0, 40, 12).tolist()) for r in range(4)}
    rows = [(r, i, *organisms[i]) for r, x in held.items() for i in x]
    members = spark.createDataFrame(rows, "report_id long, organism_id long, signature string, " + ", ".join(f"`{r}` string" for r in ranks))
    pairs = [(0, 1), (1, 2), (2, 3)]
    out = I.match_organisms(members, spark.createDataFrame(pairs, "report_id_1 long, report_id_2 long"))
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "report_id_1" in x and "species" in x]

    class_of = lambda i: organisms[i]
    scored = members.select("signature", *ranks).distinct()
    side = lambda k: scored.select(*[F.col(c).alias(f"{c}_{k}") for c in scored.columns])
    score = (I.taxonomic_similarity(*({r: F.col(f"{r}_{k}") for r in ranks} for k in (1, 2))) + 1) / 2
    alike = {(tuple(r[:8]), tuple(r[8:])) for r in side(1).crossJoin(side(2)).filter(score >= I.CROSS_REPORT_MIN).filter("signature_1 = signature_2").collect()}
    got = {(r["report_id_1"], r["report_id_2"]): (r["exact_matches"], r["unique_to_1"], r["unique_to_2"], r["similar_pairs"], r["similar_classes"]) for r in out.collect()}
    want = {}
    for a, b in pairs:
        found = [(class_of(i), class_of(j)) for i in held[a] - held[b] for j in held[b] - held[a] if (class_of(i), class_of(j)) in alike]
        want[a, b] = (len(held[a] & held[b]), len(held[a] - held[b]), len(held[b] - held[a]), len(found), len(set(found)))
    assert got == want and any(w[3] for w in want.values())
